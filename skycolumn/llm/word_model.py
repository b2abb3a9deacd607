"""Interpolated modified Kneser-Ney model of words as they are, over a Kneser-Ney model of their spelling in code points.

* Units. A run of letters and marks, or of digits, is a unit; so is every other visible character, every line end and every
  character of the scripts written without spaces (Han, kana, Thai, Lao, Burmese, Khmer). Nothing is folded. A unit is the
  64-bit hash of its code points, so n-grams do not level off: what the model gathers grows with the trusted text.
* Fit. The ``WORDS``-grams of all trusted texts are counted in packed rows (``packed``) dealt out by the words before the last one, then by
  the last words. The spelling model counts the ``SPELLING``-grams of code points of the distinct trusted words; below both lies one
  of ``CODE_POINTS`` per code point.
* Sums. With s = -ln p an n-gram's surprise is what is left to its context (b), the surprise of its tail, and less a gain v where it was
  seen: s(xyz) = b(xy) + s(yz) - v(xyz), v = ln(1 + share(xyz) / (b's weight * p(yz))). A text's surprise is thus a sum over its words, its pairs
  and its triples, each added where its shard lies. An n-gram that was not seen adds nothing and needs no answer.
* Score. A block of texts asks each shard for its words, pairs and triples with the texts they stand in and gets back one sum per text. This goes
  over one slice of the keys after the other (``SLICES``), so a part of the requests lies on disk at a time.

A triple is asked for by the 64-bit hash of its last two words and 32 bits of the first one's.
The model of all languages is built only if a text needs it.
Nothing is broadcast or collected that grows with the data. Texts over ``CHUNK`` characters are cut at spaces; a word longer
than that is cut too, and all its parts are scored.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skycolumn.llm import packed
from skycolumn.llm.common import written
from skycolumn.session import cut_lineage

WORDS, SPELLING = 3, 4
CODE_POINTS = 1 << 17
CHUNK = 1 << 20
# Units counted or asked for, words remembered and code points spelled by a task at a time, and its texts: their numbers have 16 bits.
HELD, TEXTS = 1 << 20, 1 << 15
# Characters of a shard, at least MIN_SHARDS and at most MAX_SHARDS, and slices of the keys.
SHARD_CHARS, MIN_SHARDS, MAX_SHARDS, SLICES = 16 << 20, 12, 256, 4
# The unit after a text's last one; those before its first one are 0.
END = 1
POOL = "*"

SPACE, ALONE, LETTER, DIGIT = range(4)
# Scripts without spaces between words.
_NO_SPACES = [(0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3130), (0x31A0, 0xA000), (0xF900, 0xFB00), (0x20000, 0x323B0)]
U, C = [f"u{i}" for i in range(WORDS)], [f"c{i}" for i in range(SPELLING)]


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, ALONE, np.uint8)
    for c in range(0x32400):
        ch, category = chr(c), unicodedata.category(chr(c))
        if ch.isspace():
            kinds[c] = ALONE if ch == "\n" else SPACE
        elif category[0] in "LM" or category == "Cf":
            kinds[c] = LETTER
        elif category[0] == "N":
            kinds[c] = DIGIT
    for low, high in _NO_SPACES:
        kinds[low:high] = ALONE
    kinds[0x3000] = SPACE
    return kinds


@functools.cache
def _powers() -> np.ndarray:
    steps = np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def cut(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or end
        yield text[at:end]
        at = end


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit id of every unit of a text of at most CHUNK characters."""
    points = _points(text)
    kind = _kinds()[points]
    start = kind != SPACE
    start[1:] &= (kind[1:] == ALONE) | (kind[1:] != kind[:-1])
    at = np.flatnonzero(start)
    if not len(at):
        return at, at, at.astype(np.int64)
    offset = np.arange(len(points)) - at[np.cumsum(start) - 1]
    value = _mix(points.astype(np.uint64) + np.uint64(1)) * _powers()[offset & 0xFFFF]
    value[kind == SPACE] = 0
    return at, np.add.reduceat((kind != SPACE).astype(np.int64), at), _mix(np.add.reduceat(value, at)).view(np.int64)


def padded(text: str) -> np.ndarray:
    """The units of a whole text between WORDS - 1 starts (0) and one end."""
    return np.concatenate([np.zeros(WORDS - 1, np.int64), *[units(p)[2] for p in cut(text)], np.full(1, END)])


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of the n-grams whose units stand in these columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for k, column in enumerate(columns):
        out = _mix(out + np.uint64(k + 1) + column.view(np.uint64))
    return out.view(np.int64)


def seed(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def key_of(columns: list[np.ndarray], seeds: np.uint64 | np.ndarray) -> np.ndarray:
    """Keys of words or pairs of a language."""
    return _mix(hashed(columns).view(np.uint64) + seeds)


def short(units: np.ndarray) -> np.ndarray:
    return (_mix(units.view(np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)


def triple_of(pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _mix(pair ^ (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by these columns, and where in it a new value begins."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = functools.reduce(np.logical_or, [(x := c[order])[1:] != x[:-1] for c in columns])
    return order, np.flatnonzero(new)


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows and the sum of their counts."""
    order, at = runs(columns)
    return [c[order[at]] for c in columns], np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def _context(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The distinct contexts, per context how many n-grams have the count one, two and more and the sum of counts, and each n-gram's context."""
    order, at = runs(columns)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
    sums = [np.bincount(which, x, len(at)).astype(np.int64) for x in (n == 1, n == 2, n > 2, n)]
    return [c[order[at]] for c in columns], sums, which


def _counts(shards: int, pool: bool):
    """(lang, text) to packed triples with counts, by their first two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            sequences = held.pop(lang)
            size.pop(lang)
            columns = [np.concatenate([x[k:len(x) - WORDS + 1 + k] for x in sequences]) for k in range(WORDS)]
            columns, n = summed(columns, np.ones(len(columns[0]), np.int64))
            return packed.deal(lang, packed.TRIPLES, key_of(columns[:2], seed(lang)), [*columns, n], shards)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = text.as_py()
                if value:
                    ids = padded(value)
                    for name in {lang, "=" + POOL} if pool else {lang}:
                        held.setdefault(name, []).append(ids)
                        size[name] = size.get(name, 0) + len(ids)
                    if sum(size.values()) >= HELD:
                        for each in list(held):
                            yield from flush(each)
        for lang in list(held):
            yield from flush(lang)

    return run


def _followed(shards: int):
    """Triples by context to triples by tail with their context's numbers, and the contexts."""

    def run(lang: str, tables: packed.Tables) -> Iterator[pa.RecordBatch]:
        *columns, n = tables[packed.TRIPLES]
        columns, n = summed(columns, n)
        contexts, sums, which = _context(columns[:2], n)
        yield packed.tally(lang, n)
        key = key_of(contexts, seed(lang))
        order = np.argsort(key)
        yield from packed.deal(lang, packed.CONTEXTS, key[order], [key[order], *[x[order] for x in sums]], shards, SLICES)
        yield from packed.deal(lang, packed.FOLLOWED, key_of(columns[1:], seed(lang)), [*columns[1:], short(columns[0]), n, *[x[which] for x in sums[:3]]], shards, SLICES)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], kind: int, take: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Iterator[tuple[str, list[np.ndarray]]]:
    """(lang, data) to the columns of about HELD entries of one language at a time."""
    held: dict[str, list[list[np.ndarray]]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            columns = take(packed.opened(kind, data.as_py()))
            held.setdefault(lang, []).append(columns)
            size[lang] = size.get(lang, 0) + len(columns[0])
            if size[lang] >= HELD or sum(size.values()) >= 4 * HELD:
                size.pop(lang)
                yield lang, [np.concatenate(c) for c in zip(*held.pop(lang))]
    for lang, parts in held.items():
        yield lang, [np.concatenate(c) for c in zip(*parts)]


def _pairs(shards: int):
    """Packed triples by tail to pairs with the number of words before them, by their first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, columns in _gathered(batches, packed.FOLLOWED, lambda c: c[:2]):
            columns, n = summed(columns, np.ones(len(columns[0]), np.int64))
            yield from packed.deal(lang, packed.PAIRS, key_of(columns[:1], seed(lang)), [*columns, n], shards)

    return run


def _paired(shards: int):
    """Pairs by first word to pairs by second word with the first one's numbers, and the first words."""

    def run(lang: str, tables: packed.Tables) -> Iterator[pa.RecordBatch]:
        *columns, n = tables[packed.PAIRS]
        columns, n = summed(columns, n)
        contexts, sums, which = _context(columns[:1], n)
        yield packed.tally(lang, n)
        yield from packed.deal(lang, packed.BEFORE, key_of(contexts, seed(lang)), [*contexts, *sums], shards)
        yield from packed.deal(lang, packed.PAIRED, key_of(columns[1:], seed(lang)), [*columns, n, *[x[which] for x in sums]], shards)

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs to (lang, word, n): the number of words before it."""
    for lang, (second,) in _gathered(batches, packed.PAIRED, lambda c: c[1:2]):
        w, n = np.unique(second, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w), pa.string()), pa.array(w), pa.array(n.astype(np.int64))], names=["lang", U[-1], "n"])


def _packed_words(shards: int):
    """(lang, word, s) to packed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words, s = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in dict.fromkeys(langs):
                mine = np.flatnonzero(langs == lang)
                key = key_of([words[mine]], seed(lang))
                order = np.argsort(key)
                yield from packed.deal(lang, packed.WORD, key[order], [key[order], s[mine][order]], shards)

    return run


def _found(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether they are there."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def _gain(n: np.ndarray, d: tuple[float, ...], left: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """-ln(1 + discounted count / (left * exp(-tail)))."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(0.0, np.log(n - np.array([0.0, *d])[np.minimum(n, 3)]) - np.log(left) + tail)


def _valued_pairs(shards: int, discounts: dict[str, tuple[float, ...]]):
    """Pairs by second word, and words, to pairs with gain and surprise, and words with all that depends on them alone."""

    def run(lang: str, tables: packed.Tables) -> Iterator[pa.RecordBatch]:
        key, s = tables[packed.WORD]
        order = np.argsort(key)
        key, s = key[order], s[order]
        d = discounts.get(lang, (0.5, 1.0, 1.5))
        first, c1, c2, c3, total = tables[packed.BEFORE]
        before = key_of([first], seed(lang))
        back = -np.log((d[0] * c1 + d[1] * c2 + d[2] * c3) / np.maximum(total, 1))
        words = np.union1d(key, before)
        value = np.zeros(len(words))
        value[np.searchsorted(words, key)] += s
        value[np.searchsorted(words, before)] += back
        yield from packed.deal(lang, packed.WORD, words, [words, value], shards, SLICES)
        u, w, n, c1, c2, c3, total = tables[packed.PAIRED]
        if len(n):
            at, there = _found(key, key_of([w], seed(lang)))
            if not there.all():
                raise ValueError("a trusted word has no surprise")
            left = d[0] * c1 + d[1] * c2 + d[2] * c3
            gain = _gain(n, d, left, s[at])
            pair = key_of([u, w], seed(lang))
            order = np.argsort(pair)
            yield from packed.deal(lang, packed.PAIR, pair[order], [pair[order], gain[order], (s[at] + gain - np.log(left / total))[order]], shards, SLICES)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, w, word): the distinct words, some of them more than once; END is the end of a text, without a letter."""
    seen: dict[str, set[int]] = {}
    rows: list[tuple[str, int, str]] = []

    def flush() -> pa.RecordBatch:
        lang, w, word = zip(*rows)
        rows.clear()
        raw = pa.array([x.encode("utf-8", "surrogatepass") for x in word], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(w, pa.int64()), raw], names=["lang", "w", "word"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for piece in cut(text.as_py() or ""):
                at, length, ids = units(piece)
                distinct, where = np.unique(ids, return_index=True)
                known = seen.setdefault(lang, set())
                if END not in known:
                    known.add(END)
                    rows.append((lang, END, ""))
                for w, k in zip(distinct.tolist(), where.tolist()):
                    if w not in known:
                        known.add(w)
                        rows.append((lang, w, piece[at[k]:at[k] + length[k]]))
                if sum(map(len, seen.values())) > HELD:
                    seen.clear()
                if len(rows) > 50_000:
                    yield flush()
    if rows:
        yield flush()


def _letters(word: bytes) -> np.ndarray:
    points = _points(word.decode("utf-8", "surrogatepass"))
    return np.concatenate([np.zeros(SPELLING - 1, np.int32), points.astype(np.int32) + 1, np.zeros(1, np.int32)])


def _grams(sequences: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate([s[k:len(s) - SPELLING + 1 + k] for s in sequences]) for k in range(SPELLING)]


def _words_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int], list[np.ndarray]]]:
    """(lang, w, word) to words of one language with about HELD code points."""
    held: dict[str, tuple[list, list]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, w, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ws, sequences = held.setdefault(lang, ([], []))
            ws.append(w)
            sequences.append(_letters(word.as_py()))
            size[lang] = size.get(lang, 0) + len(sequences[-1])
            if size[lang] > HELD or sum(size.values()) > 4 * HELD:
                size.pop(lang)
                yield lang, *held.pop(lang)
    for lang, (ws, sequences) in held.items():
        yield lang, ws, sequences


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, w, word) to (lang, c*, n): the SPELLING-grams of code points and the ends of words, summed over parts of bounded size."""
    for lang, _, sequences in _words_at_once(batches):
        columns = _grams(sequences)
        columns, n = summed(columns, np.ones(len(columns[0]), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *map(pa.array, columns), pa.array(n)], names=["lang", *C, "n"])


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, w, word) to (lang, block, ws, sizes, letters)."""
    import zstandard
    from pyspark import TaskContext

    press, block = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
    for lang, ws, sequences in _words_at_once(batches):
        sizes = np.array([len(x) for x in sequences], np.int32)
        values = [np.array(ws, np.int64).tobytes(), sizes.tobytes(), press.compress(np.concatenate(sequences).tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block]), *[pa.array([v], pa.binary()) for v in values]], names=["lang", "block", "ws", "sizes", "letters"])
        block += 1


def _open(sizes: bytes, letters: bytes) -> list[np.ndarray]:
    import zstandard

    return np.split(np.frombuffer(zstandard.ZstdDecompressor().decompress(letters), np.int32), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])


def _ask_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct SPELLING-grams of each part."""
    for batch in batches:
        for lang, block, sizes, letters in zip(*[c.to_pylist() for c in batch.columns]):
            columns = _grams(_open(sizes, letters))
            columns, n = summed(columns, np.ones(len(columns[0]), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), block)), *map(pa.array, columns)], names=["lang", "block", *C])


def _spell(parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    out = []
    known = hashed([answers[c].to_numpy(np.int64) for c in C])
    order = np.argsort(known)
    known, values = known[order], answers["s"].to_numpy(np.float64)[order]
    for lang, ws, sizes, letters in zip(parts["lang"], parts["ws"], parts["sizes"], parts["letters"]):
        sequences = _open(sizes, letters)
        at, there = _found(known, hashed([x.astype(np.int64) for x in _grams(sequences)]))
        if not there.all():
            raise ValueError("a block holds letters that it has not asked for")
        n = np.array([len(x) - SPELLING + 1 for x in sequences])
        out.append(pd.DataFrame({"lang": lang, U[-1]: np.frombuffer(ws, np.int64), "s": np.add.reduceat(values[at], np.cumsum(n) - n)}))
    return pd.concat(out)


def discounted(counts: DataFrame, gram: list[str], context: list[str]) -> DataFrame:
    """(lang, gram, n) of one order to (lang, gram, context, p, back): the discounted share and, per context, the weight left."""
    # Counts of counts of each language; where a count of counts is missing the discount is half, one, one and a half.
    tally = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)])
    t1, t2, t3, t4 = (F.col(f"t{k}") for k in (1, 2, 3, 4))
    y = F.try_divide(t1, t1 + 2 * t2)
    bounded = lambda d, high, other: F.when(d.isNull(), other).otherwise(F.least(F.greatest(d, F.lit(0.05)), F.lit(high)))
    discounts = tally.select("lang", bounded(1 - 2 * y * F.try_divide(t2, t1), 1.0, 0.5).alias("d1"),
                             bounded(2 - 3 * y * F.try_divide(t3, t2), 2.0, 1.0).alias("d2"), bounded(3 - 4 * y * F.try_divide(t4, t3), 3.0, 1.5).alias("d3"))
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # One row per named language.
    rows = counts.join(F.broadcast(discounts), "lang").withColumn("off", discount)
    contexts = rows.groupBy("lang", *context).agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
    return (rows.join(contexts if context else F.broadcast(contexts), ["lang", *context])
            .select("lang", *dict.fromkeys([*gram, *context]), ((F.col("n") - F.col("off")) / F.col("total")).alias("p"), (F.col("left") / F.col("total")).alias("back")))


def fit(counts: DataFrame, columns: list[str]) -> tuple[list[tuple[DataFrame, DataFrame]], list[Callable[[], None]]]:
    """(lang, columns, n) to, per order from 1: (lang, gram, p) of the n-grams seen and (lang, context, back) of their contexts; and
    what deletes these tables."""
    drops: list[Callable[[], None]] = []
    start, delete = written(counts)
    current, model = start, []
    for order in range(len(columns), 0, -1):
        gram = columns[-order:]
        shares, drop = written(discounted(current, gram, gram[:-1]))
        contexts, drop_contexts = written(shares.groupBy("lang", *gram[:-1]).agg(F.first("back").alias("back")))
        model.append((shares.select("lang", *gram, "p"), contexts))
        drops += [drop, drop_contexts]
        # The next order counts the distinct units before an n-gram.
        current = current.groupBy("lang", *gram[1:]).agg(F.count(F.lit(1)).alias("n"))
    delete()
    return model[::-1], drops


def surprise(requests: DataFrame, model: list[tuple[DataFrame, DataFrame]], columns: list[str], base: DataFrame | None) -> tuple[DataFrame, Callable[[], None]]:
    """Distinct (lang, columns) to (lang, columns, s), written, and what deletes it: s = -ln p. ``base`` is (lang, last column, s), or
    all code points alike."""
    below, delete = base, None
    for order, (seen, contexts) in enumerate(model, 1):
        gram = columns[-order:]
        asked = requests if order == len(columns) else requests.select("lang", *gram).distinct()
        if below is None:
            asked = asked.withColumn("s", F.lit(float(np.log(CODE_POINTS))))
        else:
            asked = asked.join(below, ["lang", *(gram[1:] or gram)])
        if order == 1:
            contexts = F.broadcast(contexts)  # one row per named language
        rows = asked.join(seen, ["lang", *gram], "left").join(contexts, ["lang", *gram[:-1]], "left")
        back = F.coalesce("back", F.lit(1.0))
        # What was not seen stays a logarithm: long words have probabilities below the least double.
        s: Column = F.when(F.col("p") > 0, -F.log(F.col("p") + back * F.exp(-F.col("s")))).otherwise(F.col("s") - F.log(back))
        below, done = written(rows.select("lang", *gram, s.alias("s")))
        if delete:
            delete()
        delete = done
    return below, delete


def discounts_of(rows: DataFrame) -> dict[str, tuple[float, ...]]:
    """The discounts of each language (at most some thousand names) from the tallies of all shards."""
    tallies = rows.filter(F.col("kind") == packed.TALLY).groupBy("lang").agg(*[F.sum(F.col("tally")[k]).alias(f"t{k}") for k in range(4)]).collect()
    ratio = lambda a, b: a / b if b else None

    def one(start: int, y: float | None, r: float | None, high: float, other: float) -> float:
        return other if y is None or r is None else min(max(start - (start + 1) * y * r, 0.05), high)

    out = {}
    for lang, *t in tallies:
        y = ratio(t[0], t[0] + 2 * t[1])
        out[lang] = tuple(one(k, y, ratio(t[k], t[k - 1]), high, other) for k, high, other in ((1, 1.0, 0.5), (2, 2.0, 1.0), (3, 3.0, 1.5)))
    return out


def _requests(shards: int, part: int, kind: pa.DataType):
    """(id, mark, lang, text) to what blocks of texts ask the shards of one slice of the keys: (shard, late, lang, kind, data, block, texts, ids, marks,
    langs, chars); one row of a block has its texts, without data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["shard", "late", "lang", "kind", "data", "block", "texts", "ids", "marks", "langs", "chars"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
        block, held, size, seeds = TaskContext.get().partitionId() << 32, [], 0, {}

        def asked(key: np.ndarray, text: np.ndarray, first: np.ndarray | None) -> Iterator[tuple]:
            """Sorted by key: the distinct keys, how often each is asked for, and for whom."""
            mine = np.flatnonzero(packed.slice_of(key, SLICES) == part)
            mine = mine[np.argsort(key[mine], kind="stable")]
            key, text = key[mine], text[mine]
            ends = np.searchsorted(packed.shard_of(key, shards), np.arange(shards + 1, dtype=np.uint64)).tolist()
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                if b > a:
                    at = np.flatnonzero(np.append(True, key[a + 1:b] != key[a:b - 1]))
                    columns = [key[a:b][at], np.diff(np.append(at, b - a)), *([] if first is None else [first[mine[a:b]]]), text[a:b]]
                    which = packed.ASKED_WORDS if first is None else packed.ASKED_PAIRS
                    yield k, 1, None, which, packed.press(which, columns), block, len(held), None, None, None, None

        def flush() -> Iterator[pa.RecordBatch]:
            ids, marks, langs, chars, begins, sequences = zip(*held)
            x, n = np.concatenate(sequences), np.array([len(s) for s in sequences])
            text = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(np.array(begins), n)
            of_lang = np.array([seeds.setdefault(lang, seed(lang)) for lang in langs], np.uint64)[text]
            rows = [(block % shards, 1, None, packed.TALLY, None, block, len(held), list(ids), list(marks), list(langs), list(chars))]
            # Of the two starts one is a word before another.
            word = np.flatnonzero((place >= 2) | (start & (place == 1)))
            rows += asked(key_of([x[word]], of_lang[word]), text[word], None)
            pair = np.flatnonzero((place >= 2) | (start & (place == 1)))
            first = np.where(place[pair] >= 2, x[pair - 2], -1)
            rows += asked(key_of([x[pair - 1], x[pair]], of_lang[pair]), text[pair], short(first))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[k:k + 64]), types)], names=names)

        for batch in batches:
            for key, mark, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                value = text.as_py()
                ids = padded(value) if value else np.zeros(0, np.int64)
                for at in range(0, max(1, len(ids) - WORDS + 1), HELD):
                    # The texts' characters are counted in the first slice alone.
                    held.append((key, mark, lang, len(value) + 1 if value and not at and not part else 0, not at, ids[at:at + HELD + WORDS - 1]))
                    size += len(held[-1][-1]) + 4
                    if size >= HELD or len(held) >= TEXTS:
                        yield from flush()
                        held, size, block = [], 0, block + 1
        if held:
            yield from flush()

    return run


def _answers(discounts: dict[str, tuple[float, ...]], kind: pa.DataType):
    """Rows of shards, model first, to one row per block and shard: (block, ids, marks, langs, chars, sums)."""
    names = ["block", "ids", "marks", "langs", "chars", "sums"]
    types = [pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def valued(lang: str, tables: packed.Tables) -> tuple[np.ndarray, ...]:
        d = discounts.get(lang, (0.5, 1.0, 1.5))
        pair, gain, s = tables[packed.PAIR]
        order = np.argsort(pair)
        pair, gain, s = pair[order], gain[order].astype(np.float64), s[order].astype(np.float64)
        context, c1, c2, c3, total = tables[packed.CONTEXTS]
        both = np.union1d(pair, context)
        value = np.zeros(len(both))
        value[np.searchsorted(both, pair)] += gain
        value[np.searchsorted(both, context)] -= np.log((d[0] * c1 + d[1] * c2 + d[2] * c3) / np.maximum(total, 1))
        u, w, first, n, c1, c2, c3 = tables[packed.FOLLOWED]
        tail = key_of([u, w], seed(lang))
        at, there = _found(pair, tail)
        if not there.all():
            raise ValueError("a pair of a triple has no surprise")
        return both, value, triple_of(tail, first), _gain(n, d, d[0] * c1 + d[1] * c2 + d[2] * c3, s[at]) if len(n) else np.zeros(0), *tables[packed.WORD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, lang, model, tables = None, [], None, [], None

        def add() -> None:
            if held:
                model.append(valued(lang, packed.columns_of(held)))
                held.clear()

        for b in batches:
            out = []
            for shard, late, name, what, data, block, texts, *whose in zip(*[b.column(c).to_pylist() for c in ("shard", "late", "lang", "kind", "data", "block", "texts", "ids", "marks", "langs", "chars")]):
                if shard != at:
                    held.clear()
                    at, model, tables = shard, [], None
                if not late:
                    if name != lang:
                        add()
                    lang = name
                    held.append((what, data))
                    continue
                if data is None:
                    out.append((block, *whose, None))
                    continue
                if tables is None:
                    add()
                    columns = [np.concatenate(x) for x in zip(*model)] if model else [np.zeros(0, np.uint64), np.zeros(0)] * 3
                    tables = [(k[o := np.argsort(k)], v[o]) for k, v in zip(columns[::2], columns[1::2])]
                pairs, triples, words = tables
                key, n, *first, text = packed.opened(what, data)
                known, values = words if what == packed.ASKED_WORDS else pairs
                place, there = _found(known, key)
                value = np.repeat(values[place] * there, n) if len(known) else np.zeros(len(text))
                if what == packed.ASKED_WORDS:
                    pass
                elif len(triples[0]):
                    # A triple was seen only where its pair was.
                    mine = np.flatnonzero(np.repeat(there, n))
                    place, there = _found(triples[0], triple_of(np.repeat(key, n)[mine], first[0][mine]))
                    value[mine[there]] += triples[1][place[there]]
                out.append((block, None, None, None, None, np.bincount(text, value, texts).tobytes()))
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out[k:k + 64]), types)], names=names)

    return run


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    texts = rows[rows["sums"].isna()].iloc[0]
    sums = [np.frombuffer(x, np.float64) for x in rows["sums"] if x is not None]
    total = np.sum(sums, axis=0) if sums else np.zeros(len(texts["langs"]))
    return pd.DataFrame({"id": texts["ids"], "mark": texts["marks"], "lang": texts["langs"], "surprise": total, "n": texts["chars"]})


def score(docs: DataFrame, trusted: DataFrame, total_chars: int) -> DataFrame:
    """``docs`` (id, mark, lang, text) to a written table (id, mark, lang, surprise, n): the surprise in nats of each text
    under the model of ``trusted`` (lang, text), and its characters with one end."""
    shards = min(MAX_SHARDS, max(MIN_SHARDS, total_chars // SHARD_CHARS))
    pool = bool(docs.filter(F.col("lang") == "=" + POOL).limit(1).count())
    # Triples by context, then by tail.
    counts = trusted.select("lang", "text").mapInArrow(_counts(shards, pool), packed.ROW)
    triples, drop_triples = written(packed.exchange(counts, shards, _followed(shards)), by="slice")
    of_triples = discounts_of(triples)
    # Pairs by first word, then by second word.
    pairs = triples.filter(F.col("kind") == packed.FOLLOWED).select("lang", "data").mapInArrow(_pairs(shards), packed.ROW)
    pairs, drop_pairs = written(packed.exchange(pairs, shards, _paired(shards)))
    of_pairs = discounts_of(pairs)
    single = pairs.filter(F.col("kind") == packed.PAIRED).select("lang", "data").mapInArrow(_single, f"lang string, {U[-1]} long, n long")
    single, drop_single = written(single.groupBy("lang", U[-1]).agg(F.sum("n").alias("n")))
    # The words of all texts and their spelling; the model of all languages has the words of all of them.
    words = docs.select("lang", "text").mapInArrow(_words, "lang string, w long, word binary")
    words, drop_words = written(words.groupBy("lang", "w").agg(F.min("word").alias("word")))
    if pool:
        words = words.unionByName(words.withColumn("lang", F.lit("=" + POOL))).groupBy("lang", "w").agg(F.min("word").alias("word"))
    letters = ", ".join(f"{c} int" for c in C)
    spelled = words.join(single.select("lang", F.col(U[-1]).alias("w")), ["lang", "w"], "left_semi").select("lang", "w", "word")
    spelled = spelled.mapInArrow(_spelled, f"lang string, {letters}, n long").groupBy("lang", *C).agg(F.sum("n").alias("n"))
    spelling, drops = fit(spelled, C)
    parts, drop_parts = written(words.select("lang", "w", "word").mapInArrow(_word_parts, "lang string, block long, ws binary, sizes binary, letters binary"))
    drop_words()
    asked = parts.select("lang", "block", "sizes", "letters").mapInArrow(_ask_letters, f"lang string, block long, {letters}")
    distinct, drop_distinct = written(asked.select("lang", *C).distinct())
    known, drop_known = surprise(distinct, spelling, C, None)
    answers = asked.join(known, ["lang", *C]).select("block", *C, "s")
    base = parts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_spell, f"lang string, {U[-1]} long, s double")
    base, drop_base = written(base)
    for drop in (drop_parts, drop_distinct, drop_known, *drops):
        drop()
    model, drops = fit(single, U[-1:])
    drop_single()
    known, drop_known = surprise(base.select("lang", U[-1]), model, U[-1:], base)
    for drop in (drop_base, *drops):
        drop()
    known_words = known.select("lang", U[-1], "s").mapInArrow(_packed_words(shards), packed.ROW)
    rows = pairs.filter(F.col("kind") != packed.TALLY).unionByName(known_words)
    valued, drop_valued = written(packed.exchange(rows, shards, _valued_pairs(shards, of_pairs)), by="slice")
    drop_known()
    drop_pairs()
    # One slice of the keys after the other.
    field = docs.schema["id"].dataType
    kind = to_arrow_type(field)
    lists = f"ids array<{field.simpleString()}>, marks array<long>, langs array<string>, chars array<long>"
    dealt = f"shard int, late int, lang string, kind int, data binary, block long, texts int, {lists}"
    out = None
    for part in range(SLICES):
        rows = triples.filter(F.col("kind") != packed.TALLY).unionByName(valued).filter(F.col("slice") == part).select("shard", "late", "lang", "kind", "data")
        asked = docs.select("id", "mark", "lang", "text").mapInArrow(_requests(shards, part, kind), dealt)
        rows = packed.dealt_out(asked.unionByName(rows, allowMissingColumns=True), shards)
        sums = rows.mapInArrow(_answers(of_triples, kind), f"block long, {lists}, sums binary")
        sums, _ = written(sums.groupBy("block").applyInPandas(_total, f"id {field.simpleString()}, mark long, lang string, surprise double, n long"))
        out = sums if out is None else out.unionByName(sums)
    drop_triples()
    drop_valued()
    return cut_lineage(out.groupBy("id", "mark", "lang").agg(F.sum("surprise").alias("surprise"), F.sum("n").alias("n")))
