"""Periodic runs of words: internal pattern matching over dyadic blocks.

A run is a maximal stretch of words in which words ``period`` apart are identical, with the smallest such period and a
length of at least ``LEAST`` words and two periods. Many texts are searched at once, as one sequence of numbers in which
words of different texts never agree:

* prefix doubling ranks all factors of 1, 2, 4, ... words until none recurs; the last ranks give the suffix array, and the
  occurrences of any factor of those lengths are an interval of it;
* a run of period q holds an aligned block of the largest power of two b with 2 b - 1 <= q, and the same words q further
  on. So each recurring block asks a wavelet tree over the suffix array (range successor: the smallest position of an interval
  that is not below a given one) for its occurrences in the two neighbouring windows of b positions that cover the
  distances 2 b - 1 .. 4 b - 2. Periods up to 14 are found from blocks of four words on every second position;
* occurrences within one window are an arithmetic progression. Up to two are candidates themselves. Of three and more, the
  block lies in a stretch of the progression's difference, its occurrences lie in another one or the same, and the ends of both
  leave the candidates that can be periods (``_progressions``);
* candidates are extended to both sides by comparing ranks of falling powers of two. Of equal stretches the smallest
  period stays, which is the one that is no multiple.

The work is n log n for n words, whatever they are; a batch takes about four bytes per word and length of the recurring
factors. Texts go through Spark's partitions in batches of ``BATCH`` bytes, at least one text each; nothing is shuffled.

Defined cases: NULL and empty texts have no words and no runs. Rows that repeat are searched each, NULL ids too. Words are taken as bytes,
so texts of any encoding pass. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.llm.common import let

LEAST = 12
BATCH = 3 << 20
SPACE = "[\\x20\\x09-\\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _heads(sorted_keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index where the group of each starts."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


class Factors:
    """Ranks of all factors of 2^k symbols while any recurs, and per k the recurring ones as (position, rank, occurrences)."""

    def __init__(self, symbols: np.ndarray):
        """The first and the last symbol, and one between any two texts, occur once."""
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = _heads(symbols[order])
        rank = np.empty(n, np.int32)
        rank[order] = head
        self.ranks, self.recurring, length = [rank], [], 1
        while True:
            size = np.bincount(head, minlength=n)[head]
            held = size > 1
            order, head = order[held], head[held]
            self.recurring.append((order, head, size[held]))
            if not len(order):
                break
            # A recurring factor has no separator in it, so the symbol after it exists.
            key = head.astype(np.int64) * n + rank[order + length]
            by = np.argsort(key, kind="stable")
            group = _heads(key[by])
            order, old = order[by], head[by]
            head = old + group - _heads(old)
            rank = rank.copy()
            rank[order] = head
            self.ranks.append(rank)
            length *= 2

    def suffix_array(self) -> np.ndarray:
        out = np.empty(len(self.ranks[-1]), np.int32)
        out[self.ranks[-1]] = np.arange(len(out))
        return out

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and from j > i on."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            step = np.where(self.ranks[k][i] == self.ranks[k][j], 1 << k, 0)
            i, j, out = i + step, j + step, out + step
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols before i and before j > i."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            fits = i >= 1 << k
            step = np.where(fits & (self.ranks[k][np.where(fits, i - (1 << k), 0)] == self.ranks[k][np.where(fits, j - (1 << k), 1)]), 1 << k, 0)
            i, j, out = i - step, j - step, out + step
        return out


class WaveletTree:
    """Positions in suffix order, one level per bit; a query follows the interval [low, high) down the levels."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for bit in range(bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each interval are smaller than x < 2^bits."""
        out = np.zeros(len(x), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[low], zeros[high]
            one = (x >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value with ``nth`` smaller ones in its interval; with ``below(x)`` the smallest value not below x."""
        out = np.zeros(len(nth), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1)):
            a, b = zeros[low], zeros[high]
            one = nth >= b - a
            out |= one.astype(np.int64) << bit
            nth = np.where(one, nth - (b - a), nth)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out


def _progressions(f: Factors, i: np.ndarray, first: np.ndarray, step: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (position, period) from ``n`` >= 3 occurrences first, first + step, ... of the block at i.

    The block lies in a maximal stretch [s1, e1) of period ``step``, the occurrences in [s2, e2). If these are one, every
    period but the first is a multiple of ``step``. Otherwise a run of period q that goes on beyond e1 has q = e2 - e1, one that
    begins before s1 has q = s2 - s1, and one that does neither is held by both stretches, which must meet.
    """
    s1, e1 = i - f.left(i, i + step), i + step + f.right(i, i + step)
    s2, e2 = first - f.left(first, first + step), first + step + f.right(first, first + step)
    low, other = first - i, s1 != s2
    places, periods = [i], [low]
    for q in (e2 - e1, s2 - s1):
        ok = other & (q >= low) & (q <= low + (n - 1) * step) & ((q - low) % step == 0)
        places.append(i[ok])
        periods.append(q[ok])
    most = np.minimum.reduce([low + (n - 1) * step, e1 - s1, e2 - s2, (e2 - s1) // 2])
    many = np.where(other & (s2 <= e1) & (most >= low), (most - low) // step + 1, 0)
    at = np.repeat(np.arange(len(i)), many)
    k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return np.concatenate([*places, i[at]]), np.concatenate([*periods, low[at] + k * step[at]])


def find_runs(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of at least ``least`` >= 12 symbols, by start and end; separators as for ``Factors``."""
    none = np.zeros(0, np.int64)
    f = Factors(symbols)
    if len(f.recurring) < 3 or not len(f.recurring[2][0]):
        return none, none, none
    # Only factors of four and more symbols are asked for, so only suffixes that begin with a recurring one go in the tree.
    n, wanted = len(symbols), np.zeros(len(symbols), bool)
    wanted[f.recurring[2][0]] = True
    suffixes = f.suffix_array()
    place = np.concatenate([[0], np.cumsum(wanted[suffixes])])
    tree = WaveletTree(suffixes[wanted[suffixes]], int(n).bit_length())
    places, periods = [], []
    for k, (at, rank, size) in enumerate(f.recurring[2:], 2):
        b = 1 << k
        aligned = at % (2 if k == 2 else b) == 0
        i, low, high = at[aligned].astype(np.int64), place[rank[aligned]], place[rank[aligned] + size[aligned]]
        for a, z in [(1, 5), (5, 9), (9, 13), (13, 15)] if k == 2 else [(2 * b - 1, 3 * b - 1), (3 * b - 1, 4 * b - 1)]:
            before = tree.below(low, high, np.minimum(i + a, n))
            met = tree.below(low, high, np.minimum(i + z, n)) - before
            some = met > 0
            j, lo, hi, nth, m = i[some], low[some], high[some], before[some], met[some]
            first = tree.successor(lo, hi, nth)
            two = m >= 2
            second = np.zeros(len(j), np.int64)
            second[two] = tree.successor(lo[two], hi[two], nth[two] + 1)
            few, many = m == 2, m >= 3
            more = _progressions(f, j[many], first[many], second[many] - first[many], m[many])
            places += [j[~many], j[few], more[0]]
            periods += [(first - j)[~many], (second - j)[few], more[1]]
    i, q = np.concatenate(places), np.concatenate(periods)
    start, end = i - f.left(i, i + q), i + q + f.right(i, i + q)
    ok = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[ok], end[ok], q[ok]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], q[new]


def _searched(texts: list[bytes | None], least: int) -> tuple[list[int], pa.Array, list[bytes]]:
    """Per text: number of words, runs, and the text without what runs repeat."""
    words = [t.split() if t else [] for t in texts]
    number = defaultdict(count().__next__)
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    # Text k begins at offsets[k]; a separator, smaller than all words and found once, stands before it and at the end.
    offsets = np.cumsum(sizes + 1) - sizes
    symbols = np.empty(len(flat) + len(words) + 1, np.int64)
    symbols[np.append(offsets - 1, len(symbols) - 1)] = -1 - np.arange(len(words) + 1)
    own = np.repeat(np.arange(len(words)), sizes)
    symbols[np.arange(len(flat)) + own + 1] = flat + own * len(number)
    start, end, period = find_runs(symbols, least)
    text = np.searchsorted(offsets, start, side="right") - 1
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    kept = np.cumsum(cover)[:-1] == 0
    touched = set(text.tolist())
    collapsed = [b" ".join(compress(w, kept[o:o + len(w)].tolist()) if k in touched else w) for k, (w, o) in enumerate(zip(words, offsets.tolist()))]
    order = np.lexsort((period, start))
    start, end, period, text = start[order], end[order], period[order], text[order]
    runs = pa.StructArray.from_arrays([pa.array(start - offsets[text]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
    ends = np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32)
    return sizes.tolist(), pa.ListArray.from_arrays(pa.array(ends), runs), collapsed


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, ``runs`` (start and length in words, period; by start, then period), and ``collapsed``: the
    words that no run repeats after its first period, joined by one space."""
    if least < LEAST:
        raise ValueError(f"blocks of four words find runs of {LEAST} and more words")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            block = np.cumsum(size) // BATCH
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(size)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    n_words, runs, collapsed = _searched(batch.column(1).slice(a, b - a).to_pylist(), least)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), runs, pa.array(collapsed, pa.binary())],
                                                     names=["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each tenth document, by a hash of its id, made periodic from one of its words on: h = crc32(id), g = h // 10, and where
    h % 10 = 0 word i >= a = g % n becomes word a + (i - a) % p with p = 1 + (n - a) // (3 + g % 8). NULL ids stay as they are."""
    h = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.floor(F.lit(1) + (n - a) / (3 + g % 8)).cast("int")
        there = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, there(i))), " ")).otherwise("")

    value = F.when(h % 10 == 0, let(words_of(F.col(f"`{text}`").cast("string")), rewritten)).otherwise(F.col(f"`{text}`").cast("string"))
    return docs.withColumn(text, value)


def summary(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one and digests of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    rows = found.withColumn("_top", top)
    length, period = F.col("_top.l"), -F.col("_top.p")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.s")).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
