"""Tables of n-grams as rows of packed columns: few rows, each with many entries of one shard, that Spark deals out by shard.

An entry has a 64-bit key. The shard of a key is a range of its leading bits, its slice one of its trailing bits, so that entries
sorted by key are sorted by shard. Columns are packed by kind (``KINDS``): differences of sorted keys, small numbers in planes
of bytes, repeated words through the words of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROW = "slice int, shard int, late int, lang string, kind int, tally array<long>, data binary"
_SCHEMA = pa.schema([("slice", pa.int32()), ("shard", pa.int32()), ("late", pa.int32()), ("lang", pa.string()), ("kind", pa.int32()), ("tally", pa.list_(pa.int64())), ("data", pa.binary())])
# By kind the columns: d sorted 64-bit numbers, w words, i counts, I large counts, f and F numbers of 32 and 64 bits, h hashes of 32 bits, s
# short numbers.
TRIPLES, FOLLOWED, CONTEXTS, PAIRS, PAIRED, BEFORE, WORD, PAIR, TALLY, ASKED_PAIRS, ASKED_WORDS = range(11)
KINDS = {TRIPLES: "wwwi", FOLLOWED: "wwhiiii", CONTEXTS: "diiiI", PAIRS: "wwi", PAIRED: "wwiiiiI", BEFORE: "wiiiI", WORD: "dF", PAIR: "dff", ASKED_PAIRS: "dihs", ASKED_WORDS: "dis"}
_TYPES = {"d": np.uint64, "w": np.int64, "i": np.uint32, "I": np.uint64, "f": np.float32, "F": np.float64, "h": np.uint32, "s": np.uint16}


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(raw: bytes, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n), at + n * size


def press(kind: int, columns: list[np.ndarray]) -> bytes:
    import zstandard

    out = []
    for code, x in zip(KINDS[kind], columns):
        x = np.asarray(x).astype(_TYPES[code], copy=False)
        out.append(np.array([len(x)], np.int64).tobytes())
        if code == "w":
            words, x = np.unique(x, return_inverse=True)
            out += [np.array([len(words)], np.int64).tobytes(), _planes(np.diff(words.view(np.uint64), prepend=np.uint64(0))), _planes(x.astype(np.uint32))]
        else:
            out.append(_planes(np.diff(x, prepend=np.uint64(0)) if code == "d" else x))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def opened(kind: int, data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for code in KINDS[kind]:
        n, at = int(np.frombuffer(raw, np.int64, 1, at)[0]), at + 8
        if code == "w":
            m, at = int(np.frombuffer(raw, np.int64, 1, at)[0]), at + 8
            words, at = _unplanes(raw, at, m, np.uint64)
            codes, at = _unplanes(raw, at, n, np.uint32)
            x = np.cumsum(words, dtype=np.uint64).view(np.int64)[codes]
        else:
            x, at = _unplanes(raw, at, n, _TYPES[code])
            x = np.cumsum(x, dtype=np.uint64) if code == "d" else x
        out.append(x)
    return out


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def slice_of(key: np.ndarray, slices: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFF)) * np.uint64(slices)) >> np.uint64(16)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def deal(lang: str, kind: int, key: np.ndarray, columns: list[np.ndarray], shards: int, slices: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows by slice and shard of the keys, each sorted by key."""
    part = slice_of(key, slices)
    for s in range(slices):
        mine = np.flatnonzero(part == s) if slices > 1 else np.arange(len(key))
        mine = mine[np.argsort(key[mine], kind="stable")]
        ends = np.searchsorted(shard_of(key[mine], shards), np.arange(shards + 1, dtype=np.uint64)).tolist()
        rows = [(s, k, 0, lang, kind, None, press(kind, [c[mine[a:b]] for c in columns])) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        for k in range(0, len(rows), 64):
            yield batch(rows[k:k + 64])


def tally(lang: str, n: np.ndarray) -> pa.RecordBatch:
    """How many of these counts are 1, 2, 3 and 4."""
    return batch([(0, 0, 0, lang, TALLY, np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist(), None)])


Tables = dict[int, list[np.ndarray]]


def columns_of(rows: list[tuple[int, bytes]]) -> Tables:
    held: dict[int, list[list[np.ndarray]]] = {}
    for kind, data in rows:
        held.setdefault(kind, []).append(opened(kind, data))
    empty = {k: [np.zeros(0, _TYPES[c]) for c in codes] for k, codes in KINDS.items()}
    return empty | {k: [np.concatenate(c) for c in zip(*parts)] for k, parts in held.items()}


def exchange(rows: DataFrame, shards: int, fn: Callable[[str, Tables], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Packed rows dealt out by shard; ``fn`` gets the entries of one shard and language and gives packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for shard, lang, kind, data in zip(b.column("shard").to_pylist(), b.column("lang").to_pylist(), b.column("kind").to_pylist(), b.column("data")):
                if at != (shard, lang):
                    if held:
                        yield from fn(at[1], columns_of(held))
                    held, at = [], (shard, lang)
                held.append((kind, data.as_py()))
        if held:
            yield from fn(at[1], columns_of(held))

    return dealt_out(rows, shards).mapInArrow(run, ROW)


def dealt_out(rows: DataFrame, shards: int) -> DataFrame:
    """A partition has whole shards, the rows that come late after the others."""
    return rows.repartition(2 * shards, "shard").sortWithinPartitions("shard", "late", "lang")
