"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors collapse to the smallest id with a number of copies.
2. The mean of all unit vectors is taken off before projecting, so that signs split a cloud that lies to one side of the
   origin. A pass draws ``BITS`` random hyperplanes. The signs, concatenated, order the vectors lexicographically; one range
   partitioned sort orders all passes at once. Each vector is compared with its next ``WINDOW`` neighbours; the rows at the ends of a
   partition also meet the ends of the next one. A task returns the verified pairs that its union-find joined, and how many leading signs
   vectors ``WINDOW`` apart share where they are not linked themselves.
   The number of passes follows from that: a pair at the threshold shares so many signs with the probability agreement^signs, and
   the passes make the chance to miss it in all of them ``MISS``. A first round of passes, planned for evenly spread vectors, measures
   the signs (their upper decile, for dense places); where they are more, further passes follow.
3. The pairs are united across passes (connected components). The window bounds how many neighbours a pass compares, not how many links
   a vector may have: inside each component every pair is then compared exactly, in pairs of
   chunks of bounded size spread over tasks, and only counts leave a task.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components have no links; vectors of
different length have none with each other. Rows with a NULL id have no links, a NULL component, and are kept. Rows
that repeat an id are separate vectors of one vertex. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycolumn.llm.components import connected_components
from skycolumn.llm.near_dedup import Forest
from skycolumn.session import cut_lineage

BITS = 62
WINDOW = 256
MISS = 1e-4
BLOCK = 1024
CHUNK_LEAST, CHUNK_MOST = 128, 2048
# Vectors (times passes) that one task of the sort gets.
ROWS_PER_TASK = 200_000


# Part of the vectors' mean squared distance from their mean that a pair is taken to have, and the share of places whose signs count.
NEARER, PLACES = 0.8, 0.9


def passes_for(n: int, threshold: float, window: int = WINDOW, miss: float = MISS, spread: float = 1.0, signs: float | None = None) -> int:
    """Passes after which a pair at the threshold is missed with probability ``miss`` at most (at least 8).

    ``spread``: mean squared distance of the unit vectors from their mean; ``signs``: leading signs that vectors ``window`` apart share,
    log2(n / window) if they are spread evenly.
    """
    # the angle between two vectors of squared length r seen from the mean, 2 (1 - threshold) apart
    r = NEARER * spread if spread < 1 else 1.0
    agree = 1 - math.acos(max(0.0, 1 - (1 - threshold) / r) if r else 0.0) / math.pi
    signs = math.log2(max(2.0, n / window)) if signs is None else signs
    once = agree ** max(1.0, signs)
    return max(8, math.ceil(math.log(miss) / math.log1p(-once)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, n, total): number and sum of the unit vectors of each length, per batch."""
    for batch in batches:
        blobs = batch.column(0).to_pylist()
        sizes = np.array([len(b) for b in blobs])
        for size in np.unique(sizes).tolist():
            unit = _unit([blobs[i] for i in np.flatnonzero(sizes == size)])
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([len(unit)], pa.int64()), pa.array([unit.sum(0).tolist()], pa.list_(pa.float64()))], names=["size", "n", "total"])


def _means(numbered: DataFrame) -> tuple[dict[int, np.ndarray], float]:
    """The mean unit vector of each length, and the mean squared distance from it: sums of the dimension, which the driver holds."""
    parts = numbered.select("v").mapInArrow(_sums, "size int, n long, total array<double>")
    rows = parts.select("size", "n", F.posexplode("total").alias("i", "x")).groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    means: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for r in rows:
        means.setdefault(r["size"], np.zeros(r["size"] // 8))[r["i"]] = r["x"] / r["n"]
        counts[r["size"]] = r["n"]
    total = sum(counts.values())
    return means, 1 - sum(counts[k] * float(m @ m) for k, m in means.items()) / total if total else 1.0


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v): the components as little-endian doubles scaled by a power of two, NULL for vectors without links."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = None if v is None or any(c is None for c in v) else np.asarray(v, dtype="<f8")
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                out.append(None)
            else:  # so that squares neither overflow nor vanish; exact unless components are subnormal
                out.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])


def _keys(passes: range, seed: int, means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            sizes = np.array([len(b) for b in blobs])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                moved, ids = _unit([blobs[i] for i in at]) - means[size], batch.column(0).take(pa.array(at))
                vectors = batch.column(1).take(pa.array(at))
                for k in passes:
                    if (size, k) not in planes:
                        planes[size, k] = np.random.default_rng([seed, size, k]).standard_normal((size // 8, BITS))
                    key = (moved @ planes[size, k] > 0) @ weights
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(key), ids, vectors],
                                                     names=["pass", "size", "key", "id", "v"])

    return run


def _near(group: list[tuple], window: int, threshold: float, edges: list, first: int = 0, shared: np.ndarray | None = None) -> None:
    """Links between rows of ``group`` (pass, size, id, v, key) at most ``window`` apart; pairs wholly before ``first`` are known.
    ``shared`` counts the leading signs that unlinked rows ``window`` apart have in common."""
    runs, start = [], 0
    for i in range(1, len(group) + 1):
        if i == len(group) or group[i][:2] != group[start][:2]:
            runs.append((start, i))
            start = i
    for a, b in runs:
        if b - a < 2 or b <= first:
            continue
        unit = _unit([r[3] for r in group[a:b]])
        linked = unit @ unit.T >= threshold
        if shared is not None and b - a > window:
            far = np.flatnonzero(~np.diagonal(linked, window))
            keys = np.array([r[4] for r in group[a:b]], np.int64)
            differ = keys[far] ^ keys[far + window]
            # the position of the first sign that differs, exact: the upper and the lower half fit a double
            upper, lower = differ >> 31, differ & 0x7FFFFFFF
            length = np.where(upper > 0, 31 + np.frexp(upper.astype(np.float64))[1], np.frexp(lower.astype(np.float64))[1])
            shared += np.bincount(BITS - length, minlength=BITS + 1)
        near = np.argwhere(np.triu(np.tril(linked, window), 1))
        forest = Forest(b - a)
        for i, j in near.tolist():
            if a + j >= first and forest.join(i, j):
                edges.append((group[a + i][2], group[a + j][2]))


def _window(window: int, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bound", pa.int32()), ("at", pa.int32()), ("pass", pa.int32()), ("size", pa.int32()), ("v", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        held: list[tuple] = []
        new, seen, shared = 0, 0, np.zeros(BITS + 1, np.int64)
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 2)]):
                if seen < window:
                    yield batch_of([(row[2], None, me - 1, window + seen, row[0], row[1], row[3])])
                held.append(row)
                new, seen = new + 1, seen + 1
                if new == BLOCK:
                    edges: list = []
                    _near(held, window, threshold, edges, len(held) - new, shared)
                    yield batch_of([(a, b, None, None, None, None, None) for a, b in edges])
                    held, new = held[-window:], 0
        edges = []
        _near(held, window, threshold, edges, len(held) - new, shared)
        yield batch_of([(a, b, None, None, None, None, None) for a, b in edges])
        # counts of shared signs: rows of a pass that is none
        yield batch_of([(i, n, None, None, -1, None, None) for i, n in enumerate(shared.tolist()) if n])
        last = held[-window:]
        yield batch_of([(r[2], None, me, i - len(last) + window, r[0], r[1], r[3]) for i, r in enumerate(last)])

    return run


def _across(window: int, threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", kind="stable")
        rows = list(zip(group["pass"], group["size"], group["a"], group["v"], group["at"]))
        edges: list = []
        _near(rows, window, threshold, edges)
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


def _count(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        low, high = group["lo"].iloc[0], group["hi"].iloc[0]
        parts = []
        for _, same in group.groupby(group["v"].str.len()):  # vectors of one length
            left, right = same[same["chunk"] == low], same[same["chunk"] == high]
            if not len(left) or not len(right):
                continue
            x, y = _unit(left["v"].tolist()), _unit(right["v"].tolist())
            linked = x @ y.T >= threshold
            if low == high:
                np.fill_diagonal(linked, False)
            parts.append(pd.DataFrame({"id": left["id"].to_numpy(), "links": linked @ right["copies"].to_numpy()}))
            if low != high:
                parts.append(pd.DataFrame({"id": right["id"].to_numpy(), "links": left["copies"].to_numpy() @ linked}))
        return pd.concat(parts).astype("int64") if parts else pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})

    return run


def _decile(counts: dict[int, int]) -> float:
    """Signs that all but the densest places share at most; where nothing is unlinked there is nothing to miss."""
    left = (1 - PLACES) * sum(counts.values())
    for signs in sorted(counts, reverse=True):
        left -= counts[signs]
        if left < 0:
            return float(signs)
    return 1.0


def similar_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95,
                    window: int = WINDOW, passes: int | None = None, seed: int = 1) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable), kept (it is that id)."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    encoded = cut_lineage(rows.mapInArrow(_encode, "vec_id long, v binary"))
    distinct = cut_lineage(encoded.filter("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("v")
                           .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("vec_id").alias("_last")))
    n = distinct.count()
    # The vertex of a vector is its smallest id; ids that repeat with several vectors join them.
    ids = encoded.filter("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id")
    same_id = (encoded.join(ids, "vec_id", "left_semi").join(distinct.select("v", "rep"), "v")
               .select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    numbered = distinct.select(F.col("rep").alias("id"), "v")
    means, spread = _means(numbered)

    def compared(numbers: range) -> DataFrame:
        tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(numbers) / ROWS_PER_TASK))
        ordered = (numbered.mapInArrow(_keys(numbers, seed, means), "pass int, size int, key long, id long, v binary")
                   .withColumn("tie", F.xxhash64("id", "pass")))
        order = ["pass", "size", "key", "tie", "id"]
        ordered = ordered.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("pass", "size", "key", "id", "v")
        return cut_lineage(ordered.mapInArrow(_window(window, threshold), "a long, b long, bound int, at int, pass int, size int, v binary"))

    def links_of(found: DataFrame) -> DataFrame:
        across = found.filter("bound IS NOT NULL").groupBy("bound").applyInPandas(_across(window, threshold), "a long, b long")
        return found.filter("bound IS NULL AND pass IS NULL").select("a", "b").unionByName(across)

    first = passes or passes_for(n, threshold, window, spread=spread)
    found = compared(range(first))
    links = links_of(found).unionByName(same_id)
    if passes is None:
        counts = {r["a"]: r["n"] for r in found.filter("pass = -1 AND bound IS NULL").groupBy("a").agg(F.sum("b").alias("n")).collect()}
        needed = passes_for(n, threshold, window, spread=spread, signs=_decile(counts))
        if needed > first:
            links = links.unionByName(links_of(compared(range(first, needed))))
    joined = connected_components(links)
    members = joined.unionByName(joined.select(F.col("component").alias("id"), "component").distinct())
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wide = F.least(F.lit(CHUNK_MOST), F.greatest(F.lit(CHUNK_LEAST), F.ceil(F.col("n") / 16)))
    sized = sized.select("component", F.ceil(F.col("n") / wide).cast("int").alias("chunks"))
    placed = (members.join(sized, "component")
              .withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    dealt = (distinct.select(F.col("rep").alias("id"), "v", "copies").join(placed, "id")
             .select("id", "v", "copies", "component", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")))
    counts = (dealt.groupBy("component", "lo", "hi").applyInPandas(_count(threshold), "id long, links long")
              .groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")))
    by_vector = (distinct.join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
                 .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
                 .withColumn("component_id", F.coalesce("component", "rep"))
                 .filter("n_links > 0 OR component_id < rep").select("v", "n_links", "component_id"))
    known = F.col("vec_id").isNotNull()
    return (encoded.join(by_vector, "v", "left")
            .select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
                    F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
