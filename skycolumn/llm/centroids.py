"""Centroid clustering (k-means) with bounds, sorted neighbour lists and shrinking search balls.

Vectors are turned into integers, floor(scale * x), so that every decision is exact. A vector carries its centroid, the number of its
second-nearest centroid, an upper bound of the distance to the first and a lower bound of the distance to all others. When
centroids have moved, the bounds move with them, and a vector keeps its centroid while the upper bound stays below the lower
one or below half the way from its centroid to the nearest other. Any other vector

* measures its centroid and the remembered second one and starts from the closer of the two;
* scans the centroids by their distance from that one, which is sorted once per round, as long as that distance is at most
  the vector's own distance from it and the second smallest known so far: nothing outside this ball can be among the two nearest.
  The ball shrinks with each better centroid;
* compares the squared distances of what was scanned as integers; equal ones go to the smaller number.

Bounds are doubles with a margin (``MARGIN``) far above their rounding, so they never decide between equal distances.

Spark deals the vectors; a task sees a batch of them and the k centroids (k times the dimension, a parameter). A round writes
vectors with their bounds to the shared folder and deletes the round before; sums per centroid leave each batch as k rows, are added by
Spark, and k rows reach the driver, which holds the centroids.

Defined cases: vectors of another dimension, NULL vectors and those with NULL or non-finite components are left out. So are components of
``limit_for`` (2^27 in 64 dimensions) and more in size, whose squared distances do not fit a LONG. With fewer than k vectors each is a
centroid. Rows that repeat are clustered each, and equal hashes start in the order of their components. NULL ids take part; their
hash is that of the text without an id. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycolumn.llm.common import written

DIMENSION = 64
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
SCALE = 256
MARGIN = 1e-9
# Distances of a block of vectors are measured at once.
BLOCK = 8192


def limit_for(dimension: int) -> float:
    """Integers below this have squared distances that fit a LONG."""
    return float(1 << int(math.log2(2.0**62 / dimension) / 2 - 1))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Neighbours:
    """Centroids with, for each, the others by distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(np.array([_squares(centroids, c) for c in centroids]).astype(np.float64))
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)


def assign(x: np.ndarray, near: Neighbours, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings ``first``, ``second``, ``upper`` and ``lower`` up to date, in place; returns how many distances were measured."""
    k, wide = len(near.centroids), 1 + MARGIN
    open_ = np.flatnonzero(upper * wide >= np.maximum(lower, near.half[first]) / wide)
    a = first[open_]
    square = _squares(x[open_], near.centroids[a])
    upper[open_] = np.sqrt(square)
    held = upper[open_] * wide < np.maximum(lower[open_], near.half[a]) / wide
    open_, a, da, measured = open_[~held], a[~held], square[~held], len(square)
    if k == 1 or not len(open_):
        return measured
    points, b = x[open_], second[open_]
    db = _squares(points, near.centroids[b])
    measured += len(open_)
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    centre, own, left = a.copy(), np.sqrt(da.astype(np.float64)), np.arange(len(open_))
    known = np.stack([a, b])
    for t in range(k - 1):
        ball = (own[left] + np.sqrt(db[left].astype(np.float64))) * wide
        left = left[near.apart[centre[left], t] <= ball]
        if not len(left):
            break
        c = near.order[centre[left], t]
        new = c != known[0, left]
        new &= c != known[1, left]
        at, c = left[new], c[new]
        d = _squares(points[at], near.centroids[c])
        measured += len(at)
        best = (d < da[at]) | ((d == da[at]) & (c < a[at]))
        next_ = ~best & ((d < db[at]) | ((d == db[at]) & (c < b[at])))
        i = at[best]
        b[i], db[i], a[i], da[i] = a[i], da[i], c[best], d[best]
        i = at[next_]
        b[i], db[i] = c[next_], d[next_]
    first[open_], second[open_] = a, b
    upper[open_], lower[open_] = np.sqrt(da.astype(np.float64)), np.sqrt(db.astype(np.float64))
    return measured


STATE = "vec_id {kind}, ints binary, cluster int, second int, upper double, lower double"


def _integers(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("ints").to_pylist()), "<i4").reshape(batch.num_rows, dimension).astype(np.int64)


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Every vector with the centroid nearest to it; ``moved``: how far each centroid went, None before the first round."""
    k, dimension = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(centroids)
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                x = _integers(batch, dimension)
                first, second = (batch.column(c).to_numpy().copy() for c in ("cluster", "second"))
                upper, lower = (batch.column(c).to_numpy().copy() for c in ("upper", "lower"))
                if moved is not None:
                    upper += moved[first]
                    # The others: the farthest move, or the second farthest for the vectors of that centroid.
                    far = np.argsort(moved)
                    lower -= np.where(first == far[-1], moved[far[-2]] if k > 1 else 0.0, moved[far[-1]])
                assign(x, near, first, second, upper, lower)
                columns = [batch.column("vec_id"), batch.column("ints"), pa.array(first), pa.array(second), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "ints", "cluster", "second", "upper", "lower"])

    return state.mapInArrow(run, STATE.format(kind=state.schema["vec_id"].dataType.simpleString()))


def _sums(state: DataFrame, dimension: int) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, sum per component), exact; at most k rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, inverse = np.unique(batch.column("cluster").to_numpy(), return_inverse=True)
                order, n = np.argsort(inverse, kind="stable"), np.bincount(inverse)
                total = np.add.reduceat(_integers(batch, dimension)[order], np.cumsum(n) - n, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(n.astype(np.int64)), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = state.select("cluster", "ints").mapInArrow(run, "cluster int, n long, total array<bigint>")
    rows = parts.select("cluster", "n", F.posexplode("total").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows.collect():
        out.setdefault(r["cluster"], (r["n"], [0] * dimension))[1][r["i"]] = int(r["v"])
    return out


def _starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, seed: str = SEED, scale: int = SCALE,
             vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """One row per vector: vec_id, cluster, distance (squared, exact); and the final centroids as integers."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    usable = (F.size(x) == dimension) & F.forall(x, lambda v: F.coalesce(F.abs(v * scale) < limit_for(dimension), F.lit(False)))
    kept = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x")).filter(F.coalesce(usable, F.lit(False)))
    vectors = kept.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("v"))
    centroids = _starts(vectors, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = batch.num_rows, batch.column("v")
            ints = v.flatten().to_numpy().astype("<i4").reshape(n, dimension)
            state = [pa.array(np.full(n, 0, np.int32)), pa.array(np.full(n, min(1, len(centroids) - 1), np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.full(n, -np.inf))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in ints], pa.binary()), *state], names=["vec_id", "ints", "cluster", "second", "upper", "lower"])

    state, moved, delete = vectors.mapInArrow(begin, STATE.format(kind=kind)), None, None
    for step in range(rounds + 1):
        state, done = written(_round(state, centroids, moved))
        if delete:
            delete()
        delete = done
        if step == rounds:
            break
        new = centroids.copy()
        for c, (n, total) in _sums(state, dimension).items():
            new[c] = [v // n for v in total]
        moved = np.sqrt(_squares(new, centroids).astype(np.float64)) * (1 + MARGIN)
        centroids = new

    final = centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            square = np.concatenate([_squares(_integers(batch.slice(a, BLOCK), dimension), final[cluster[a:a + BLOCK]]) for a in range(0, batch.num_rows, BLOCK)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(square)], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "cluster", "ints").mapInArrow(measure, f"vec_id {kind}, cluster int, distance long"), centroids


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the inertia of the cluster and of all clusters (NULL beyond a LONG) and a digest of the centroid; one row per cluster is joined."""
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(i, fits(sums.get(i, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    per = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
