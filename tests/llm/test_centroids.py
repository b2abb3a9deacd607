"""Clusters against plain integer k-means, pruning that keeps ties, and defined cases."""

import hashlib
import math

import numpy as np

from skycolumn.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k, rounds, dimension):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == dimension and all(v is not None and abs(v) < 2**19 for v in x)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in kept[:k]]
    far = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for step in range(rounds + 1):
        best = [far(x) for _, x in kept]
        if step < rounds:
            for j in range(len(c)):
                own = [x for (_, x), b in zip(kept, best) if b[1] == j]
                if own:
                    c[j] = [sum(v) // len(own) for v in zip(*own)]
    return sorted(((i, b[1], b[0]) for (i, _), b in zip(kept, best)), key=repr), c


def test_against_plain(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((12, 6))
    x = (middle[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 6))).round(2)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(i, rows[i - 900][1]) for i in range(900, 950)] + [(5, rows[5][1]), (None, rows[7][1])]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [float("nan")] + [1.0] * 5), (2004, [None] + [1.0] * 5), (2005, [float("inf")] * 6), (2006, [1e30] * 6)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + odd], SCHEMA)
    for k, rounds in [(15, 5), (1, 2), (2, 0), (4, 3)]:
        got, c = centroids.clusters(docs, k=k, rounds=rounds, dimension=6)
        want, wanted = plain(rows, k, rounds, 6)
        assert c.tolist() == wanted
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    full = {r.vec_id: r for r in centroids.summary(*centroids.clusters(docs, k=15, dimension=6)).collect()}
    want, c = plain(rows, 15, 5, 6)
    for i, j, d in want:
        r = full[i]
        assert (r.cluster, r.distance, r.inertia) == (j, d, sum(w[2] for w in want))
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == j)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()


def test_ties_go_to_the_smaller_number():
    c = np.array([[0, 0], [4, 0], [2, 2], [2, -2], [100, 100]], np.int64)
    x = np.array([[2, 0], [2, 0], [3, 1], [50, 50]], np.int64)
    n = len(x)
    first, second = np.array([3, 2, 4, 0], np.int32), np.array([4, 3, 2, 1], np.int32)
    centroids.assign(x, centroids.Neighbours(c), first, second, np.full(n, np.inf), np.full(n, -np.inf))
    square = ((x[:, None] - c) ** 2).sum(2)
    assert first.tolist() == square.argmin(1).tolist()


def test_bounds_save_work():
    rng = np.random.default_rng(8)
    c = (rng.standard_normal((40, 64)) * 2000).astype(np.int64)
    x = c[rng.integers(0, 40, 4000)] + (rng.standard_normal((4000, 64)) * 100).astype(np.int64)
    state = [np.zeros(4000, np.int32), np.ones(4000, np.int32), np.full(4000, np.inf), np.full(4000, -np.inf)]
    near = centroids.Neighbours(c)
    assert centroids.assign(x, near, *state) <= 4000 * 40
    assert (state[0] == ((x[:, None] - c) ** 2).sum(2).argmin(1)).all()
    assert centroids.assign(x, near, *state) == 0  # nothing moved


def test_few_and_none(spark):
    got, c = centroids.clusters(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and centroids.summary(got, c).collect() == []
    docs = spark.createDataFrame([(1, [0.5] * 64, ""), (1, [0.5] * 64, ""), (2, [1.0] * 64, "")], SCHEMA)
    got, c = centroids.clusters(docs)
    assert len(c) == 3 and sorted(r.distance for r in got.collect()) == [0, 0, 0]
    assert len({r.cluster for r in got.collect() if r.vec_id == 1}) == 1
