"""Links and groups against all pairs, and defined cases."""

import numpy as np
import pandas as pd
import pytest

from skycolumn.llm import embedding_dedup
from skycolumn.llm.near_dedup import Forest

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    centre = rng.standard_normal(24)
    x[100:400] = centre + 0.12 * rng.standard_normal((300, 24))     # a family larger than a chunk, around the threshold
    x[400:420] = x[100]                                             # copies
    x[420:440] = x[0:20] * 3                                        # the same direction
    rows = [(2000 - i, [float(v) for v in r], 1, "z") for i, r in enumerate(x)]
    odd = [(5, None), (6, []), (7, [0.0] * 24), (8, [float("nan")] + [1.0] * 23), (9, [None] + [1.0] * 23), (10, [float("inf")] * 24), (11, [1.0, 2.0]), (12, [2.0, 4.0])]
    rows += [(i, v, None, None) for i, v in odd] + [(None, [float(v) for v in x[0]], 1, "z")]
    got = {r.vec_id: r for r in embedding_dedup.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    forest = Forest(len(x))
    ids = np.array([2000 - i for i in range(len(x))])
    for i, j in np.argwhere(linked):
        forest.join(int(i), int(j))
    root = [forest.find(i) for i in range(len(x))]
    for i in range(len(x)):
        r = got[int(ids[i])]
        assert r.n_links == linked[i].sum()
        assert r.component_id == min(ids[k] for k in range(len(x)) if root[k] == root[i])
        assert r.kept == (r.vec_id == r.component_id)
    for i in range(5, 11):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[11].n_links, got[12].component_id, got[12].kept) == (1, 11, False)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)


def test_empty(spark):
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("mean", [0.0, 0.8, 0.9])
def test_isolated_pairs_in_a_cloud(spark, mean):
    """Pairs just above the threshold that nothing else is linked with, among vectors with this mean cosine."""
    rng = np.random.default_rng(5)
    n, pairs, d = 8000, 200, 64
    side = np.zeros(d)
    side[0] = 1
    free = rng.standard_normal((n, d))
    free[:, 0] = 0
    x = np.sqrt(mean) * side + np.sqrt(1 - mean) * free / np.linalg.norm(free, axis=1)[:, None]
    for k in range(pairs):
        other = rng.standard_normal(d)
        other -= (other @ x[k]) * x[k]
        x[n - 1 - k] = 0.953 * x[k] + np.sqrt(1 - 0.953**2) * other / np.linalg.norm(other)
    linked = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    np.fill_diagonal(linked, False)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    got = {r.vec_id: r.n_links for r in embedding_dedup.similar_vectors(frame).collect()}
    want = linked.sum(1)
    assert want.sum() >= 2 * pairs and all(got[i] <= want[i] for i in range(n))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_passes():
    assert embedding_dedup.passes_for(10**6, 0.95, spread=0.2) > embedding_dedup.passes_for(10**6, 0.95)
    assert embedding_dedup.passes_for(10**6, 0.95, signs=30.0) > embedding_dedup.passes_for(10**6, 0.95, signs=10.0)
    assert embedding_dedup._decile({}) == 1.0 and embedding_dedup._decile({3: 90, 9: 11}) == 9.0 and embedding_dedup._decile({3: 95, 9: 5}) == 3.0
    assert embedding_dedup.passes_for(10**6, 0.95) > embedding_dedup.passes_for(10**4, 0.95) >= 8
