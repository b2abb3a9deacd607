"""Weights against direct search, budgets, permutations and defined cases."""

import math
import random
from collections import Counter, defaultdict

import pytest

from skycolumn.llm import mixing

SCHEMA = "doc_id long, text string, source string, _tokens int"


def documents(spark):
    rng, rows = random.Random(2), []
    for s, n in (("hot", 900), ("b", 60), ("c", 25), ("d", 9), (None, 5), ("", 4)):
        rows += [(len(rows) + k, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 40))), s, 1) for k in range(n)]
    rows += [(None, None, "c", 1), (1, "", "c", 1), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, SCHEMA)


def tokens(text):
    return max(1, len((text or "").split()))


def exponent(shares, reaches):
    """The largest exponent that still reaches, to nine digits."""
    low, high = 0.0, 1.0
    if reaches(1.0):
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if reaches(mid) else (low, mid)
    return low


@pytest.mark.parametrize("budget, entropy, repeats", [(1.0, 0.97, 4.0), (1.0, 0.8, 50.0), (2.5, 0.9, 6.0), (None, 0.9, 4.0)])
def test_weights_and_budgets(spark, budget, entropy, repeats):
    rows, docs = documents(spark)
    got = mixing.mixture(docs, budget=budget, entropy=entropy, repeats=repeats, carry=["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    totals = Counter()
    for _, t, s, _ in rows:
        totals[s] += tokens(t)
    total, n = sum(totals.values()), len(totals)
    share = {s: v / total for s, v in totals.items()}
    weights = lambda a: {s: v ** a / sum(x ** a for x in share.values()) for s, v in share.items()}
    spent = lambda a: budget or max(share[s] / w for s, w in weights(a).items())
    rich = exponent(share, lambda a: -sum(w * math.log(w) for w in weights(a).values()) >= entropy * math.log(n))
    over = lambda a: max(w * spent(a) / share[s] for s, w in weights(a).items()) > max(repeats, budget or 1.0)
    least = exponent(share, over) if over(0.0) else 0.0
    a = max(rich, least)
    want = weights(a)
    taken, seen = Counter(), defaultdict(set)
    for r in got:
        s = r["_row"]["source"]
        assert r["_weight"] == pytest.approx(want[s], rel=2e-3)
        taken[s] += r["_copies"] * r["_tokens"]
        seen[s].add(r["_copies"])
    for s in totals:
        assert abs(taken[s] - want[s] * spent(a) * total) <= 45 + 3e-3 * taken[s]  # at most one document over
        assert max(seen[s]) - min(seen[s]) <= 1  # whole epochs and a part of one
    if budget is None:
        assert all(r["_copies"] >= 1 for r in got)


def test_blocks_are_taken_whole_but_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(mixing, "RANGES", 4)
    _, docs = documents(spark)
    got = mixing.mixture(docs, entropy=0.9).collect()
    blocks = defaultdict(set)
    for r in got:
        blocks[r["_source"], r["_block"]].add(r["_last"])
    for s in {s for s, _ in blocks}:
        assert sum(len(v) == 2 for (x, _), v in blocks.items() if x == s) <= 1
    assert len([b for b in blocks if b[0] == "=hot"]) > 20


def test_mix_returns_the_documents(spark):
    rows, docs = documents(spark)
    out = mixing.mix(docs, budget=None, entropy=0.9)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == set(rows)


def test_empty_and_single(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "a b", "s", 1)], SCHEMA)
    assert [r["_copies"] for r in mixing.mixture(one).collect()] == [1]
