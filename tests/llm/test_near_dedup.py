"""Groups against all pairs, the signature's estimate, and defined cases."""

import random
import re

import numpy as np
import pytest

from skycolumn.llm import near_dedup
from skycolumn.llm.components import connected_components
from skycolumn.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, size):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def plain_groups(rows, size):
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, plain_set(t, size)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i in parent}


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(40)]
    base = " ".join(word() for _ in range(100)).split()
    for n in range(500):  # a family larger than a chunk, many members far from each other
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [texts[3]] * 30 + [texts[4].upper(), None, "", " \n", "Only three words", "only THREE words", "one", "one", "x " * 400, "x " * 500]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    return rows + [(5, texts[0]), (5, texts[9]), (5, texts[9]), (None, texts[0])]


@pytest.mark.parametrize("size", [4, 5])
def test_against_all_pairs(spark, size):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component int, rep string")
    got = near_dedup.similarity_groups(docs, size=size).collect()
    want = plain_groups(rows, size)
    # an id that repeats joins the groups of its texts
    repeated = min(want[5], want[1000], want[991])
    want = {i: repeated if want[i] in (want[5], want[1000], want[991]) else w for i, w in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    left = near_dedup.keep_one(docs, size=size)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_near_copies_of_every_text_of_an_id(spark):
    rng = random.Random(11)
    prose = lambda: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(120)]
    near = lambda words: " ".join([*words[:-1], "other"])
    a, b, c = prose(), prose(), prose()
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, near(a)), (9, near(b)), (10, " ".join(c)), (3, near(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (docs, docs.orderBy("text"), docs.orderBy(docs.text.desc())):
        got = {r.doc_id: r.component_id for r in near_dedup.similarity_groups(order, size=4).collect()}
        assert got == {7: 7, 8: 7, 9: 7, 10: 3, 3: 3}
    assert len({tuple(sorted(r.text for r in near_dedup.keep_one(o).collect())) for o in (docs, docs.orderBy("text"), docs.repartition(5))}) == 1


def test_empty(spark):
    assert near_dedup.similarity_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate():
    rng = np.random.default_rng(1)
    for common in (0, 50, 150, 300):
        errors = []
        for _ in range(20):
            items = rng.integers(0, 1 << 63, 600 - common, dtype=np.uint64)
            a, b = items[:300], items[300 - common:]
            s = near_dedup.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - common / (600 - common))
        assert abs(np.mean(errors)) < 0.03


def test_signature_is_the_plain_rule():
    """Step by step as the definition has it, element by element, without early stop."""
    from skycolumn.llm.shingles import mix

    items, m = np.array([3, 99, 12345678901], dtype=np.uint64), near_dedup.PLACES
    best = [None] * m
    for x in items:
        order = list(range(m))
        for step in range(m):
            draw = int(mix(np.array([x + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], dtype=np.uint64))[0])
            k = step + ((draw >> 32) * (m - step) >> 32)
            order[step], order[k] = order[k], order[step]
            value = step << 32 | draw & 0xFFFFFFFF
            if best[order[step]] is None or value < best[order[step]]:
                best[order[step]] = value
    assert near_dedup.signatures([items])[0].tolist() == best


def test_words_of_long_texts():
    text = ("ab " * 600_000 + "x" * 3_000_000 + " cd" * 10).encode()
    starts, hashes = word_hashes(text)
    assert len(starts) == 600_011 and len(set(hashes.tolist())) == 3
    assert len(shingle_sets([text.decode()], 4)[0]) == 6


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200 + i, 200) for i in range(1, 50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges + [(7, 7), (None, 3)], "a long, b long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {i: find(i) for i in parent if find(i) != i}
