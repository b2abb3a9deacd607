"""Runs against all periods of small texts, periodic and Fibonacci words, planted documents, and defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from skycolumn.llm import periodic_runs

SCHEMA = "doc_id long, text string, runs int, collapsed string"


def plain(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(w, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(str(x) for i, x in enumerate(w) if i not in dropped)


def repetitive(rng):
    k, n, w = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 11, 12, 13, 30, 80, 200]), []
    while len(w) < n:
        block = [rng.randrange(k) for _ in range(rng.randint(1, rng.choice([3, 20, 60])))]
        if rng.random() < 0.4 and w:
            a = rng.randrange(len(w))
            block = w[a:a + rng.randint(1, 40)]
        w += block * rng.randint(1, 5)
    return w[:n]


def test_against_all_periods():
    rng = random.Random(1)
    for _ in range(60):
        docs = [repetitive(rng) for _ in range(10)]
        sizes, runs, kept = periodic_runs._searched([" ".join(map(str, d)).encode() for d in docs], 12)
        for d, n, r, c in zip(docs, sizes, runs.to_pylist(), kept):
            want = plain(d)
            assert n == len(d)
            assert [tuple(x.values()) for x in r] == sorted(want, key=lambda x: (x[0], x[2]))
            assert c.decode() == collapsed(d, want)


@pytest.mark.parametrize("word", ["fibonacci", "equal", "thue"])
def test_known_words(word):
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    w = {"fibonacci": b, "equal": [0] * 900, "thue": [bin(i).count("1") % 2 for i in range(900)]}[word]
    _, runs, _ = periodic_runs._searched([" ".join(map(str, w)).encode()], 12)
    got = [tuple(x.values()) for x in runs.to_pylist()[0]]
    assert got == sorted(plain(w), key=lambda x: (x[0], x[2]))
    assert word != "equal" or got == [(0, 900, 1)]
    assert word != "thue" or all(n == 2 * q for _, n, q in got)  # free of overlaps


def test_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(200).astype(np.int32)
    tree = periodic_runs.WaveletTree(values, 8)
    low = rng.integers(0, 200, 300)
    high = np.minimum(low + rng.integers(1, 60, 300), 200)
    x = rng.integers(0, 200, 300)
    below = tree.below(low, high, x)
    assert below.tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(low, high, x)]
    some = below < high - low
    got = tree.successor(low[some], high[some], below[some])
    assert got.tolist() == [int(min(v for v in values[a:b] if v >= c)) for a, b, c in zip(low[some], high[some], x[some])]


def planted_words(key, words):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_documents(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in repetitive(rng)) for _ in range(150)]
    texts += [None, "", " \n\t", "a", "é ü x\x0by\x0cz " * 9, "  b " * 20, "long " + " ".join(str(rng.randrange(10**6)) for _ in range(40_000)), texts[3]]
    rows = [(i, t, 7, "clash") for i, t in enumerate(texts)] + [(3, texts[3], 7, "clash"), (None, "x y " * 10, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = periodic_runs.summary(periodic_runs.repeated_runs(periodic_runs.planted(docs))).collect()
    assert len(got) == len(rows)
    want = {}
    for key, text, *_ in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in (words if key is None else planted_words(key, words))]
        runs = [] if len(words) > 30_000 else sorted(plain(words), key=lambda x: (x[0], x[2]))
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[key] = (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(collapsed(words, runs).encode()).hexdigest(), len(words))
    assert sum(w[0] > 0 for w in want.values()) > 40
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_empty_and_bounds(spark):
    assert periodic_runs.repeated_runs(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.repeated_runs(spark.createDataFrame([], SCHEMA), least=8)
    none = periodic_runs._searched([], 12)
    assert none[0] == [] and len(none[1]) == 0
