"""Verdicts and defined cases; the model itself is tested in test_word_model."""

import math
import random

import pytest

from skycolumn.llm import perplexity

SCHEMA = "doc_id long, text string, lang string, mark int, n string"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["the", "of", "and", "ra", "tion", "ently", "shore", "under", "mellow", "quite", "river", "stone"]
    rows = [(i, prose(rng, rng.randint(3, 60), words), "en", 1, "x") for i in range(400)]
    rows += [(1000 + i, "".join(rng.choices("XZQ#$%*&", k=200)), "en", 1, "x") for i in range(10)]
    rows += [(2000, None, "en", 1, "x"), (2001, "", None, 1, "x"), (2002, prose(rng, 40, words), None, 1, "x"), (2003, prose(rng, 30, words), "rare", 1, "x"), (None, rows[0][1], "en", 1, "x"), (0, rows[0][1], "en", 1, "x")]
    return rows, list(range(0, 400, 2))


def test_judge(spark, corpus, monkeypatch):
    rows, trusted = corpus
    monkeypatch.setattr(perplexity, "LEAST", 2000)
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = perplexity.judge(docs, ids).collect()
    assert len(got) == len({(r[0], r[1]) for r in rows})
    verdict = {r.id: r.kept for r in got}
    assert all(verdict[i] for i in range(400))
    assert not any(verdict[1000 + i] for i in range(10))
    assert [verdict[i] for i in (2000, 2001, 2002, 2003, None)] == [False, False, True, True, True]
    out = perplexity.keep_fluent(docs, ids)
    assert out.columns == docs.columns and out.count() == 405 - 0 - 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert perplexity.judge(spark.createDataFrame([], SCHEMA), none).collect() == []
    got = perplexity.judge(spark.createDataFrame([(1, "some text", "en", 1, "x"), (2, None, None, 1, "x")], SCHEMA), none).collect()
    assert {r.id: r.kept for r in got} == {1: True, 2: False}


def test_sift(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id as string) AS text")
    ids = spark.range(0, 9000, 7)
    assert sorted(r.id for r in perplexity.sift(rows, ids).collect()) == list(range(0, 5000, 7))


def test_limits_are_quantiles_of_held_out_texts(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(perplexity, "LEAST", 2000)
    # Scores stand in for the model: texts of one language lie around 1.5 with noise by length, those of the other around 2.5.
    rows = []
    for i in range(3000):
        n = rng.choice([20, 80, 400, 3000, 60_000])
        lang = rng.choice(["aa", "bb"])
        rows.append((i, lang, n, (1.5 if lang == "aa" else 2.5) + rng.gauss(0, 4) * (1 / n + 1 / perplexity.STEADY) ** 0.5))
    mean = {i: m for i, _, _, m in rows}
    size = {i: n for i, _, n, _ in rows}
    docs = spark.createDataFrame([(i, "word " * 8, lang) for i, lang, _, _ in rows], "doc_id long, text string, lang string")
    table = spark.createDataFrame([(i, mean[i] * size[i], size[i]) for i in mean], "id long, surprise double, n long")
    monkeypatch.setattr(perplexity.word_model, "score", lambda d, t, c: d.select("id", "mark", "lang").join(table, "id"))
    got = {r.id: r for r in perplexity.judge(docs, spark.range(3000)).collect()}
    assert len(got) == 3000
    for lang in ("aa", "bb"):
        own = [i for i, x, _, _ in rows if x == lang]
        assert 0.97 <= sum(got[i].kept for i in own) / len(own) <= 1
        # the same share at every length
        for n in (20, 400, 60_000):
            part = [i for i in own if size[i] == n]
            assert 0.94 <= sum(got[i].kept for i in part) / len(part)
    held = {r.id for r in spark.range(3000).filter(f"pmod(xxhash64(id, 3), {perplexity.HELD_OUT}) = 0").collect()}

    def scaled(ids):
        means = sorted(mean[i] for i in ids)
        middle = means[-(-len(means) // 2) - 1]
        return middle, [(mean[i] - middle) / (1 / size[i] + 1 / perplexity.STEADY) ** 0.5 for i in ids]

    def widened(values):
        return sorted(values)[-int(-perplexity.QUANTILE * len(values) // 1) - 1] * (1 + perplexity.SURE / len(values) ** 0.5)

    each = {lang: scaled([i for i, x, _, _ in rows if x == lang and i in held]) for lang in ("aa", "bb")}
    shared = widened([z for _, values in each.values() for z in values])
    for lang in ("aa", "bb"):
        middle, values = each[lang]
        c = len(values)
        width = (c * widened(values) + perplexity.SHARED * shared) / (c + perplexity.SHARED)
        for i, x, n, m in rows:
            if x == lang:
                limit = middle + width * (1 / n + 1 / perplexity.STEADY) ** 0.5
                assert abs(limit - math.log(got[i].limit)) < 1e-9 and (abs(m - limit) < 1e-9 or got[i].kept == (m <= limit))
