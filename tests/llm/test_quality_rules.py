"""Base statistics against a plain count, verdicts on planted texts, and defined cases."""

import random
import re
from collections import Counter

import pytest

from skycolumn.llm import quality_rules

WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, _row string"


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2)), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), len(covered)


def prose(rng, n, junk=False):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n)]
    return " ".join(w + "***" if junk else w for w in words)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(300)] + [prose(rng, 120, True) for _ in range(8)]
    texts += [None, "", " \n\t ", "a b c", "x y z x y z x", "a a a a a", "l 1\nl 1\n\nl 1", "word " * 100, "é ü b " * 20, prose(rng, 30_000), "a\x0bb\x0cc d"]
    rows = [(i, t, None if i % 50 == 0 else "en", "hot" if i % 3 else "rare", i, "clash") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return rows, docs, quality_rules.classify(docs).collect()


def test_statistics(judged):
    rows, _, got = judged
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_outliers(judged):
    _, _, got = judged
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert all(kept[i] for i in range(300))
    assert not any(kept[i] for i in range(301, 308))
    assert kept[300]  # its language is NULL, and the few texts of that group give no estimate


def test_filter_keeps_columns(judged):
    rows, docs, got = judged
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(str(r[0]) for r in out.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_empty(spark):
    assert quality_rules.classify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1, "x")], SCHEMA)
    plan = quality_rules.add_statistics(docs, "text", "_q_")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
