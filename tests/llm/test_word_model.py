"""The word model: units, a plain model, other scripts, word order, long texts."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from skycolumn.llm import perplexity, word_model
from skycolumn.session import checkpoint_dir
from skycolumn.llm.word_model import CODE_POINTS, SPELLING, WORDS


def spelled(text):
    return [text[a:a + n] for a, n in zip(*map(np.ndarray.tolist, word_model.units(text)[:2]))]


def plain_model(seen, order, base):
    """Interpolated modified Kneser-Ney of n-gram counts from its definition; the probability of a tuple."""
    levels, current = {}, seen
    for k in range(order, 0, -1):
        levels[k] = current
        current = Counter(g[1:] for g in current)
    discounts, contexts = {}, {}
    for k, counts in levels.items():
        t = [sum(v == j for v in counts.values()) for j in (1, 2, 3, 4)]
        ratio = lambda a, b: a / b if b else None
        y = ratio(t[0], t[0] + 2 * t[1])

        def one(start, j, high, other):
            r = ratio(t[j], t[j - 1])
            return other if y is None or r is None else min(max(start - (start + 1) * y * r, 0.05), high)

        discounts[k] = [one(1, 1, 1.0, 0.5), one(2, 2, 2.0, 1.0), one(3, 3, 3.0, 1.5)]
        contexts[k] = defaultdict(list)
        for g, v in counts.items():
            contexts[k][g[:-1]].append(v)

    def p(g, k=order):
        if not k:
            return base(g)
        tail = g[-k:]
        below, off = contexts[k].get(tail[:-1]), lambda v: discounts[k][min(v, 3) - 1]
        if not below:
            return p(g, k - 1)
        v = levels[k].get(tail, 0)
        return ((v - off(v)) if v else 0) / sum(below) + sum(map(off, below)) / sum(below) * p(g, k - 1)

    return p


def windows(seq, n, start, end):
    seq = [start] * (n - 1) + list(seq) + [end]
    return [tuple(seq[i:i + n]) for i in range(len(seq) - n + 1)]


def test_units():
    assert spelled("Ab cd42, é́x\n你好  мир ") == ["Ab", "cd", "42", ",", "é́x", "\n", "你", "好", "мир"]
    ids = word_model.units("мир рим мир")[2]
    assert ids[0] == ids[2] != ids[1]
    assert len(word_model.units("  \t")[2]) == 0


def test_model(spark):
    rng = random.Random(1)
    words = ["мир", "of", "the", "水", "shore", ",", "7"]
    trusted = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)]
    asked = [*trusted[:3], "the unseen рим of 氵 shore , 8", "q" * 3000, "of"]
    docs = spark.createDataFrame([(i, i, "=en", t) for i, t in enumerate(asked + trusted)], "id long, mark long, lang string, text string")
    got = {r.id: (r.surprise, r.n) for r in word_model.score(docs, docs.filter(f"id >= {len(asked)}").select("lang", "text"), 1000).collect()}
    types = {w for t in trusted for w in spelled(t)} | {""}
    letters = plain_model(Counter(g for w in types for g in windows(w, SPELLING, "", "\0")), SPELLING, lambda g: 1 / CODE_POINTS)
    log_base = lambda g: sum(math.log(letters(x)) for x in windows(g[-1], SPELLING, "", "\0"))
    whole = plain_model(Counter(g for t in trusted for g in windows(spelled(t), WORDS, "", "")), WORDS, lambda g: math.exp(log_base(g)))
    for i, t in enumerate(asked):
        assert got[i][1] == len(t) + 1
        if len(t) < 3000:
            assert got[i][0] == pytest.approx(-sum(math.log(whole(g)) for g in windows(spelled(t), WORDS, "", "")), rel=1e-6)
    assert got[4][0] > 3000 and math.isfinite(got[4][0])


@pytest.mark.parametrize("alphabet", ["абвгдежзиклмнопрсту", "αβγδεζηθικλμν"])
def test_letter_garbage_in_other_scripts(spark, monkeypatch, alphabet):
    monkeypatch.setattr(perplexity, "LEAST", 2000)
    rng = random.Random(2)
    words = ["".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(30, 80))), "xx") for i in range(300)]
    # the same lengths of words and sentences, other letters
    rows += [(1000 + i, " ".join("".join(rng.choices(alphabet, k=len(w))) for w in rows[i][1].split()), "xx") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.id: r.kept for r in perplexity.judge(docs, spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")).collect()}
    assert all(kept[i] for i in range(300))
    assert not any(kept[1000 + i] for i in range(20))


def test_word_order(spark):
    rng = random.Random(3)
    phrases = ["the long river bends below an old stone bridge", "every winter birds cross that narrow grey strait", "people carry bread home before evening bells ring"]
    text = lambda: " . ".join(rng.choices(phrases, k=12))
    trusted = [text() for _ in range(60)]
    good = [text() for _ in range(10)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in good]
    docs = spark.createDataFrame([(i, i, "=en", t) for i, t in enumerate(good + mixed)] + [(100 + i, i, "=en", t) for i, t in enumerate(trusted)], "id long, mark long, lang string, text string")
    got = {r.id: r.surprise / r.n for r in word_model.score(docs, docs.filter("id >= 100").select("lang", "text"), 1000).collect()}
    assert min(got[10 + i] for i in range(10)) > 3 * max(got[i] for i in range(10))


def test_long_texts_are_cut_at_spaces(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcм", k=rng.randint(1, 9))) for _ in range(500))
    whole = word_model.padded(text)
    monkeypatch.setattr(word_model, "CHUNK", 100)
    assert word_model.padded(text).tolist() == whole.tolist()


def test_steps_on_disk_are_small(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1200)]
    docs = spark.createDataFrame([(i, i, "=en", t) for i, t in enumerate(texts)], "id long, mark long, lang string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs, sizes, write = spark.read.parquet(str(tmp_path / "docs")), [], word_model.written
    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))

    def measured(*args, **more):
        out = write(*args, **more)
        top = checkpoint_dir(spark).removeprefix("file:")
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for x in set(os.listdir(top)) - before for d, _, names in os.walk(os.path.join(top, x)) for f in names))
        return out

    monkeypatch.setattr(word_model, "written", measured)
    assert word_model.score(docs, docs.filter("id % 5 = 0").select("lang", "text"), sum(map(len, texts))).count() == len(texts)
    # Most triples of such texts are unique; the rows of the texts that are not trusted are never written.
    assert max(sizes) < 2 * sum(map(len, texts))


def test_model_of_all_languages(spark):
    trusted = ["the shore of the mill", "мир и вода", "the mill of the shore ."]
    rows = [(i, i, lang, t) for i, (lang, t) in enumerate(zip(["=a", "=b", "=a"], trusted))] + [(9, 9, "=*", "the вода of мир unseen")]
    docs = spark.createDataFrame(rows, "id long, mark long, lang string, text string")
    got = {r.id: r.surprise for r in word_model.score(docs, docs.filter("id < 9").select("lang", "text"), 1000).collect()}
    types = {w for t in trusted for w in spelled(t)} | {""}
    letters = plain_model(Counter(g for w in types for g in windows(w, SPELLING, "", "\0")), SPELLING, lambda g: 1 / CODE_POINTS)
    base = lambda g: math.exp(sum(math.log(letters(x)) for x in windows(g[-1], SPELLING, "", "\0")))
    whole = plain_model(Counter(g for t in trusted for g in windows(spelled(t), WORDS, "", "")), WORDS, base)
    assert got[9] == pytest.approx(-sum(math.log(whole(g)) for g in windows(spelled(rows[-1][3]), WORDS, "", "")), rel=1e-6)
