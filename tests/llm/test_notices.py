"""Phrases against a plain scan, notices against edit distances of all places, and defined cases."""

import random
import re

from skycolumn.llm import notices

SCHEMA = "doc_id long, text string, places int, labels string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words, out = WORD.findall(lower(text)), []
    for phrase, label in notices.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        i = rng.randrange(1, len(out) - 1)
        if out[i].isdigit() or out[i] == " ":
            continue
        how = rng.randrange(3)
        if how == 0:
            out[i] = rng.choice("abcxyz")
        elif how == 1:
            out[i] = ""
        else:
            out[i] += rng.choice("abcxyz")
        out = list("".join(out))
    return "".join(out)


def test_pieces():
    for notice, _ in notices.NOTICES:
        k = notices.edits_for(notice)
        parts = notices.pieces(notice, k)
        assert len(parts) == k + 1 and "".join(p for _, p in parts) == notice
        assert all(notice[a:a + len(p)] == p and len(p) >= 6 for a, p in parts)


def test_phrases_everywhere(spark):
    rng = random.Random(2)
    texts = ["Released under the MIT License.", "under the mit license under the mit license", "UNDER THE MIT-LICENSE!under_the_mit_license", "under the mit licenses", "xunder the mit license",
             "Apache License, Version 2.0", "apache license version 20", "CC BY-NC 4.0 and cc-by-nc; cc by-nc-cc-by-nc", "cc by ünc", "É under the mit licenseÉ", None, "", " \n", "...",
             "under\x00the\x7fmit license", " under the mit license", "W " * 50_000 + "cc by nc " * 3]
    for _ in range(100):
        texts.append(" ".join(rng.choice(["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "Ü"]) for _ in range(rng.randint(0, 60))))
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(0, texts[0], 1, ""), (None, texts[0], None, None)]
    got = notices.summary(notices.find_notices(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    for r in got:
        n, want = base(texts[r.doc_id or 0])
        assert (r.n_words, r.n_base) == (n, len(want))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in want}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1
        assert r.score == 1 or not want


def test_edited_notices():
    rng, scanner = random.Random(4), notices.Scanner(notices.PHRASES, notices.NOTICES)
    filler = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(0, 30)))
    for number, (notice, label) in enumerate(notices.NOTICES * 4):
        k = rng.randint(0, notices.edits_for(notice))
        said = edited(rng, notice, k)
        before = filler()
        text = f"{before} {said} {filler()}"
        n, places = notices.scan(scanner, text.encode())
        assert n == len(text.split())
        near = [p for p in places if not p[4]]
        # Another notice may be nearer to what the edits left; what is found is a true place with its true number of edits.
        assert any(p[1] <= len(before.split()) + len(said.split()) and p[2] >= len(before.split()) for p in near), (said, places)
        for name, first, last, edits, _, score, stands in near:
            assert " ".join(text.split()[first:last + 1]) == stands
            length = [len(x) for x, y in notices.NOTICES if y == name and distance(x, stands) <= edits]
            assert length and edits <= notices.MOST_EDITS and 0 < score <= 1
        if k == 0:
            assert label in {p[0] for p in near} and max(p[5] for p in near) == 1


def test_numbers_stand():
    scanner = notices.Scanner(notices.PHRASES, notices.NOTICES)
    labels = lambda text: [p[0] for p in notices.scan(scanner, text.encode())[1]]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("licenced under the GNU Generel Public License version 2") == ["gpl-2"]
    assert labels("licensed under the Apache Licence, version 1.1") == []
    assert labels("licensed under the Apache Licence, version 2.0") == ["apache-2"]
    assert labels("Licensed under CC BY-SA 4.0.") == ["cc-by-sa"]
    assert sorted(set(labels("Licensed under CC BY-NC 4.0."))) == ["cc-by-nc"]
    assert labels("we walked under the old bridge to the mill, license in hand, and all rights were reserved") == []


def test_many_seeds():
    """A text of nothing but seeds stays linear."""
    scanner = notices.Scanner(notices.PHRASES, notices.NOTICES)
    n, places = notices.scan(scanner, b"licensed under the gnu " * 3000)
    assert n == 12_000 and places == []
    n, places = notices.scan(scanner, b"licensed under the mit license " * 3000)
    assert sum(p[4] for p in places) == 3000 and sum(not p[4] for p in places) == 3000


def test_empty(spark):
    assert notices.find_notices(spark.createDataFrame([], SCHEMA)).collect() == []
