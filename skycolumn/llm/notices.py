"""License scan: short notices with a few edits, found from exact seeds and verified by bounded-error matching.

Texts are lower-cased (A-Z), cut into words of letters, digits and everything beyond ASCII, and joined by single blanks.

* Phrases (``PHRASES``) count where their words stand consecutively, unchanged.
* Notices (``NOTICES``) may differ by up to k characters, k = one in ``PER_EDIT`` and at most ``MOST_EDITS``. A notice is split into k + 1 pieces: k edits
  cannot touch all of them, so one stands unchanged in every occurrence. All pieces of all notices are looked for at once by
  an Aho-Corasick automaton; a hit says where the notice would lie, give or take k characters. Overlapping windows of a notice are merged, and
  the regex library matches the notice in them with at most k errors, from one word boundary to another. Edits may not touch numbers, so that
  another version of a license is no copy of this one.
* Where accepted places of several notices overlap, those with the smaller share of edits stay, then the longer, then the first listed.

Nothing is shuffled: Spark deals the texts, and the work on a text is linear in its length and its hits.

Defined cases: NULL and empty texts have no words and no places. Rows that repeat are scanned each, NULL ids too. Bytes that are no UTF-8 are
words of their own. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_EDIT = 10
MOST_EDITS = 4
# Phrases given for the scan, as words, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Notices as licenses and their users word them, with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("distributed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("dedicated to the public domain under cc0 1 0", "cc0"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]

PLACES = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int,exact:boolean,score:double,text:string>>"
_BLANK = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_NUMBER = re.compile("[0-9]+")


def edits_for(notice: str) -> int:
    return min(MOST_EDITS, max(1, len(notice) // PER_EDIT))


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length, with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]):
        import ahocorasick
        import regex

        self.phrases, self.notices = phrases, notices
        self.limits = [edits_for(n) for n, _ in notices]
        self.patterns = [regex.compile(f"(?e)(?<= )(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}(?= )") for (n, _), k in zip(notices, self.limits)]
        self.numbers = [_NUMBER.findall(n) for n, _ in notices]
        wanted: dict[str, list[tuple[int, int]]] = {}
        for i, (phrase, _) in enumerate(phrases):
            wanted.setdefault(f" {phrase} ", []).append((-1 - i, 0))
        for i, (notice, _) in enumerate(notices):
            for offset, piece in pieces(notice, self.limits[i]):
                wanted.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in wanted.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def places(self, joined: str) -> list[tuple]:
        """(begin, end, label, edits, exact, length of the notice) in ``joined``, by begin; it begins and ends with a blank."""
        exact, windows = [], {}
        for last, (size, uses) in self.seeds.iter(joined):
            at = last + 1 - size
            for i, offset in uses:
                if i < 0:
                    exact.append((at + 1, last, self.phrases[-1 - i][1], 0, True, size - 2))
                    continue
                notice, k = self.notices[i][0], self.limits[i]
                # One more character on both sides for the blanks that a place stands between.
                a, b = max(0, at - offset - k - 1), at - offset + len(notice) + k + 1
                spans = windows.setdefault(i, [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                    spans[-1][0] = min(a, spans[-1][0])
                else:
                    spans.append([a, b])
        near = []
        for i, spans in windows.items():
            (notice, label), pattern = self.notices[i], self.patterns[i]
            for a, b in spans:
                for m in pattern.finditer(joined, a, min(b, len(joined))):
                    if _NUMBER.findall(m.group()) == self.numbers[i]:
                        near.append((m.start(), m.end(), label, sum(m.fuzzy_counts), False, len(notice), i))
        near.sort(key=lambda p: (p[3] / p[5], -p[5], p[6], p[0]))
        return sorted(exact + _apart(near), key=lambda p: (p[0], p[1], p[2]))


def _apart(near: list[tuple]) -> list[tuple]:
    """The places, in this order, that overlap none accepted before."""
    import bisect

    starts: list[int] = []
    ends: dict[int, int] = {}
    out = []
    for p in near:
        at = bisect.bisect_left(starts, p[1])
        if at and ends[starts[at - 1]] > p[0]:
            continue
        bisect.insort(starts, p[0])
        ends[p[0]] = p[1]
        out.append(p[:6])
    return out


@functools.cache
def _scanner(phrases: tuple, notices: tuple) -> Scanner:
    """One per Python worker."""
    return Scanner(list(phrases), list(notices))


def scan(scanner: Scanner, text: bytes | None) -> tuple[int, list[tuple]]:
    """Number of words, and the places as rows of ``PLACES``."""
    words = text.lower().translate(_BLANK).split() if text else []
    if not words:
        return 0, []
    joined = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    out, seen, at = [], -1, 0
    for begin, end, label, edits, exact, size in scanner.places(joined):
        seen, at = seen + joined.count(" ", at, begin), begin
        out.append((label, seen, seen + joined.count(" ", begin, end), edits, exact, 1.0 - edits / size, joined[begin:end]))
    return len(words), out


def find_notices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words and ``places``: label, first and last word, edits, whether it is a phrase, score (1 less the share
    of edited characters), and the words as they stand."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    fixed = tuple(phrases), tuple(notices)
    names = ["label", "first_word", "last_word", "edits", "exact", "score", "text"]
    kind = pa.list_(pa.struct(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.string()]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*fixed)
        for batch in batches:
            found = [scan(scanner, value.as_py()) for value in batch.column(1)]
            places = pa.array([[dict(zip(names, p)) for p in f[1]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), places], names=["doc_id", "n_words", "places"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, places {PLACES}")


def summary(found: DataFrame) -> DataFrame:
    """Per document the number and ends of the phrases, the labels of phrases and of all places, and the best score."""
    base = F.filter("places", lambda p: p["exact"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["first_word"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))
