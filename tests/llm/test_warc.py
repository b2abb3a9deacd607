"""Exact round trip of payloads, revisits, transactions and defined cases."""

import glob
import gzip
import hashlib

import pytest

from skycolumn.llm import warc

SCHEMA = "page_id long, url string, html string, number int, digest string"


def rows():
    big, other = "<p>é" + "x" * 2000, "y" * 999
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n\r\n\r\n" + "ü\n\r" * 400
    out = [(i, f"http://h{i}.example/a?b={i}#c", big, 1, "d") for i in range(1, 40)] + [(50, "https://x.example", other, 1, "d"), (51, "https://x.example/", other, 1, "d")]
    out += [(52, None, tricky, 1, "d"), (53, "u r\nl", tricky, None, None), (54, "", None, 1, "d"), (55, "x", "", 1, "d"), (None, "http://n.example/", big, 1, "d"),
            (7, "http://h7.example/a?b=7#c", big, 1, "d"), (60, "http://z/", "z" * 5000, 1, "d"), (60, "http://z/", "z" * 5000, 1, "d"), (-3, "http://m/", "m" * 1000, 1, "d")]
    return out


def test_round_trip(spark, tmp_path):
    data = rows()
    got = warc.round_trip(spark.createDataFrame(data, SCHEMA), str(tmp_path / "w")).collect()
    raw = [(p, (h or "").encode()) for p, _, h, _, _ in data]
    top = {}
    for p, h in raw:
        if len(h) >= 1000 and p is not None:
            top[h] = max(p, top.get(h, p))
    want = []
    for p, h in raw:
        again = len(h) >= 1000 and p != top[h]
        want.append((p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    want[-3:-1] = [want[-2], (60, 5000, want[-2][2], "revisit", 60)]  # the largest id repeats: one of its rows is the response
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_payloads_and_transactions(spark, tmp_path):
    data = rows()
    warc.write_archives(spark.createDataFrame(data, SCHEMA), str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    captures = warc.transactions(records).collect()
    assert records.count() == 3 * len(data) and len(captures) == len(data)
    html = {p: (h or "").encode() for p, _, h, _, _ in data}
    for c in captures:
        assert c.request is not None and c.metadata is not None
        if c.response.type == "response":
            assert c.response.intact and bytes(c.response.payload) == html[c.page_id]
        else:
            assert c.refers_to_page is not None
    # a plain reader of the format finds the same records
    seen = 0
    for name in glob.glob(str(tmp_path / "w" / "part-*")):
        blob = gzip.open(name).read()
        while blob:
            head, _, rest = blob.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(head.rpartition(b"Content-Length: ")[2])
            assert rest[size:size + 4] == b"\r\n\r\n"
            blob, seen = rest[size + 4:], seen + 1
    assert seen == 3 * len(data)


def test_broken_archive(spark):
    with pytest.raises(ValueError):
        list(warc._parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).collect() == []
