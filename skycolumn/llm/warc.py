"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is three records: the response (or a revisit of an equal payload), the request and a metadata record; the
last two name the first in WARC-Concurrent-To. ``write_archives`` builds records with DataFrame functions and writes
them with Spark's own writer, as gzip-compressed archives of about ``ARCHIVE_BYTES``, into a folder that all executors share; ``read_records``
parses the archives by Content-Length, so payloads may hold any bytes of text; ``transactions`` joins the records of a capture through the
identifiers into one nested row.

Of captures with equal payloads of at least ``LEAST`` bytes the one with the largest page id is the response; the
others are revisits that carry headers only and refer to it. Payload size and digest stand in the headers; for responses they are
computed again from the bytes read.

Defined cases: NULL payloads are empty, NULL urls become the empty target. Rows that repeat are captures of their own;
if the largest page id of a payload repeats, one of its rows is the response. A NULL page id is smaller than any other
(and reads back as NULL). An empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycolumn.session import checkpoint_dir, cut_lineage

LEAST = 1000
# Bytes of payload per archive, on average.
ARCHIVE_BYTES = 16 << 20
DATE = "2026-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, id_: Column, headers: list[tuple[str, Column]], block: Column, media: str) -> Column:
    """A record without the two line ends that close it; headers that are NULL are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), id_), F.lit(f"WARC-Date: {DATE}"), F.lit(f"Content-Type: {media}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def _urn(*parts: Column) -> Column:
    """A record id from a hash of its parts, in the shape of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"),
                    F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes every page's capture into archives below ``path``."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), payload.alias("html"),
                        F.monotonically_increasing_id().alias("number"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Written once, so that the numbers that identify captures are final.
    rows = cut_lineage(rows)
    large = rows.filter(F.col("bytes") >= LEAST).select("page_id", "number", "digest")
    first = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("page_id"), F.col("number"))
    shared = (large.groupBy("digest").agg(F.max(first).alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select(F.col("digest").alias("d"), F.col("w.number").alias("winner")))
    volume = rows.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    per_file = 3 * max(1, ARCHIVE_BYTES * volume["n"] // max(1, volume["b"] or 0))
    roles = cut_lineage(large.join(shared, large["digest"] == F.col("d")).filter("number <> winner").select("number", "winner"))
    captures = rows.join(roles, "number", "left")
    # The run's own name keeps ids of different runs apart.
    run = F.lit(uuid.uuid4().hex)
    own, origin = _urn(run, F.col("number")), F.when(F.col("winner").isNotNull(), _urn(run, F.col("winner")))
    revisit = F.col("winner").isNotNull()
    # A line end in a target would end its header.
    target = F.regexp_replace("url", "[\\x00-\\x20]+", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    uri, digest = ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    path_of = F.regexp_replace(target, "^[a-zA-Z]+://[^/]*", "")
    host_of = F.regexp_extract(target, "^[a-zA-Z]+://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(path_of.startswith("/"), path_of).otherwise(F.concat(F.lit("/"), path_of)), F.lit(" HTTP/1.1\r\nHost: "), host_of, F.lit(CRLF + CRLF))
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(CRLF))
    records = F.array(
        F.when(revisit, _record("revisit", own, [uri, digest, ("WARC-Refers-To", origin), ("WARC-Profile", F.lit(PROFILE))], http, "application/http;msgtype=response"))
        .otherwise(_record("response", own, [uri, digest], F.concat(http, F.col("html")), "application/http;msgtype=response")),
        _record("request", _urn(run, F.col("number"), F.lit("q")), [uri, ("WARC-Concurrent-To", own)], request, "application/http;msgtype=request"),
        _record("metadata", _urn(run, F.col("number"), F.lit("m")), [uri, ("WARC-Concurrent-To", own)], fields, "application/warc-fields"))
    (captures.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


_FIELDS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "target": "WARC-Target-URI", "concurrent_to": "WARC-Concurrent-To", "refers_to": "WARC-Refers-To",
           "digest": "WARC-Payload-Digest"}
RECORD = "type string, record_id string, target string, concurrent_to string, refers_to string, digest string, head string, bytes long, payload binary, intact boolean"


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split(CRLF)[1:])
        begin = end + 4
        at = begin + int(head["Content-Length"])
        yield head, data[begin:at]
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += 4


def _records(with_payload: bool):
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.bool_()]

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, payload, size, intact = block, None, None, None
        if head["WARC-Type"] in ("response", "revisit"):
            cut = block.index(b"\r\n\r\n") + 4
            http, payload = block[:cut], block[cut:]
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            if head["WARC-Type"] == "response":
                intact = size == len(payload) and head["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        return (*[head.get(h) for h in _FIELDS.values()], http.decode("utf-8"), size, payload if with_payload else None, intact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                data, held = file.as_py(), []
                for head, block in _parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    held.append(row(head, block))
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; ``intact`` tells for responses whether size and digest agree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_records(with_payload), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: response, request and metadata structs, the page id and the page it refers to."""
    part = lambda kind, *fields: records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("id"), F.struct(*fields).alias(kind))
    captures = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("id"), F.struct("type", "record_id", "target", "refers_to", F.substring("digest", 6, 40).alias("digest"), "head", "bytes", "payload", "intact").alias("response"))
    joined = (captures.join(part("request", "record_id", "target", "head"), "id", "left").join(part("metadata", "record_id", "head"), "id", "left")
              .withColumn("page_id", F.regexp_extract("metadata.head", "pageId: (-?\\d+)", 1)))
    joined = joined.withColumn("page_id", F.when(F.col("page_id") != "", F.col("page_id").cast("long")))
    origins = joined.filter(F.col("response.type") == "response").select(F.col("id").alias("_origin"), F.col("page_id").alias("refers_to_page"))
    return joined.join(origins, F.col("response.refers_to") == F.col("_origin"), "left").select("id", "page_id", "response", "request", "metadata", "refers_to_page")


def round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Writes ``pages`` to archives, reads them back and returns the digest row of each capture."""
    spark = pages.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, **columns)
    captures = transactions(cut_lineage(read_records(spark, path, with_payload=False)))
    broken = F.when(~F.coalesce(F.col("response.intact"), F.lit(True)), F.raise_error(F.lit("a payload does not match its digest")).cast("string"))
    return captures.select("page_id", F.col("response.bytes").alias("payload_bytes"), F.coalesce(broken, F.col("response.digest")).alias("payload_digest"),
                           F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
