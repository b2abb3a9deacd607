"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycolumn.llm import centroids, embedding_dedup, html_extract, length_histogram, mixing, near_dedup, notices, periodic_runs, perplexity, quality_rules, repack, token_matrix, warc
from skycolumn.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text of its language, and the verdict."""
    trusted = perplexity.trusted_of(table(spark, sf_dir, "labels"))
    judged = perplexity.judge(table(spark, sf_dir, "documents"), trusted)
    return judged.select(F.col("id").alias("doc_id"), "lang", "n_symbols", "perplexity", "limit", "kept")


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of at least 80 % common 4-word shingles."""
    return near_dedup.similarity_groups(table(spark, sf_dir, "documents"), size=4)


@query
def op3_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as packed rows of 2048 token ids."""
    return token_matrix.packed_rows(table(spark, sf_dir, "documents"))


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors linked by a cosine of at least 0.95."""
    return embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for a budget of all tokens at 97 % of the entropy of equal sources."""
    taken = mixing.mixture(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return taken.select("_row.doc_id", "_row.source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"),
                        F.col("_block").alias("block"), F.col("_whole").alias("whole_epochs"), F.col("_last").alias("in_last_epoch"), F.col("_copies").alias("copies"))


@query
def op6_repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return repack.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the robust outlier rule."""
    return quality_rules.classify(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back, with revisits of equal payloads."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op8_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
    w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM w"""


@query
def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens at each encoded length, with the totals for a context of that length."""
    return length_histogram.length_histogram(length_histogram.encoded_lengths(table(spark, sf_dir, "documents")))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of which is made periodic first."""
    return periodic_runs.summary(periodic_runs.repeated_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


# The words of a text after the planting, pairs of equal words q apart, stretches of such pairs, and of equal stretches the least q. The hash of
# an id is taken bit by bit.
ORACLES["op11_periodic_runs"] = """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, CAST(doc_id AS VARCHAR) AS k FROM documents),
    c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, range(0, 8 * length(k))), lambda h, i:
                xor(xor(h, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END) >> 1,
                    CASE WHEN xor(h, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM d),
    p AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
    t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
            list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w FROM p),
    x AS (SELECT doc_id, unnest(w) AS v, unnest(range(n)) AS i FROM t),
    e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.v = r.v AND r.i > l.i),
    s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e),
    m AS (SELECT doc_id, q, min(i) AS a, max(i) + 1 + q AS z FROM s GROUP BY doc_id, q, g HAVING max(i) + 1 + q - min(i) >= greatest(12, 2 * q)),
    r AS (SELECT doc_id, a AS start, z - a AS length, min(q) AS period FROM m GROUP BY doc_id, a, z),
    u AS (SELECT doc_id, count(*) AS n_runs, max_by({'s': start, 'l': length, 'p': period}, [length, -start, -period]) AS top,
                 sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id),
    b AS (SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.i) AS kept FROM x
          WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY x.doc_id)
    SELECT t.doc_id, coalesce(u.n_runs, 0) AS n_runs, u.top.s AS start, u.top.l AS length, u.top.p AS period, 1000 * u.top.l // u.top.p AS exponent_milli,
           coalesce(u.runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(b.kept, '')) AS collapsed_sha256, t.n AS n_words
    FROM t LEFT JOIN u USING (doc_id) LEFT JOIN b USING (doc_id)"""


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty centroids of all vectors after five rounds, in integers."""
    return centroids.summary(*centroids.clusters(table(spark, sf_dir, "embeddings")))

def _centroid_sql(rounds: int = 5, k: int = 40) -> str:
    """Every vector against every centroid, round by round; sums are divided exactly and rounded down."""
    parts = [f"""v AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) AS r, vec_id, q FROM (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
        c0 AS (SELECT r - 1 AS cluster, q AS c FROM v WHERE r <= {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT v.r, min([list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster]) AS best FROM v, c{i} c GROUP BY v.r)""")
        if i < rounds:
            parts.append(f"""u{i} AS (SELECT best[2] AS cluster, j, CAST(sum(q[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT best, q, unnest(range(1, 65)) AS j FROM a{i} JOIN v USING (r)) GROUP BY 1, 2),
        m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM u{i} GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))""")
    return f"""
    WITH {', '.join(parts)}
    SELECT v.vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
           CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.cluster = best[2]"""


ORACLES["op12_centroid_clusters"] = _centroid_sql()


@query
def op13_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and short notices with a few edits in every document."""
    return notices.summary(notices.find_notices(table(spark, sf_dir, "documents")))
