"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals for every context limit.

Documents are encoded (ids and an end id) and only the number of documents of each length is shuffled, summed before
the shuffle. Sums over lengths are taken in two levels: within ranges of ``RANGE`` lengths and over the ranges, so no task
holds the whole histogram.

Defined cases: NULL and empty texts have length 1 (the end id). Rows that repeat count each. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skycolumn.llm.encode import encode_rows
from skycolumn.session import cut_lineage

RANGE = 1024


def encoded_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return encode_rows(docs, doc_id, text, lambda key, ids: [(key, len(ids) // 4 + 1)], "doc_id any, n_tokens long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per distinct length L: docs and tokens at L, at or above L, total with every document cut at L, share of
    tokens kept at that limit, and the share of documents of at most L (its quantile)."""
    counted = lengths.groupBy(F.col(length).alias("context")).agg(F.count(F.lit(1)).alias("n_docs"))
    counted = cut_lineage(counted.withColumn("n_tokens", F.col("context") * F.col("n_docs")).withColumn("_range", F.floor(F.col("context") / RANGE)))
    ranges = counted.groupBy("_range").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    later = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{c}").over(later), F.lit(0)).alias(f"_later_{c}") for c in ("docs", "tokens")],
                           *[F.sum(f"_{c}").over(every).alias(f"_all_{c}") for c in ("docs", "tokens")])
    inside = Window.partitionBy("_range").orderBy(F.col("context").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = counted.join(ranges, "_range")
    for c in ("docs", "tokens"):
        out = out.withColumn(f"{c}_from", F.sum(f"n_{c}").over(inside) + F.col(f"_later_{c}"))
    truncated = F.col("_all_tokens") - F.col("tokens_from") + F.col("context") * F.col("docs_from")
    return out.select("context", "n_docs", "n_tokens", "docs_from", "tokens_from", truncated.alias("truncated_tokens"),
                      (truncated / F.col("_all_tokens")).alias("kept_share"),
                      ((F.col("_all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("_all_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, truncated_tokens) for any limits, from the nearest length at or above each."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "`limit` long")
    total = F.sum("n_tokens")
    rows = histogram.select("context", "n_docs", "n_tokens").withColumn("limit", F.explode(F.array(*[F.lit(int(x)) for x in limits])))
    cut = F.sum(F.least("context", "limit") * F.col("n_docs"))
    over = F.sum(F.when(F.col("context") > F.col("limit"), F.col("n_docs")).otherwise(0))
    return asked.join(rows.groupBy("limit").agg(over.alias("docs_over"), cut.alias("truncated_tokens"), total.alias("n_tokens")), "limit", "left")
