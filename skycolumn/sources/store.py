"""The cell store: Parquet partitioned by radar and date, rewritten by region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycolumn.functions.scalar import missing_to_null
from skycolumn.specs import VariableSpec, store_schema

PARTITION = ("radar", "date")


def _write(df: DataFrame, path: str) -> None:
    """Replace exactly the partitions that ``df`` holds; running it again gives the same store.

    Rows are rebalanced by (radar, date): Spark gathers small days and splits crowded ones by size.
    """
    (df.hint("rebalance", *PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITION).parquet(path))


def conform(df: DataFrame, specs: Sequence[VariableSpec]) -> DataFrame:
    """Keys and known variables only, in store order; missing ones are NULL, NaN becomes NULL."""
    out = []
    for f in store_schema(specs):
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.dataType.typeName() == "double" and f.name != "range":
            out.append(missing_to_null(F.col(f.name).cast("double"), float("inf")).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def upsert_region(df: DataFrame, path: str, specs: Sequence[VariableSpec]) -> None:
    """Rewrite the days in ``df``; unknown variables are dropped, other days stay."""
    _write(conform(df, specs).withColumn("date", F.to_date("time")), path)


def read_cells(spark: SparkSession, path: str, radar: str | None = None, start: str | None = None,
               end: str | None = None, pad_minutes: int = 10) -> DataFrame:
    """Cells of a padded time window; the date bounds prune partitions, the time bounds row groups."""
    df = spark.read.parquet(path)
    if radar is not None:
        df = df.filter(F.col("radar") == radar)
    pad = F.expr(f"INTERVAL {int(pad_minutes)} MINUTE")
    if start is not None:
        low = F.lit(start).cast("timestamp_ntz") - pad
        df = df.filter((F.col("date") >= low.cast("date")) & (F.col("time") >= low))
    if end is not None:
        high = F.lit(end).cast("timestamp_ntz") + pad
        df = df.filter((F.col("date") <= high.cast("date")) & (F.col("time") <= high))
    return df


def touched_days(store: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of the given (radar, date) partitions; the first and the last date prune what is read, the join is exact."""
    ends = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return store.filter(F.col("date").between(F.lit(ends["a"]).cast("date"), F.lit(ends["b"]).cast("date"))).join(days, list(PARTITION), "left_semi")


def update_columns(spark: SparkSession, new: DataFrame, path: str, columns: Sequence[str], staging: str,
                   on: Sequence[str] = ("radar", "time", "range")) -> DataFrame:
    """Replace some variables where ``new`` has a value; rewrites only the days ``new`` touches.

    The result is staged before the store's partitions are replaced, because Spark must not overwrite
    what it reads. Returns (radar, date, matched, unmatched) of the touched partitions.
    """
    dated = new.withColumn("date", F.to_date("time"))
    touched = dated.select(*PARTITION).distinct()
    old = touched_days(spark.read.parquet(path), touched)
    fresh = dated.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(fresh, list(on), "left")
    merged = joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    merged.drop("_hit", *[f"_new_{c}" for c in columns]).write.mode("overwrite").partitionBy(*PARTITION).parquet(staging)
    _write(spark.read.parquet(staging), path)
    existing = spark.read.parquet(path).select(*on, F.lit(True).alias("_there"))
    return (dated.join(existing, list(on), "left").groupBy(*PARTITION)
            .agg(F.count("_there").alias("matched"), F.count_if(F.col("_there").isNull()).alias("unmatched")))


def merge_daily(pieces: Sequence[DataFrame], extra: DataFrame | None, on: Sequence[str], path: str) -> None:
    """Hourly pieces into daily partitions, with one variable of a second product joined."""
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece, allowMissingColumns=True)
    if extra is not None:
        whole = whole.join(extra, list(on), "left")
    _write(whole.withColumn("date", F.to_date("time")), path)


def append_calibration(rows: DataFrame, path: str) -> None:
    """Append result rows as delimited text; floats with six decimals, NULL as an empty field."""
    out = [F.when(F.col(f.name).isNotNull(), F.format_string("%.6f", F.col(f.name))).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
           for f in rows.schema]
    rows.select(*out).write.mode("append").option("header", "true").option("sep", "\t").csv(path)


def column_total(table: DataFrame, column: str) -> DataFrame:
    """Sum of a text column, entries that are no number left out."""
    return table.agg(F.sum(F.col(column).try_cast("double")).alias("total"))

