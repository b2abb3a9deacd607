"""A cell store of versions: days are written beside what is there and become visible by one rename.

``<path>/data/version=.../radar=.../date=...`` holds the rows, ``<path>/manifests/<version>`` which version of each (radar, date)
belongs to the store after that version, ``<path>/status`` what became of every day of every commit, and ``<path>/current`` the
name of the version that readers see. A reader resolves that name once, so it never sees a part of a commit; a commit that fails
leaves it as it was. Days that break a rule are not written: they are listed with the reason, and the day's former rows stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycolumn.session import cut_lineage
from skycolumn.sources.store import PARTITION

KEYS = ("radar", "time", "range")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers see; None for a store without a commit."""
    place, files = _file_system(spark, f"{path}/current")
    return spark.read.text(f"{path}/current").first()[0] if files.exists(place) else None


def _switch(spark: SparkSession, path: str, version: str) -> None:
    """Readers see ``version`` from here on: a new file takes the place of the old one in one step."""
    jvm = spark._jvm
    fresh, files = _file_system(spark, f"{path}/current.{version}")
    out = files.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(place), how)


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """(radar, date, version) of the days of the store, now or after an earlier version."""
    version = version or current_version(spark, path)
    return spark.read.parquet(f"{path}/manifests/{version}") if version else None


def read_versions(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The store's rows, now or as of an earlier version. The manifest, a row per day, prunes the partitions."""
    days = manifest(spark, path, version)
    if days is None:
        raise ValueError(f"no version in {path}")
    rows = spark.read.parquet(f"{path}/data")
    text = {c: F.col(c).cast("string") for c in (*PARTITION, "version")}
    return rows.withColumns(text).join(days.withColumns(text), [*PARTITION, "version"], "left_semi").drop("version").withColumn("date", F.col("date").cast("date"))


def commit_days(new: DataFrame, path: str, rules: Mapping[str, Column] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replaces the days (radar, date of ``time``) that ``new`` holds; returns their status: radar, date, rows, reason (NULL: committed).

    ``rules`` are {reason: condition of a bad row}; rows without a key and keys that occur twice are bad by themselves. A day with a bad row
    fails, the others are committed together.
    """
    spark = new.sparkSession
    before = current_version(spark, path)
    version = f"v{int(before[1:]) + 1 if before else 1:09d}"
    dated = new.withColumn("date", F.to_date("time"))
    missing = F.lit(False)
    for k in (*keys, "radar"):
        missing = missing | F.col(k).isNull()
    bad = {"key missing": missing, **(rules or {})}
    counted = dated.groupBy(*dict.fromkeys([*PARTITION, *keys])).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_bad{i}") for i, c in enumerate(bad.values())])
    days = counted.groupBy(*PARTITION).agg(F.sum("_n").alias("rows"), F.max("_n").alias("_most"), *[F.sum(f"_bad{i}").alias(f"_bad{i}") for i in range(len(bad))])
    reason = F.coalesce(*[F.when(F.col(f"_bad{i}") > 0, F.lit(name)) for i, name in enumerate(bad)], F.when(F.col("_most") > 1, F.lit("key twice")))
    status = cut_lineage(days.select(*PARTITION, "rows", reason.alias("reason")))
    good = status.filter("reason IS NULL").select(*PARTITION)
    (dated.join(good, list(PARTITION), "left_semi").hint("rebalance", *PARTITION)
     .write.mode("overwrite").partitionBy(*PARTITION).parquet(f"{path}/data/version={version}"))
    after = good.withColumn("version", F.lit(version))
    if before:
        after = manifest(spark, path, before).join(good, list(PARTITION), "left_anti").unionByName(after)
    after.write.mode("overwrite").parquet(f"{path}/manifests/{version}")
    status.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/status")
    _switch(spark, path, version)
    return status


def update_days(new: DataFrame, path: str, columns: Sequence[str], rules: Mapping[str, Column] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replaces ``columns`` where ``new`` has a value; the days of ``new`` that break no rule are committed, the others keep their former rows.
    Days that the store does not have are left out. Status as for ``commit_days``."""
    spark = new.sparkSession
    touched = new.select("radar", F.to_date("time").alias("date")).distinct()
    old = read_versions(spark, path).join(touched, list(PARTITION), "left_semi")
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    merged = old.join(fresh, list(keys), "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    return commit_days(merged.drop("date", *[f"_new_{c}" for c in columns]), path, rules, keys)


def failed_days(spark: SparkSession, path: str) -> DataFrame:
    """(radar, date, version, reason) of the days whose last attempt failed: what is to be run again."""
    last = spark.read.parquet(f"{path}/status").groupBy(*PARTITION).agg(F.max_by(F.struct("version", "reason"), "version").alias("s"))
    return last.select(*PARTITION, "s.version", "s.reason").filter("reason IS NOT NULL")


def only_failed(new: DataFrame, path: str) -> DataFrame:
    """The rows of ``new`` that belong to days whose last attempt failed."""
    failed = failed_days(new.sparkSession, path).select(*PARTITION)
    return new.withColumn("date", F.to_date("time")).join(failed, list(PARTITION), "left_semi").drop("date")
