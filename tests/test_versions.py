"""Commits of days: a day that fails on purpose, readers of earlier versions, re-runs of what failed."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from skycolumn.sources import versions

SCHEMA = "radar string, time timestamp_ntz, range double, z double"


def day(radar, d, z, n=3):
    return [(radar, dt.datetime(2024, 11, d, h), 25.0 * g, z + g) for h in (0, 23) for g in range(n)]


def contents(df):
    return {(r["radar"], r["date"].day): (r["n"], r["z"]) for r in df.groupBy("radar", "date").agg(F.count("*").alias("n"), F.sum("z").alias("z")).collect()}


def test_one_day_fails(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert versions.current_version(spark, path) is None
    with pytest.raises(ValueError):
        versions.read_versions(spark, path)
    versions.commit_days(frame(day("a", 1, 0.0) + day("a", 2, 0.0) + day("b", 1, 5.0)), path)
    first = contents(versions.read_versions(spark, path))
    assert first == {("a", 1): (6, 6.0), ("a", 2): (6, 6.0), ("b", 1): (6, 36.0)}
    rules = {"too strong": F.col("z") > 100}
    new = frame(day("a", 1, 10.0) + day("a", 2, 99.0) + day("c", 3, 1.0) + [("b", dt.datetime(2024, 11, 1), 0.0, 1.0)] * 2)
    status = {(r["radar"], r["date"].day): (r["rows"], r["reason"]) for r in versions.commit_days(new, path, rules).collect()}
    assert status == {("a", 1): (6, None), ("a", 2): (6, "too strong"), ("c", 3): (6, None), ("b", 1): (2, "key twice")}
    second = contents(versions.read_versions(spark, path))
    assert second == {**first, ("a", 1): (6, 66.0), ("c", 3): (6, 12.0)}
    assert contents(versions.read_versions(spark, path, "v000000001")) == first
    failed = {(r["radar"], r["date"].day) for r in versions.failed_days(spark, path).collect()}
    assert failed == {("a", 2), ("b", 1)}
    again = versions.only_failed(frame(day("a", 1, -1.0) + day("a", 2, 2.0)), path)
    assert again.count() == 6
    versions.commit_days(again, path, rules)
    assert contents(versions.read_versions(spark, path)) == {**second, ("a", 2): (6, 18.0)}
    assert [(r["radar"], r["reason"]) for r in versions.failed_days(spark, path).collect()] == [("b", "key twice")]


def test_update_and_a_failed_commit(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    versions.commit_days(frame(day("a", 1, 0.0) + day("a", 2, 0.0)), path)
    new = frame([("a", dt.datetime(2024, 11, 1), 25.0, 7.0), ("a", dt.datetime(2024, 11, 2), 25.0, None), ("z", dt.datetime(2024, 11, 9), 0.0, 1.0)])
    versions.update_days(new, path, ["z"])
    kept = contents(versions.read_versions(spark, path))
    assert kept == {("a", 1): (6, 12.0), ("a", 2): (6, 6.0)}
    broken = frame(day("a", 1, 50.0)).withColumn("z", F.when(F.col("z") > 51, F.raise_error(F.lit("unreadable")).cast("double")).otherwise(F.col("z")))
    with pytest.raises(Exception, match="unreadable"):
        versions.commit_days(broken, path, {"never": F.col("z") > 10**6})
    assert contents(versions.read_versions(spark, path)) == kept
    assert not [f for f in os.listdir(path) if f.startswith("current.")]


def test_rows_without_key(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = day("a", 1, 0.0) + [(None, dt.datetime(2024, 11, 1), 0.0, 1.0)] + [("a", dt.datetime(2024, 11, 2), None, 1.0)]
    status = versions.commit_days(spark.createDataFrame(rows, SCHEMA), path)
    assert {(r["radar"], r["reason"]) for r in status.collect()} == {("a", None), (None, "key missing"), ("a", "key missing")}
    assert contents(versions.read_versions(spark, path)) == {("a", 1): (6, 6.0)}
