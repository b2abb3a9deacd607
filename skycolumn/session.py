"""Session settings and lineage cuts."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skycolumn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, safe from lost executors.

    Unlike a recomputed plan the result has a known size, so later joins are planned from it.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), f"step-{uuid.uuid4().hex}")
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


# tables of the open scopes, the innermost last
_scopes: list[list[str]] = []


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``cut_lineage`` wrote inside; results must have been stored or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


@contextlib.contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """A written copy of a table that is deleted at the end."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"staged-{uuid.uuid4().hex}")
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_path(spark, path)
