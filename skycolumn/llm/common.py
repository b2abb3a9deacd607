"""Helpers that several operators of this folder share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycolumn.session import checkpoint_dir

ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, by: str | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """A table written to the shared folder, and what deletes it once its last reader is done.

    Spark removes the files of a shuffle when the driver's collector finds that nothing refers to it. A driver that only starts jobs
    seldom collects, so it is asked to, also before the step: the listeners may have let go of the last one since.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"step-{uuid.uuid4().hex}")
    spark._jvm.System.gc()
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    spark._jvm.System.gc()

    def delete() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), delete


def null_safe(column: Column) -> Column:
    """A text key that is never NULL; NULL and the empty text stay different."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside ``body`` it is a bound variable."""
    return F.transform(F.array(value), body)[0]


def slices(texts: Iterable[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` characters, at least one text each."""
    start, size, i = 0, 0, -1
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if i >= start:
        yield start, i + 1
