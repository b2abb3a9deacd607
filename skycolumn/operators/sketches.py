"""Approximate quantiles as stored sketches.

A KLL sketch of the values of one key and period is a small binary column. Sketches merge without loss of their guarantee, so
days are sketched once, written, and merged into any longer period without reading the values again. The error is one of ranks: the quantile
returned for p is an exact quantile of some p' with |p' - p| <= ``rank_error(k)`` (with 99 % confidence), whatever the values are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycolumn.operators.ordered import floor_div

K = 400


def rank_error(k: int = K) -> float:
    """Normalised rank error of one quantile with 99 % confidence (fixed values: the published fit for this sketch)."""
    return 2.296 / k**0.9021


def period_sketches(df: DataFrame, keys: Sequence[str], t: str, value: str, period: int, k: int = K) -> DataFrame:
    """One row per key and period with a value: keys, ``t`` (start of the period), ``sketch``, n, min, max. NULL and NaN are left out."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = F.col(value).cast("double")
    start = (floor_div(F.col(t), period) * period).alias(t)
    return known.groupBy(*keys, start).agg(F.kll_sketch_agg_double(v, k).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))


def write_sketches(sketches: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Adds to a store of sketches; later periods are written beside earlier ones. A period that is there already must not be written again."""
    sketches.write.mode("append").partitionBy(*by).parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """One sketch per key of all its periods; merged on the map side first, so a key may have any number of them."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))


def sketch_quantiles(sketches: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Adds a column per quantile; the sketch stays."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in probs.items()})


def rank_errors(df: DataFrame, quantiles: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Per key and quantile, how far the exact rank of the sketched value is from the one asked for, as a share of the values.

    ``quantiles`` has one row per key. A value that occurs more than once has a range of ranks; its nearest end counts.
    """
    v = F.col(value).cast("double")
    known = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")).join(quantiles.select(*keys, *probs), list(keys))
    aggs: list[Column] = [F.count(F.lit(1)).cast("double").alias("_n")]
    for name in probs:
        aggs += [F.count_if(F.col("_v") < F.col(name)).alias(f"_a_{name}"), F.count_if(F.col("_v") <= F.col(name)).alias(f"_b_{name}")]
    ranks = known.groupBy(*keys).agg(*aggs)
    error = lambda name, p: F.greatest(F.col(f"_a_{name}") / F.col("_n") - p, p - F.col(f"_b_{name}") / F.col("_n"), F.lit(0.0))
    return ranks.select(*keys, *[error(name, float(p)).alias(name) for name, p in probs.items()])
