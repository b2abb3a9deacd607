"""Transects through a field on pressure levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.operators.regrid import regrid_linear_range


def cross_section(field: DataFrame, keys: Sequence[str], level: str, axis: str, at: float, along: str,
                  height: Column, z: str, values: Sequence[str], step: float) -> DataFrame:
    """Slice at the coordinate nearest to ``at``, on heights every ``step``.

    ``height`` may use ``mean_<z>``, the mean of ``z`` over the slice of a level.
    """
    best = field.agg(F.min_by(axis, F.struct(F.abs(F.col(axis) - at), F.col(axis))).alias(axis))
    line = field.join(F.broadcast(best), axis, "left_semi")  # one row
    means = line.groupBy(level).agg(F.avg(z).alias(f"mean_{z}"))
    placed = line.join(means, level).withColumn("height", height)
    return regrid_linear_range(placed, [*keys, along], "height", values, step, 0.0)
