"""Nearest-centroid classification of gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_gates(cells: DataFrame, snr: str, rhohv: str) -> DataFrame:
    return cells.filter((F.col(snr) >= -10) & (F.col(rhohv) >= 0.6))


def hydro_classify(cells: DataFrame, variables: Sequence[str], classes: Sequence[tuple[str, Sequence[float]]],
                   scales: Sequence[float]) -> DataFrame:
    """Class of the nearest centroid, its distance, class shares and their entropy.

    Distance: Euclidean over the variables divided by ``scales``. Shares: inverse squared distances,
    normalised. Entropy: of the shares, over the log of their number, so 0..1. (Own definition: no
    formula for the shares is published.) The few centroids are literals: no join, no shuffle.
    """
    def distance(centre: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for v, c, s in zip(variables, centre, scales):
            d = (F.col(v) - float(c)) / float(s)
            total = total + d * d
        return F.sqrt(total)

    names = [n for n, _ in classes]
    far = [f"_d{i}" for i in range(len(names))]
    rows = cells.withColumns({d: distance(c) for d, (_, c) in zip(far, classes)})
    rows = rows.withColumn("distance", F.least(*far) if len(far) > 1 else F.col(far[0]))
    rows = rows.withColumns({f"_w{d}": 1.0 / F.greatest(F.col(d) * F.col(d), F.lit(1e-12)) for d in far})
    rows = rows.withColumn("_total", reduce(add, [F.col(f"_w{d}") for d in far]))
    shares = [F.col(f"_w{d}") / F.col("_total") for d in far]
    entropy = reduce(add, [F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in shares]) / F.log(F.lit(float(len(names))))
    nearest = reduce(lambda rest, i: F.when(F.col(far[i]) == F.col("distance"), names[i]).otherwise(rest),
                     reversed(range(len(names))), F.lit(None).cast("string"))
    rows = rows.withColumns({"hydro_class": nearest, "shares": F.array(*shares), "entropy": entropy})
    return rows.drop("_total", *far, *[f"_w{d}" for d in far])


def profile_flags(cells: DataFrame, profile: Sequence[str], valid: Column) -> DataFrame:
    """Does any / every gate of a profile hold a valid value?"""
    ok = F.coalesce(valid, F.lit(False))
    return cells.groupBy(*profile).agg(F.bool_or(ok).alias("any_valid"), F.bool_and(ok).alias("all_valid"))
