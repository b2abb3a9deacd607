"""Equality joins on shared grids and the joins that reduce to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.specs import CANONICAL


def rename_canonical(df: DataFrame, radar: str, keys: Sequence[str] = ("time", "range")) -> DataFrame:
    """Keep the keys and the known variables under their canonical names, as DOUBLE."""
    known = CANONICAL[radar]
    return df.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in known.items() if c in df.columns])


def combine_radars(tables: Mapping[str, DataFrame], base: str, on: Sequence[str]) -> DataFrame:
    """Variables of all instruments side by side, suffixed ``_<radar>``, on the grid of ``base``."""
    def suffixed(radar: str) -> DataFrame:
        df = tables[radar]
        return df.select(*on, *[F.col(c).alias(f"{c}_{radar}") for c in df.columns if c not in on])

    others = [suffixed(r) for r in tables if r != base]
    return reduce(lambda a, b: a.join(b, list(on), "left"), others, suffixed(base))


def dual_frequency_ratio(df: DataFrame, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``DFR_<a><b>`` = value_a - value_b; unclipped."""
    return df.withColumns({f"DFR_{a}{b}": F.col(f"{value}_{a}") - F.col(f"{value}_{b}") for a, b in pairs})


def grid_equi_join(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, how: str = "inner",
                   name: str = "dfr") -> DataFrame:
    """Difference of one variable of two instruments on their shared cells."""
    right = b.select(*on, F.col(value).alias("_other"))
    return a.join(right, list(on), how).withColumn(name, F.col(value) - F.col("_other")).drop("_other")


def split_excluded(df: DataFrame, excluded: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows whose key is absent from / present in the excluded set."""
    return df.join(excluded, list(on), "left_anti"), df.join(excluded, list(on), "left_semi")


def param_grid(**values: Sequence) -> list[dict]:
    """All combinations of the listed parameter values (a plan-time list)."""
    return [dict(zip(values, combination)) for combination in product(*values.values())]


def with_params(df: DataFrame, grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """Each row once per parameter combination, by an inline array: nothing is shuffled."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in g.items()]) for g in grid])
    return df.withColumn("_p", F.explode(rows)).select(*df.columns, "_p.*")


def dem_lookup(points: DataFrame, raster: DataFrame, row: Column, col: Column, n_rows: int, n_cols: int,
               value: str, nodata: float) -> DataFrame:
    """Sample a raster at integer positions: no-data and absent cells are 0, outside is NULL."""
    placed = points.withColumns({"_row": F.floor(row), "_col": F.floor(col)})
    cells = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).alias("_v"))
    inside = F.col("_row").between(0, n_rows - 1) & F.col("_col").between(0, n_cols - 1)
    sampled = F.when(inside, F.when(F.col("_v").isNull() | (F.col("_v") == nodata), 0.0).otherwise(F.col("_v")))
    return placed.join(cells, ["_row", "_col"], "left").withColumn(value, sampled).drop("_row", "_col", "_v")


def band_self_join(df: DataFrame, keys: Sequence[str], t: str, maxlag: int, values: Sequence[str]) -> DataFrame:
    """Pairs of rows of a key with 0 < lag <= maxlag: ``t``, ``t2``, values and ``<v>2``.

    Equality on slots of ``maxlag``: the later row is copied into its own and the previous slot, so
    a pair meets exactly once; dense slots are split by the skew join. Collapse repeated times first
    (``variogram`` does) so that a burst cannot pair with itself.
    """
    slot = F.floor(F.col(t) / maxlag)
    first = df.select(*keys, t, *values).withColumn("_slot", slot)
    later = df.select(*keys, F.col(t).alias("t2"), *[F.col(v).alias(f"{v}2") for v in values],
                      F.explode(F.array(slot, slot - 1)).alias("_slot"))
    lag = F.col("t2") - F.col(t)
    return first.join(later, [*keys, "_slot"]).filter((lag > 0) & (lag <= maxlag)).drop("_slot")


def instrument_pairs(cells: DataFrame, instrument: str, on: Sequence[str], value: str, name: str = "dfr") -> DataFrame:
    """The difference ``first`` minus ``second`` for every pair of instruments on the shared grid.

    The instruments of a cell meet in one group (one value each), so a cell costs one row in the shuffle and
    the pairs, a few for a few instruments, are made from its short list.
    """
    known = cells.filter(F.col(value).isNotNull()).groupBy(*on).agg(
        F.array_sort(F.collect_list(F.struct(F.col(instrument).alias("i"), F.col(value).alias("v")))).alias("_l"))
    pairs = F.flatten(F.transform("_l", lambda a: F.transform(F.filter("_l", lambda b: a["i"] < b["i"]), lambda b: F.struct(
        a["i"].alias("first"), b["i"].alias("second"), (a["v"] - b["v"]).alias(name)))))
    return known.select(*on, F.explode(pairs).alias("_p")).select(*on, "_p.*")


def set_operation(how: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Set ``union``, ``intersect`` or ``except`` of two tables with the same columns (NULL equals NULL)."""
    right = right.select(*left.columns)
    if how == "union":
        return left.unionByName(right).distinct()
    return left.intersect(right) if how == "intersect" else left.subtract(right)


def top_n(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """The first ``n`` rows of an order, at most ``n`` rows leave a task."""
    return df.orderBy(*by).limit(n)
