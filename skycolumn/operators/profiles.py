"""Layer tops, bases and levels. Windows stay inside a profile, whose length is the number of gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- conversion ----------------------------------------------------------------------------
def to_profiles(cells: DataFrame, keys: Sequence[str], t: str, axis: str, values: Sequence[str]) -> DataFrame:
    """One row per time with arrays ordered along the axis (as long as the instrument has gates)."""
    packed = F.array_sort(F.collect_list(F.struct(axis, *values)))
    return (cells.groupBy(*keys, t).agg(packed.alias("_p"))
            .select(*keys, t, F.col(f"_p.{axis}").alias(axis), *[F.col(f"_p.{v}").alias(v) for v in values]))


def to_cells(profiles: DataFrame, keys: Sequence[str], t: str, axis: str, values: Sequence[str]) -> DataFrame:
    rows = profiles.select(*keys, t, F.explode(F.arrays_zip(axis, *values)).alias("_c"))
    return rows.select(*keys, t, *[F.col(f"_c.{c}").alias(c) for c in (axis, *values)])


# ---- runs of valid gates in a profile ------------------------------------------------------
def _numbered(cells: DataFrame, profile: Sequence[str], gate: str, valid: Column, max_gap: int = 0) -> DataFrame:
    """Valid gates with the number ``_id`` of their run."""
    w = Window.partitionBy(*profile).orderBy(gate)
    rows = cells.filter(valid)
    fresh = F.coalesce(F.col(gate) - F.lag(gate).over(w) - 1 > max_gap, F.lit(True)).cast("int")
    return rows.withColumn("_id", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def valid_runs(cells: DataFrame, profile: Sequence[str], gate: str, height: str, valid: Column,
               max_gap: int = 0) -> DataFrame:
    """Runs of valid gates, allowing up to ``max_gap`` missing ones: first/last gate, heights, n."""
    return _numbered(cells, profile, gate, valid, max_gap).groupBy(*profile, "_id").agg(
        F.min(gate).alias("first_gate"), F.max(gate).alias("last_gate"), F.count(F.lit(1)).alias("n"),
        F.min(height).alias("bottom"), F.max(height).alias("top")).drop("_id")


def _for_all(cells: DataFrame, profile: Sequence[str], found: DataFrame) -> DataFrame:
    return cells.select(*profile).distinct().join(found, list(profile), "left")


def cloudtop(cells: DataFrame, profile: Sequence[str], gate: str, height: str, valid: Column, n: int) -> DataFrame:
    """Top gate of the highest run of at least ``n`` valid gates; NULL without one."""
    runs = valid_runs(cells, profile, gate, height, valid).filter(F.col("n") >= n)
    return _for_all(cells, profile, runs.groupBy(*profile).agg(F.max("top").alias("cloudtop")))


def cloudbase(cells: DataFrame, profile: Sequence[str], gate: str, height: str, valid: Column, n: int) -> DataFrame:
    """Bottom gate of the lowest run of at least ``n`` valid gates."""
    runs = valid_runs(cells, profile, gate, height, valid).filter(F.col("n") >= n)
    return _for_all(cells, profile, runs.groupBy(*profile).agg(F.min("bottom").alias("cloudbase")))


def cloudtop_depth(cells: DataFrame, profile: Sequence[str], gate: str, valid: Column, depth_gates: int,
                   selected_gates: int, offset_gates: int = 0) -> DataFrame:
    """Gate indices (``from_gate``, ``to_gate``) of the upper part of the highest fully valid window.

    The window has ``depth_gates``; its top is lowered by ``offset_gates`` and the highest
    ``selected_gates`` of the rest are returned. ``to_gate`` is the cloud top.
    """
    runs = valid_runs(cells, profile, gate, gate, valid).filter(F.col("n") >= depth_gates)
    best = runs.groupBy(*profile).agg((F.max("last_gate") - offset_gates).alias("to_gate"))
    found = _for_all(cells, profile, best)
    return found.withColumn("from_gate", F.col("to_gate") - (selected_gates - 1))


def cloudtop_continuous(cells: DataFrame, tops: DataFrame, profile: Sequence[str], gate: str, height: str,
                        valid: Column, gap_gates: int, top: str = "cloudtop") -> DataFrame:
    """Top of the layer connected to the ground, starting from ``top``.

    Runs separated by fewer than ``gap_gates`` missing gates are one layer; the lowest layer counts,
    NULL if ``gap_gates`` or more gates are missing under it or if only gate 0 is left.
    """
    merged = valid_runs(cells, profile, gate, height, valid, gap_gates - 1)
    lowest = merged.groupBy(*profile).agg(
        F.min("first_gate").alias("_first"), F.min_by("top", "first_gate").alias("_top"),
        F.min_by("last_gate", "first_gate").alias("_last"))
    out = tops.join(lowest, list(profile), "left")
    reached = F.least(F.col(top), F.col("_top"))
    ok = (F.col("_first") < gap_gates) & F.col(top).isNotNull() & (F.col("_last") > 0)
    return out.withColumn("continuous", F.when(ok, reached)).drop("_first", "_top", "_last")


def cloudbase_continuous(cells: DataFrame, bases: DataFrame, profile: Sequence[str], gate: str, height: str,
                         valid: Column, n: int, base: str = "cloudbase") -> DataFrame:
    """Lowest gate at or above ``base`` from which ``n`` consecutive gates are valid."""
    rows = _numbered(cells, profile, gate, valid)
    run = Window.partitionBy(*profile, "_id")
    starts = rows.withColumn("_left", F.max(gate).over(run) - F.col(gate) + 1).filter(F.col("_left") >= n)
    hit = starts.join(bases.select(*profile, F.col(base).alias("_base")), list(profile)).filter(F.col(height) >= F.col("_base"))
    found = hit.groupBy(*profile).agg(F.min(height).alias("continuous"))
    return bases.join(found, list(profile), "left")


def cloudtop_generic(cells: DataFrame, profile: Sequence[str], gate: str, height: str, valid: Column, n: int,
                     gap_gates: int | None = None, offset: float = 0.0) -> DataFrame:
    """Highest run, then optionally connected to the ground and lowered by an offset."""
    tops = cloudtop(cells, profile, gate, height, valid, n)
    if gap_gates is not None:
        tops = cloudtop_continuous(cells, tops, profile, gate, height, valid, gap_gates)
        tops = tops.select(*profile, F.col("continuous").alias("cloudtop"))
    return tops.withColumn("cloudtop", F.col("cloudtop") - offset) if offset else tops


def layer_mask(cells: DataFrame, layers: DataFrame, profile: Sequence[str], gate: str, lo: str, hi: str,
               name: str = "in_layer") -> DataFrame:
    """True for gates between two per-time gate indices."""
    joined = cells.join(layers.select(*profile, lo, hi), list(profile), "left")
    inside = F.coalesce(F.col(gate).between(F.col(lo), F.col(hi)), F.lit(False))
    return joined.withColumn(name, inside).drop(lo, hi)


def pbl_height(cells: DataFrame, keys: Sequence[str], t: str, height: str, active: Column, limit: float,
               name: str = "pbl") -> DataFrame:
    """Highest active gate below the limit."""
    return cells.groupBy(*keys, t).agg(F.max(F.when(active & (F.col(height) < limit), F.col(height))).alias(name))


# ---- levels of an analysis or a sounding ----------------------------------------------------
def isotherm_linear(levels: DataFrame, column: Sequence[str], temperature: str, altitude: str, target: float,
                    station: float = 0.0, name: str = "isotherm") -> DataFrame:
    """Altitude at which the levels, sorted by temperature, cross the target; needs two levels."""
    known = levels.filter(F.col(temperature).isNotNull() & F.col(altitude).isNotNull())
    w = Window.partitionBy(*column).orderBy(temperature, altitude)
    t1, a1 = F.lead(temperature).over(w), F.lead(altitude).over(w)
    rows = known.withColumns({"_t1": t1, "_a1": a1})
    t0, a0 = F.col(temperature), F.col(altitude)
    at = F.when(F.col("_t1") == t0, a0).otherwise(a0 + (F.col("_a1") - a0) * (target - t0) / (F.col("_t1") - t0))
    inside = (t0 <= target) & (F.col("_t1") >= target)
    found = rows.groupBy(*column).agg(F.min_by(F.when(inside, at - station), F.when(inside, F.struct(t0, a0))).alias(name))
    return found


def isotherm_nearest(levels: DataFrame, column: Sequence[str], temperature: str, altitude: str, target: float,
                     alt_range: tuple[float, float], max_diff: float = 2.0, station: float = 0.0,
                     name: str = "isotherm") -> DataFrame:
    """Level with the temperature closest to the target, closer than ``max_diff``; lowest on ties."""
    gap = F.abs(F.col(temperature) - target)
    usable = F.col(altitude).between(*alt_range) & (gap < max_diff)
    best = F.min_by(F.when(usable, F.col(altitude) - station), F.when(usable, F.struct(gap, F.col(altitude))))
    return levels.groupBy(*column).agg(best.alias(name))


def layer_mean(levels: DataFrame, column: Sequence[str], altitude: str, lo: float, hi: float, value: str) -> DataFrame:
    inside = F.col(altitude).between(lo, hi)
    return levels.groupBy(*column).agg(F.avg(F.when(inside, F.col(value))).alias(f"mean_{value}"))


def domain_box(levels: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    return levels.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def nearest_point(levels: DataFrame, column: Sequence[str], lat: float, lon: float) -> DataFrame:
    """Rows of the grid point closest to a site, per column key: one small aggregate, then a semi join."""
    squared = (F.col("lat") - lat) * (F.col("lat") - lat) + (F.col("lon") - lon) * (F.col("lon") - lon)
    best = levels.groupBy(*column).agg(F.min_by(F.struct("lat", "lon"), F.struct(squared, "lat", "lon")).alias("_p"))
    best = best.select(*column, "_p.lat", "_p.lon")
    return levels.join(best, [*column, "lat", "lon"], "left_semi")


# ---- artefacts ---------------------------------------------------------------------------------
def artefact_mask(fine: DataFrame, coarse: DataFrame, on: Sequence[str], value: str, height: str,
                  bands: Sequence[tuple[float, float]] | None = None, limit: float = 10.0) -> DataFrame:
    """True where the two resolutions differ by more than the limit (missing counts as 999)."""
    other = coarse.select(*on, F.col(value).alias("_c"))
    joined = fine.join(other, list(on), "left")
    far = F.abs(F.coalesce(F.col("_c"), F.lit(999.0)) - F.coalesce(F.col(value), F.lit(999.0))) > limit
    if bands is not None:
        inside = F.lit(False)
        for lo, hi in bands:
            inside = inside | F.col(height).between(lo, hi)
        far = far & inside
    return joined.withColumn("artefact", far).drop("_c")
