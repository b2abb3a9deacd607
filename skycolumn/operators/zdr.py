"""Differential-reflectivity bias from zenith scans: points, filters, region, time, kriging."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycolumn.functions.scalar import angle_step, missing_to_null, ml_index
from skycolumn.operators.intervals import add_run_in_group
from skycolumn.operators.ordered import add_running, floor_div, join_on
from skycolumn.operators.stats import exact_quantiles, quantiles_from_counts
from skycolumn.operators.windows import count_within, roll_gradient

FIELDS = ("zdr", "zh", "rhohv", "snr_h", "snrv")
BIAS_QUANTILES = {"min": 0.0, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "max": 1.0}


def scan_quality(points: DataFrame, scan: str, gate: str, fields: Sequence[str] = FIELDS, share: float = 0.9) -> DataFrame:
    """(scan, gate) whose fields are all present in at least ``share`` of the scan's rays."""
    rays = points.select(scan, "t").distinct().groupBy(scan).agg(F.count(F.lit(1)).alias("_rays"))
    counts = points.groupBy(scan, gate).agg(*[F.count(f).alias(f"_n_{f}") for f in fields])
    ok = F.lit(True)
    for f in fields:
        ok = ok & (F.col(f"_n_{f}") >= share * F.col("_rays"))
    return counts.join(rays, scan).filter(ok).select(scan, gate)


def build_points(rays: DataFrame, scan: str, gate: str, offset: float = 0.0, fraction: float = 0.25,
                 share: float = 0.9) -> DataFrame:
    """Points of moving rays and complete gates, cleaned, sign turned, with the running scan number.

    ``rays`` has one row per (scan, t, gate) with the ray's ``az`` and the five fields. A scan's rows meet once: steps are found on
    one row per ray, and what is counted per scan or gate is counted in windows on the same partitioning, as long as the scan.
    """
    rest = [c for c in rays.columns if c not in (scan, "t")]
    per_ray = rays.repartition(scan).groupBy(scan, "t").agg(F.first("az").alias("_az"), F.collect_list(F.struct(*rest)).alias("_cells"))
    whole = Window.partitionBy(scan)
    per_ray = per_ray.withColumn("_n", F.count(F.lit(1)).over(whole))
    moving = angle_step(per_ray, [scan], "t", "_az").filter(F.col("step") > fraction * 360.0 / F.col("_n"))
    moving = moving.withColumn("_rays", F.count(F.lit(1)).over(whole))
    cleaned = {f: missing_to_null(F.col(f)) for f in FIELDS} | {"zdr": missing_to_null(-F.col("zdr")) + offset}
    points = moving.select(scan, "t", "_rays", F.explode("_cells").alias("_c")).select(scan, "t", "_rays", "_c.*").withColumns(cleaned)
    of_gate = Window.partitionBy(scan, gate)
    for f in FIELDS:
        points = points.withColumn(f"_n_{f}", F.count(f).over(of_gate))
    complete = F.least(*[F.col(f"_n_{f}") for f in FIELDS]) >= share * F.col("_rays")
    points = points.filter(complete).select(*rays.columns)
    starts = points.groupBy(scan).agg(F.min("t").alias("_start"))
    # ties in start time are broken by the scan itself: equal starts share a running sum of their count
    by_start = starts.groupBy("_start").agg(F.count(F.lit(1)).alias("_c"))
    before = add_running(by_start, [], "_start", {"_sum": ("sum", F.col("_c"))})
    within = Window.partitionBy("_start").orderBy(scan)
    numbered = starts.join(before, "_start").select(scan, (F.col("_sum") - F.col("_c") + F.row_number().over(within)).alias("idx"))
    return points.join(numbered, scan)


def ml_filter(points: DataFrame, limit: float = 0.1) -> DataFrame:
    """Rain points away from the melting layer, with the number of azimuths of their scan."""
    azimuths = points.select("t", "az").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("num_unique_az"))
    kept = points.filter((F.col("snr_h") > 5) & (F.col("snrv") > 5) & (F.col("rhohv") > 0.95)
                         & (ml_index(F.col("zh"), F.col("rhohv")) < limit))
    return kept.join(azimuths, "t")


def gate_complete_filter(points: DataFrame, columns: Sequence[str] = ("zh", "zdr"), ratio: float = 0.1) -> DataFrame:
    """Gates seen at every azimuth of their scan, rows with at most ``ratio`` missing columns."""
    full = points.groupBy("t", "r").agg(F.count(F.lit(1)).alias("_n"), F.max("num_unique_az").alias("_az"))
    full = full.filter(F.col("_n") == F.col("_az")).select("t", "r")
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / len(columns)
    return points.join(full, ["t", "r"], "left_semi").filter(missing <= ratio)


def zdr_range_stats(points: DataFrame, keys: Sequence[str] = (), quantised: bool = False) -> DataFrame:
    """Per gate: count, median, IQR and bias quantiles against the median of the upper half of the ranges."""
    find = quantiles_from_counts if quantised else exact_quantiles
    ends = points.groupBy(*keys).agg(((F.max("r") - (F.max("r") - F.min("r")) / 2)).alias("_half"))
    upper = join_on(points, ends, keys).filter(F.col("r") >= F.col("_half"))
    middle = find(upper, keys, "zdr", {"_med": 0.5})
    good = points.filter((F.col("rhohv") > 0.95) & (F.col("snr_h") > 5))
    counts = good.groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("n"))
    table = join_on(find(good, [*keys, "r"], "zdr", BIAS_QUANTILES).join(counts, [*keys, "r"]), middle, keys)
    bias = [(F.col(q) - F.col("_med")).alias(f"bias_{q}") for q in BIAS_QUANTILES]
    return table.select(*keys, "r", "n", F.col("median").alias("med"), (F.col("q75") - F.col("q25")).alias("iqr"), *bias)


def _longest(stats: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Rows of the longest run of True along r (a table of gates), the first one on ties."""
    rows = add_run_in_group(stats.withColumn("_ok", F.coalesce(flag, F.lit(False))), keys, "r", "_ok", "_len")
    w = Window.partitionBy(*keys).orderBy("r")
    rows = rows.withColumn("_new", (~F.lag("_ok").over(w).eqNullSafe(F.col("_ok"))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys)
    best = F.min_by("_run", F.when(F.col("_ok"), F.struct(-F.col("_len"), F.col("_run")))).over(whole)
    return rows.withColumn("_best", best).filter(F.col("_run") == F.col("_best")).drop("_ok", "_len", "_new", "_run", "_best")


def region_select(stats: DataFrame, keys: Sequence[str] = (), min_count: int = 5000, max_gradient: float = 5e-4,
                  min_range: float = 800.0, max_iqr: float = 0.2) -> DataFrame:
    """Gates usable for the bias: flat median, then a usual spread; each time the longest section.

    ``stats`` is the table of ``zdr_range_stats``: one row per gate.
    """
    rows = roll_gradient(stats, keys, "r", "bias_median", "_grad")
    flat = _longest(rows, keys, (F.col("n") > min_count) & (F.abs("_grad") < max_gradient) & (F.col("r") > min_range))
    whole = Window.partitionBy(*keys)
    top, low = F.max("r").over(whole), F.min("r").over(whole)
    half = top - (top - low) / 2
    flat = flat.withColumn("_half", F.when(top - half < 1000, top - 1000).otherwise(half))
    usual = F.percentile(F.when(F.col("r") >= F.col("_half"), F.col("iqr")), F.lit(0.5)).over(whole)
    flat = flat.withColumn("_usual", usual)
    return _longest(flat, keys, F.abs(F.col("iqr") - F.col("_usual")) <= max_iqr).drop("_grad", "_half", "_usual")


def zdr_time_stats(points: DataFrame, keys: Sequence[str] = (), quantised: bool = False) -> DataFrame:
    """Per scan time: number of points and quantiles."""
    find = quantiles_from_counts if quantised else exact_quantiles
    probs = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    counts = points.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(find(points, [*keys, "t"], "zdr", probs), [*keys, "t"])


def time_select(stats: DataFrame, hour: int, keys: Sequence[str] = (), per_hour: int = 3, per_day: int = 10,
                min_points: int = 100) -> DataFrame:
    """Scans with enough points and enough scans around them."""
    near = count_within(stats, keys, "t", {"n_hour": hour, "n_day": 24 * hour})
    return near.filter((F.col("n_hour") >= per_hour) & (F.col("n_day") >= per_day) & (F.col("n") > min_points))


# ---- variogram models ---------------------------------------------------------------------
def _spherical(x: Column, rng: float, sill: float) -> Column:
    return F.when(x > rng, F.lit(sill)).otherwise(sill * (1.5 * x / rng - 0.5 * F.pow(x / rng, 3.0)))


def _gaussian(x: Column, rng: float, sill: float) -> Column:
    return sill * (1 - F.exp(-F.pow(x / (rng / 1.7), 2.0)))


def _exponential(x: Column, rng: float, sill: float) -> Column:
    return sill * (1 - F.exp(-x / (rng / 3.0)))


_PARTS = {"spherical": _spherical, "gaussian": _gaussian, "exponential": _exponential}


def variogram_model(parts: Sequence[str], params: Sequence[float], x: Column) -> Column:
    """Sum of named models: parameters are (range, sill) for each part, then the nugget."""
    if len(params) != 2 * len(parts) + 1:
        raise ValueError("two parameters per part and a nugget are needed")
    out = F.lit(float(params[-1]))
    for i, part in enumerate(parts):
        out = out + _PARTS[part](x, float(params[2 * i]), float(params[2 * i + 1]))
    return out


def _model_numpy(parts: Sequence[str], params: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    def gamma(x: np.ndarray) -> np.ndarray:
        out = np.where(x > 0, params[-1], 0.0)
        for i, part in enumerate(parts):
            rng, sill = params[2 * i], params[2 * i + 1]
            if part == "spherical":
                out = out + np.where(x > rng, sill, sill * (1.5 * x / rng - 0.5 * (x / rng) ** 3))
            elif part == "gaussian":
                out = out + sill * (1 - np.exp(-((x / (rng / 1.7)) ** 2)))
            else:
                out = out + sill * (1 - np.exp(-x / (rng / 3.0)))
        return out

    return gamma


def krige_scans(observed: DataFrame, targets: DataFrame, t: str, value: str, parts: Sequence[str],
                params: Sequence[float], radius: int, resolution: int, unit: float, split: int = 0) -> DataFrame:
    """Local ordinary kriging of ``value`` at the target times.

    Unlike one global system over all scans, a target uses the observations within ``radius``.
    Observations are first averaged over ``resolution`` and targets reduced to distinct times, so a
    task of half a radius holds at most 2.5*radius/resolution of the former. ``split`` averages the estimates at t-split and t+split (zenith scans).
    Gives ``correction`` and ``std`` (NULL without an observation in reach).
    """
    means = observed.filter(F.col(value).isNotNull()).groupBy((floor_div(F.col(t), resolution) * resolution + resolution // 2).alias("o")).agg(
        F.avg(value).alias("v"))
    width = max(resolution, radius // 2)
    lo, hi = floor_div(F.col("o") - radius, width), floor_div(F.col("o") + radius, width)
    around = means.withColumn("_b", F.explode(F.sequence(lo, hi)))
    shifts = [-split, split] if split else [0]
    wanted = targets.select(t).distinct().withColumn("_at", F.explode(F.array(*[F.col(t) + s for s in shifts])))
    wanted = wanted.withColumn("_b", floor_div(F.col("_at"), width))
    gamma = _model_numpy(parts, [float(p) for p in params])

    def solve(want: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        x, y = seen["o"].to_numpy(dtype="int64"), seen["v"].to_numpy(dtype="float64")
        rows = []
        for target, at in zip(want["_t"], want["_at"]):
            near = np.abs(x - at) <= radius
            n = int(near.sum())
            if n == 0:
                rows.append((target, None, None))
                continue
            xs, ys = x[near], y[near]
            system = np.ones((n + 1, n + 1))
            system[:n, :n] = gamma(np.abs(xs[:, None] - xs[None, :]) / unit)
            system[n, n] = 0.0
            right = np.ones(n + 1)
            right[:n] = gamma(np.abs(xs - at) / unit)
            weights = np.linalg.lstsq(system, right, rcond=None)[0]
            variance = max(float(weights @ right), 0.0)
            rows.append((target, float(weights[:n] @ ys), variance ** 0.5))
        return pd.DataFrame(rows, columns=["_t", "correction", "std"])

    kriged = (wanted.withColumnRenamed(t, "_t").groupBy("_b").cogroup(around.groupBy("_b"))
              .applyInPandas(lambda a, b: solve(a, b), "_t long, correction double, std double"))
    return kriged.groupBy(F.col("_t").alias(t)).agg(F.avg("correction").alias("correction"), F.avg("std").alias("std"))
