"""Rolling, filtering and difference operators along time or range.

Time windows run per bucket with a halo; range windows run per profile, whose length is the number
of gates. Even widths W cover i-W/2 .. i+W/2-1, odd widths are symmetric.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skycolumn.operators.ordered import (
    BUCKET, add_carried, add_neighbours, first_per_time, halo, join_on, owned)

dedup_time = first_per_time


def frame_bounds(width: int, center: bool = True) -> tuple[int, int]:
    """First and last offset (in samples) of a window of ``width`` samples."""
    if not center:
        return -(width - 1), 0
    return -(width // 2), width - 1 - width // 2


def over_time(df: DataFrame, keys: Sequence[str], t: str, lo: int, hi: int,
              columns: Mapping[str, Callable[[WindowSpec, WindowSpec], Column]],
              bucket: int | None = None) -> DataFrame:
    """Add window columns over the frame [t+lo, t+hi]; each callable gets (frame, plain order)."""
    rows = halo(df, keys, t, max(0, -lo), max(0, hi), bucket)
    order = Window.partitionBy(*keys, BUCKET).orderBy(t)
    return owned(rows.withColumns({n: make(order.rangeBetween(lo, hi), order) for n, make in columns.items()}))


# ---- rolling statistics ----------------------------------------------------------------------
def rolling_mean(df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, width: int,
                 min_periods: int | None = None, center: bool = True, name: str | None = None,
                 bucket: int | None = None) -> DataFrame:
    """Mean of the non-missing samples, NULL with fewer than ``min_periods`` (default: width)."""
    lo, hi = (b * step for b in frame_bounds(width, center))
    need = width if min_periods is None else min_periods
    mean = lambda w, _: F.when(F.count(value).over(w) >= need, F.avg(value).over(w))
    return over_time(df, keys, t, lo, hi, {name or f"{value}_mean": mean}, bucket)


def rolling_any(df: DataFrame, keys: Sequence[str], t: str, flag: str, step: int, width: int,
                name: str | None = None, bucket: int | None = None) -> DataFrame:
    lo, hi = (b * step for b in frame_bounds(width))
    return over_time(df, keys, t, lo, hi, {name or flag: lambda w, _: F.max(flag).over(w)}, bucket)


def dominant_flag(df: DataFrame, keys: Sequence[str], t: str, first: str, second: str, precip: str, step: int,
                  width: int, threshold: float = 0.75, bucket: int | None = None) -> DataFrame:
    """Fill two flags with the more frequent one wherever precipitation prevails in the window."""
    lo, hi = (b * step for b in frame_bounds(width))
    share = lambda c: lambda w, _: F.when(F.count(c).over(w) >= width, F.avg(F.col(c).cast("double")).over(w))
    rows = over_time(df, keys, t, lo, hi, {"_f1": share(first), "_f2": share(second), "_p": share(precip)}, bucket)
    wet = F.coalesce(F.col("_p") > threshold, F.lit(False))
    seen = F.coalesce((F.col("_f1") > 0) | (F.col("_f2") > 0), F.lit(True))
    ahead = F.coalesce(F.col("_f1") > F.col("_f2"), F.lit(False))
    return rows.withColumns({first: F.col(first) | (wet & seen & ahead),
                             second: F.col(second) | (wet & seen & ~ahead),
                             "extended": wet}).drop("_f1", "_f2", "_p")


def rolling_var_2d(cells: DataFrame, keys: Sequence[str], t: str, gate: str, value: str, step: int, width_t: int,
                   width_r: int, min_periods: int, name: str = "variance", bucket: int | None = None) -> DataFrame:
    """Population variance in a time x range box from sums that are additive over both axes."""
    lo, hi = (b * step for b in frame_bounds(width_t))
    x = F.col(value)
    sums = {"_n": lambda w, _: F.count(x).over(w), "_s": lambda w, _: F.sum(x).over(w),
            "_q": lambda w, _: F.sum(x * x).over(w)}
    rows = over_time(cells, [*keys, gate], t, lo, hi, sums, bucket)
    box = Window.partitionBy(*keys, t).orderBy(gate).rangeBetween(*frame_bounds(width_r))
    n, s, q = (F.sum(c).over(box) for c in ("_n", "_s", "_q"))
    rows = rows.withColumns({"_bn": n, "_bs": s, "_bq": q})
    mean = F.col("_bs") / F.col("_bn")
    variance = F.greatest(F.col("_bq") / F.col("_bn") - mean * mean, F.lit(0.0))
    return rows.withColumn(name, F.when(F.col("_bn") >= min_periods, variance)).drop(
        "_n", "_s", "_q", "_bn", "_bs", "_bq")


def uniform_filter(df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, width: int,
                   bucket: int | None = None) -> DataFrame:
    """``mean`` and ``std`` in an odd window; beyond the ends the edge value is repeated."""
    if width % 2 != 1:
        raise ValueError("width must be odd")
    half = width // 2
    ends = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"),
                                 F.min_by(value, t).alias("_v0"), F.max_by(value, t).alias("_v1"))
    x = F.col(value)
    rows = over_time(df, keys, t, -half * step, half * step,
                     {"_s": lambda w, _: F.sum(x).over(w), "_q": lambda w, _: F.sum(x * x).over(w),
                      "_c": lambda w, _: F.count(x).over(w), "_r": lambda w, _: F.count(F.lit(1)).over(w)}, bucket)
    rows = join_on(rows, ends, keys)
    left = F.greatest(F.lit(0), F.lit(half) - (F.col(t) - F.col("_t0")) / step)
    right = F.greatest(F.lit(0), F.lit(half) - (F.col("_t1") - F.col(t)) / step)
    v0, v1 = F.col("_v0"), F.col("_v1")
    whole = F.col("_c") == F.col("_r")
    mean = (F.col("_s") + F.when(left > 0, left * v0).otherwise(0) + F.when(right > 0, right * v1).otherwise(0)) / width
    square = (F.col("_q") + F.when(left > 0, left * v0 * v0).otherwise(0)
              + F.when(right > 0, right * v1 * v1).otherwise(0)) / width
    rows = rows.withColumns({"mean": F.when(whole, mean), "_sq": F.when(whole, square)})
    std = F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return rows.withColumn("std", F.when(F.col("_sq").isNotNull(), std)).drop(
        "_s", "_q", "_c", "_r", "_t0", "_t1", "_v0", "_v1", "_sq")


# ---- autocovariance ------------------------------------------------------------------------
def _lag_moments(df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, lag: int, bucket: int | None) -> DataFrame:
    """Per key the mean, the spread and the autocovariance, from one pass."""
    pairs = over_time(df, keys, t, 0, lag * step,
                      {"_y": lambda _, o: F.lead(value, lag).over(o),
                       "_z": lambda _, o: F.lead(t, lag).over(o)}, bucket)
    x, y = F.col(value), F.when(F.col("_z") == F.col(t) + lag * step, F.col("_y"))
    both = x.isNotNull() & y.isNotNull()
    sums = pairs.groupBy(*keys).agg(
        F.avg(x).alias("_m"), F.stddev_pop(x).alias("_sd"), F.count(F.lit(1)).alias("_n"), F.sum(x * y).alias("_xy"),
        F.sum(F.when(both, x + y)).alias("_xpy"), F.count_if(both).alias("_k"))
    m = F.col("_m")
    total = F.col("_xy") - m * F.col("_xpy") + F.col("_k") * m * m
    return sums.select(*keys, "_m", "_sd", F.when(F.col("_m").isNull() | (F.col("_k") == 0), 0.0)
                       .otherwise(total / (F.col("_n") - 1)).alias("autocov"))


def autocovariance(df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, lag: int = 1,
                   bucket: int | None = None) -> DataFrame:
    """Sum of lagged products of deviations over n-1, one row per key; the grid must be complete."""
    return _lag_moments(df, keys, t, value, step, lag, bucket).select(*keys, "autocov")


def autocov_outliers_2d(cells: DataFrame, keys: Sequence[str], t: str, gate: str, value: str, step: int,
                        threshold: float = 2.5, fraction: float = 0.4, bucket: int | None = None) -> DataFrame:
    """Times at which more than ``fraction`` of the gates are outliers of their own gate.

    Dividing a gate by its (non-zero) autocovariance rescales it without changing |z|, so the score
    is |x - mean| / std; gates with zero autocovariance or spread flag nothing.
    """
    per_gate = [*keys, gate]
    scale = _lag_moments(cells, per_gate, t, value, step, 1, bucket)
    gates = scale.groupBy(*keys).agg(F.count(gate).alias("_gates"))
    scored = cells.join(scale, per_gate)
    z = F.when((F.col("_sd") > 0) & (F.col("autocov") != 0), F.abs(F.col(value) - F.col("_m")) / F.col("_sd"))
    times = scored.groupBy(*keys, t).agg(F.count_if(z > threshold).alias("flagged"))
    times = join_on(times, gates, keys)
    return times.filter(F.col("flagged") > F.floor(F.lit(fraction) * F.col("_gates"))).drop("_gates")


def noisy_times(cells: DataFrame, keys: Sequence[str], t: str, gate: str, values: Sequence[str], step: int,
                **options) -> DataFrame:
    """Union of the outlier times of several variables, which are one more key of the same pass."""
    long = cells.select(*keys, t, gate, *values).unpivot([*keys, t, gate], list(values), "_variable", "_value")
    return autocov_outliers_2d(long, [*keys, "_variable"], t, gate, "_value", step, **options).select(*keys, t).distinct()


def autocov_outliers_rolling(df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, width: int = 3,
                             threshold: float = 2.5, detrend: bool = False, bucket: int | None = None) -> DataFrame:
    """Window centres whose lag-1 autocovariance is an outlier among all complete windows."""
    if detrend:
        df = uniform_filter(df, keys, t, value, step, width, bucket).withColumn(value, F.col(value) - F.col("mean"))
    half = width // 2
    x = F.col(value)
    frame = lambda o, a, b: o.rowsBetween(a, b)
    rows = over_time(df.select(*keys, t, value), keys, t, -half * step, (half + 1) * step,
                     {"_p": lambda _, o: x * F.lead(value).over(o)}, bucket)
    first = lambda w, o: F.sum(x).over(frame(o, -half, half - 1))
    last = lambda w, o: F.sum(x).over(frame(o, -half + 1, half))
    rows = over_time(rows, keys, t, -half * step, half * step,
                     {"_xy": lambda w, o: F.sum("_p").over(frame(o, -half, half - 1)), "_a": first, "_b": last,
                      "_m": lambda w, o: F.avg(x).over(frame(o, -half, half)),
                      "_n": lambda w, o: F.count(x).over(frame(o, -half, half))}, bucket)
    m = F.col("_m")
    autocov = (F.col("_xy") - m * (F.col("_a") + F.col("_b")) + (width - 1) * m * m) / (width - 1)
    scored = rows.filter(F.col("_n") == width).select(*keys, t, autocov.alias("autocov"))
    stats = scored.groupBy(*keys).agg(F.avg("autocov").alias("_m"), F.stddev_pop("autocov").alias("_sd"))
    joined = join_on(scored, stats, keys)
    return joined.filter(F.abs(F.col("autocov") - F.col("_m")) > threshold * F.col("_sd")).drop("_m", "_sd")


# ---- differences ----------------------------------------------------------------------------
def _gradient(here: Column, prev: Column, nxt: Column, x: Column, xp: Column, xn: Column) -> Column:
    h1, h2 = x - xp, xn - x
    inner = (h1 * h1 * nxt + (h2 * h2 - h1 * h1) * here - h2 * h2 * prev) / (h1 * h2 * (h1 + h2))
    return F.when(xp.isNull(), (nxt - here) / h2).when(xn.isNull(), (here - prev) / h1).otherwise(inner)


def gradient_range(cells: DataFrame, keys: Sequence[str], t: str, axis: str, value: str, name: str) -> DataFrame:
    """Second-order central difference on a non-uniform axis inside each profile."""
    w = Window.partitionBy(*keys, t).orderBy(axis)
    at = lambda c: (F.lag(c).over(w), F.lead(c).over(w))
    (xp, xn), (vp, vn) = at(axis), at(value)
    return cells.withColumn(name, _gradient(F.col(value), vp, vn, F.col(axis), xp, xn))


def gradient_time(df: DataFrame, keys: Sequence[str], t: str, value: str, name: str, unit: int,
                  bucket: int | None = None) -> DataFrame:
    """The same along time, per ``unit`` of t."""
    rows = df.withColumn("_x", F.col(t))
    rows = add_neighbours(rows, keys, t, prev=["_x", value], next=["_x", value], bucket=bucket)
    x = [F.col(c) / unit for c in ("_x", "prev__x", "next__x")]
    out = _gradient(F.col(value), F.col(f"prev_{value}"), F.col(f"next_{value}"), *x)
    return rows.withColumn(name, out).drop("_x", "prev__x", "next__x", f"prev_{value}", f"next_{value}")


def roll_gradient(df: DataFrame, group: Sequence[str], axis: str, value: str, name: str) -> DataFrame:
    """Neighbour gradient on a closed ring: the first and last row are neighbours (bounded groups)."""
    w = Window.partitionBy(*group).orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = lambda c: (F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
                      - F.coalesce(F.lag(c).over(w), F.last(c).over(whole)))
    return df.withColumn(name, F.try_divide(step(value), step(axis)))


def jump_filter(df: DataFrame, keys: Sequence[str], t: str, value: str, limit: float,
                bucket: int | None = None) -> DataFrame:
    """NULL where the step to either neighbour exceeds the limit."""
    rows = add_neighbours(df, keys, t, prev=[value], next=[value], bucket=bucket)
    far = lambda c: F.coalesce(F.abs(F.col(value) - F.col(c)) > limit, F.lit(False))
    bad = far(f"prev_{value}") | far(f"next_{value}")
    return rows.withColumn(value, F.when(~bad, F.col(value))).drop(f"prev_{value}", f"next_{value}")


# ---- cumulative sums in a profile -------------------------------------------------------------
def cum_attenuation(cells: DataFrame, profile: Sequence[str], axis: str, attenuation: Column,
                    name: str = "pia", half_gate: bool = True) -> DataFrame:
    """Two-way path attenuation: 2*cumsum(a) - a, or the plain cumsum of 2*a."""
    w = Window.partitionBy(*profile).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(attenuation).over(w) * 2
    return cells.withColumn(name, total - attenuation if half_gate else total)


def hypsometric(levels: DataFrame, column: Sequence[str], level: str, temperature: str, pressure: str,
                gas_constant: float, gravity: float, name: str = "height") -> DataFrame:
    """Heights from the lowest level (largest ``level``) upwards: sum of R T ln(p_below / p) / g."""
    w = Window.partitionBy(*column).orderBy(level)
    part = gas_constant * F.col(temperature) * F.log(F.lead(pressure).over(w) / F.col(pressure))
    up = Window.partitionBy(*column).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, 0)
    rows = levels.withColumn("_part", F.coalesce(part, F.lit(0.0)))
    return rows.withColumn(name, F.sum("_part").over(up) / gravity).drop("_part")


def hybrid_pressure(levels: DataFrame, coefficients: DataFrame, surface: DataFrame, t: str, level: str, p0: float, keys: Sequence[str] = (),
                    tolerance: int | None = None) -> DataFrame:
    """Adds ``p`` = a * p0 + b * ps on hybrid levels: ``coefficients`` (level, a, b), ``surface`` (keys, t, ps) aligned by the nearest time.

    The surface pressure is looked up once per time, not once per level. Levels without coefficients or surface pressure have no pressure.
    """
    from skycolumn.operators.asof import asof_nearest
    times = asof_nearest(levels.select(*keys, t).distinct(), surface, t, keys, ["ps"], tolerance)
    known = levels.join(times.select(*keys, t, "ps"), [*keys, t], "left").join(coefficients.select(level, "a", "b"), level, "left")
    return known.withColumn("p", F.col("a") * p0 + F.col("b") * F.col("ps")).drop("a", "b")


# ---- time series -----------------------------------------------------------------------------
def count_within(times: DataFrame, keys: Sequence[str], t: str, windows: Mapping[str, int],
                 bucket: int | None = None) -> DataFrame:
    """Number of rows within half a window on either side, one column per window.

    A count is the difference of two counts from the bucket's first row on, which grow from row to row, so the work does not depend on how
    many rows a window holds; a frame that slides is counted anew for every row.
    """
    widest = max(windows.values()) // 2
    rows = halo(times, keys, t, widest, widest, bucket)
    order = Window.partitionBy(*keys, BUCKET).orderBy(t)
    until = lambda at: F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, at))
    return owned(rows.withColumns({n: until(w // 2) - until(-(w // 2) - 1) for n, w in windows.items()}))


def gap_marker(df: DataFrame, keys: Sequence[str], t: str, value: str, max_gap: int,
               bucket: int | None = None) -> DataFrame:
    """Add a NULL row half a ``max_gap`` after every row that is followed by a longer gap."""
    rows = add_neighbours(df.select(*keys, t, value).withColumn("_at", F.col(t)), keys, t, next=["_at"], bucket=bucket)
    copies = F.when(F.col("next__at") - F.col(t) > max_gap, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    marked = rows.withColumn("_mark", F.explode(copies))
    return marked.select(*keys, F.when(F.col("_mark"), F.col(t) + max_gap // 2).otherwise(F.col(t)).alias(t),
                         F.when(~F.col("_mark"), F.col(value)).alias(value))


def fill_gaps(df: DataFrame, keys: Sequence[str], t: str, value: str, forward: str = "ffill",
              backward: str = "bfill", bucket: int | None = None) -> DataFrame:
    return add_carried(df, keys, t, last={forward: value}, next={backward: value}, bucket=bucket)


def interpolate_missing(df: DataFrame, keys: Sequence[str], t: str, value: str, bucket: int | None = None) -> DataFrame:
    """Linear in time between the known values around a missing one; the end values reach outwards."""
    rows = df.withColumn("_kt", F.when(F.col(value).isNotNull(), F.col(t)))
    rows = add_carried(rows, keys, t, last={"_v0": value, "_t0": "_kt"}, next={"_v1": value, "_t1": "_kt"}, bucket=bucket)
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * ((F.col(t) - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    filled = F.when(F.col("_t0").isNull(), F.col("_v1")).when(F.col("_t1").isNull(), F.col("_v0")).otherwise(between)
    return rows.withColumn(value, F.coalesce(F.col(value), filled)).drop("_kt", "_v0", "_t0", "_v1", "_t1")


def savgol_weights(window: int, degree: int) -> np.ndarray:
    """Row i: weights that give the least-squares polynomial at sample i of a full window."""
    powers = np.vander(np.arange(window) - window // 2, degree + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def gap_interp_smooth(df: DataFrame, keys: Sequence[str], t: str, value: str, step: int, max_gap: int = 5,
                      window: int = 11, degree: int = 3, name: str = "smooth", bucket: int | None = None) -> DataFrame:
    """Inverse-distance fill from samples i-max_gap .. i+max_gap-1, then a Savitzky-Golay filter.

    The grid must be complete with at least ``window`` rows per key; the first and last half window
    use the polynomial of the outermost full window.
    """
    offsets = range(-max_gap, max_gap)
    at = lambda c, k, o: F.lead(c, k).over(o) if k >= 0 else F.lag(c, -k).over(o)

    def filled(_, o):
        total, weight = F.lit(0.0), F.lit(0.0)
        for k in offsets:
            w = 1.0 / (abs(k) + 1)
            total = total + F.coalesce(at(value, k, o) * w, F.lit(0.0))
            weight = weight + F.when(at(value, k, o).isNotNull(), w).otherwise(0.0)
        return F.coalesce(F.col(value), F.when(weight > 0, total / weight))

    rows = over_time(df, keys, t, -max_gap * step, max_gap * step, {"_f": filled}, bucket)
    ends = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    rows = join_on(rows, ends, keys)
    weights, half = savgol_weights(window, degree), window // 2
    reach = window - 1
    near = lambda _, o: F.array(*[at("_f", k, o) for k in range(-reach, reach + 1)])
    rows = over_time(rows, keys, t, -reach * step, reach * step, {"_near": near}, bucket)
    before, after = (F.col(t) - F.col("_t0")) / step, (F.col("_t1") - F.col(t)) / step

    def dot(i: int) -> Column:
        parts = [F.col("_near")[j - i + reach] * float(weights[i, j]) for j in range(window)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    out = None
    for i in range(half):
        out = F.when(before == i, dot(i)) if out is None else out.when(before == i, dot(i))
        out = out.when(after == i, dot(window - 1 - i))
    return rows.withColumn(name, out.otherwise(dot(half))).drop("_f", "_near", "_t0", "_t1")


def best_per_group(df: DataFrame, group: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per group, by aggregation instead of a ranking window."""
    rest = [c for c in df.columns if c not in group]
    return (df.groupBy(*group).agg(F.min_by(F.struct(*rest), order).alias("_b"))
            .select(*group, *[F.col("_b")[c].alias(c) for c in rest]))
