"""Calibration of one instrument against another, for a whole campaign in one job.

``keys`` name what is calibrated separately (date, instrument pair). Everything per point is a
filter or a hash aggregation; searches run on at most some hundred moment bins per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycolumn.operators.ordered import attach_row
from skycolumn.operators.profiles import cloudtop_depth, layer_mask
from skycolumn.operators.stats import bin_index, exact_quantiles
from skycolumn.operators.windows import rolling_var_2d
from skycolumn.session import cut_lineage

# Accepted slope, r squared, least share of the points, ladder step (dB).
SLOPE_LIMITS = (0.85, 1.15)
RSQ_LIMITS = (0.8, 1.0)
MIN_SHARE = 0.6
STEP_DB = 2.0
FOUND, NOT_FOUND = 1, -5


def pairwise_valid(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def sensitivity_filter(df: DataFrame, a: str, b: str, limit: float = -10.0, intercept: float | None = None) -> DataFrame:
    """Keep b >= -a + limit and, if asked for, b >= a + intercept."""
    kept = df.filter(F.col(b) >= -F.col(a) + limit)
    return kept.filter(F.col(b) >= F.col(a) + intercept) if intercept is not None else kept


def range_selection(df: DataFrame, a: str, b: str, lower: Column, upper: Column, name: str = "inside") -> DataFrame:
    """Flag points between the anti-diagonals b = -a + lower and b = -a + upper."""
    s = F.col(a) + F.col(b)
    return df.withColumn(name, (s >= lower) & (s <= upper))


_MOMENTS = ("n", "sa", "sb", "qa", "qb", "qab")


def _moments(a: Column, b: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("qa"),
            F.sum(b * b).alias("qb"), F.sum(a * b).alias("qab")]


def _fit(df: DataFrame) -> DataFrame:
    """Slope, r squared and rmse of the regression of b on a from moments."""
    n = F.col("n").cast("double")
    sxx = F.col("qa") - F.col("sa") * F.col("sa") / n
    syy = F.col("qb") - F.col("sb") * F.col("sb") / n
    sxy = F.col("qab") - F.col("sa") * F.col("sb") / n
    out = df.withColumns({"_xx": sxx, "_yy": syy, "_xy": sxy})
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx"))
    rsq = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") * F.col("_xy") / (F.col("_xx") * F.col("_yy")))
    left = F.when(F.col("_xx") > 0, F.greatest(F.col("_yy") - F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx")), F.lit(0.0)))
    return out.withColumns({"slope": slope, "r_squared": rsq, "rmse": F.sqrt(left / n)}).drop("_xx", "_yy", "_xy")


def _ladder(bins: DataFrame, keys: Sequence[str], carry: Sequence[str], last_step: Column) -> DataFrame:
    """Moments of every candidate k = 0..last_step: the sum over bins >= k (a hundred bins at most)."""
    steps = bins.groupBy(*keys, *carry).agg(F.max("_k").alias("_top"))
    steps = steps.select(*keys, *carry, F.explode(F.sequence(F.lit(0).cast("long"), last_step)).alias("_k"))
    up = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    joined = steps.join(bins.drop(*carry), [*keys, "_k"], "full")
    summed = joined.withColumns({m: F.sum(m).over(up) for m in _MOMENTS})
    return summed.filter(F.col(carry[0]).isNotNull())


def range_limits(pairs: DataFrame, keys: Sequence[str], a: str, b: str, cut: float = 0.025) -> DataFrame:
    """Best band of a+b for the regression of b on a, one row per key.

    The band starts at the outer quantiles of a+b. Its upper limit is lowered in 2 dB steps, then,
    from the upper limit that was last an improvement, the lower limit is raised. A candidate needs
    60 % of the points; the smallest rmse within the slope and r squared limits wins
    (``solution_found`` 1), else the largest r squared, then the smallest rmse (-5).
    """
    s = F.col(a) + F.col(b)
    points = pairwise_valid(pairs, a, b).withColumn("_s", s)
    # one row per key; cut here so that the two search passes do not repeat the quantiles
    ends = cut_lineage(exact_quantiles(points, keys, "_s", {"_i0": cut, "_j0": 1 - cut}, "_total"))

    def candidates(bins: DataFrame, last_step: Column, i: Column, j: Column, phase: int) -> DataFrame:
        rows = _fit(_ladder(bins, keys, ["_i0", "_j0", "_jb", "_total"], last_step))
        rows = rows.withColumns({"i": i, "j": j, "share": F.col("n") / F.col("_total"), "phase": F.lit(phase)})
        good = F.coalesce(F.col("slope").between(*SLOPE_LIMITS) & F.col("r_squared").between(*RSQ_LIMITS), F.lit(False))
        return rows.filter(F.col("share") > MIN_SHARE).withColumn("_good", good)

    k = F.col("_k")

    def step(distance: Column, inside) -> Column:
        """Largest k whose limit still holds the point, with the limits' own rounding."""
        k0 = F.floor(distance / STEP_DB)
        return F.when(inside(k0 + 1), k0 + 1).when(inside(k0), k0).otherwise(k0 - 1)

    band = points.join(ends, list(keys)).filter(F.col("_s").between(F.col("_i0"), F.col("_j0")))
    lowered = (band.withColumn("_jb", F.col("_j0")).groupBy(*keys, "_i0", "_j0", "_jb", "_total",
                                                            step(F.col("_j0") - F.col("_s"), lambda n: F.col("_s") <= F.col("_j0") - n * STEP_DB).alias("_k"))
               .agg(*_moments(F.col(a), F.col(b))))
    # lowered until at most one step of band is left
    steps_j = F.greatest(F.ceil((F.col("_j0") - F.col("_i0")) / STEP_DB - 1), F.lit(0)).cast("long")
    first = candidates(lowered, steps_j, F.col("_i0"), F.col("_j0") - k * STEP_DB, 0)
    first = cut_lineage(first)  # a hundred rows per key at most
    order = F.struct(F.col("rmse"), k)
    best = first.groupBy(*keys).agg(F.min_by("_k", order).alias("_any"),
                                    F.min_by(F.when(F.col("_good"), k), F.when(F.col("_good"), order)).alias("_ok"))
    turn = ends.join(best, list(keys), "left").withColumn(
        "_jb", F.col("_j0") - F.greatest(F.coalesce("_any", F.lit(0)), F.coalesce("_ok", F.lit(0))) * STEP_DB).drop("_any", "_ok")
    band = points.join(turn, list(keys)).filter(F.col("_s").between(F.col("_i0"), F.col("_jb")))
    raised = (band.groupBy(*keys, "_i0", "_j0", "_jb", "_total", step(F.col("_s") - F.col("_i0"), lambda n: F.col("_s") >= F.col("_i0") + n * STEP_DB).alias("_k"))
              .agg(*_moments(F.col(a), F.col(b))))
    steps_i = F.greatest(F.ceil((F.col("_jb") - F.col("_i0")) / STEP_DB - 2), F.lit(0)).cast("long")
    second = candidates(raised, steps_i, F.col("_i0") + k * STEP_DB, F.col("_jb"), 1)

    names = ["i", "j", "slope", "r_squared", "rmse", "share"]
    found = first.select(*keys, *names, "phase", "_k", "_good").unionByName(second.select(*keys, *names, "phase", "_k", "_good"))
    rank = F.struct((~F.col("_good")).cast("int"), F.when(F.col("_good"), F.lit(0.0)).otherwise(-F.col("r_squared")),
                    F.col("rmse"), F.col("phase"), k)
    chosen = found.groupBy(*keys).agg(F.min_by(F.struct(*names, "_good"), rank).alias("_c"))
    return chosen.select(*keys, *[F.col(f"_c.{n}").alias(n) for n in names],
                         F.when(F.col("_c._good"), FOUND).otherwise(NOT_FOUND).alias("solution_found"))


def density_filter(pairs: DataFrame, keys: Sequence[str], a: str, b: str, percentile: float = 0.025,
                   bins: int = 100) -> DataFrame:
    """Drop points whose cell of a 2-D histogram is no denser than the percentile of point densities."""
    points = pairwise_valid(pairs, a, b)
    ends = points.groupBy(*keys).agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
    placed = points.join(ends, list(keys)).withColumns({
        "_ia": bin_index(F.col(a), F.col("_a0"), F.col("_a1"), bins), "_ib": bin_index(F.col(b), F.col("_b0"), F.col("_b1"), bins)})
    cells = placed.groupBy(*keys, "_ia", "_ib").agg(F.count(F.lit(1)).alias("_n"))
    # every point of a cell has the density n: n weighted by n, at most bins**2 cells per key
    bound = cells.groupBy(*keys).agg(F.percentile("_n", F.lit(percentile), F.col("_n")).alias("_bound"))
    dense = cells.join(bound, list(keys)).filter(F.col("_n") > F.col("_bound")).select(*keys, "_ia", "_ib")
    return placed.join(dense, [*keys, "_ia", "_ib"], "left_semi").drop("_a0", "_a1", "_b0", "_b1", "_ia", "_ib")


def fit_offset(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Offset of a fit with slope 1: mean difference, population spread, correlation."""
    d = F.col(b) - F.col(a)
    return pairs.groupBy(*keys).agg(F.avg(d).alias("offset"), F.stddev_pop(d).alias("spread"),
                                    F.corr(a, b).alias("correlation"), F.count(F.lit(1)).alias("n_used"))


def calibrate(pairs: DataFrame, keys: Sequence[str], a: str, b: str, limit: float | None = -10.0,
              intercept: float | None = None) -> DataFrame:
    """Filters, band search, density filter and offset: one calibration row per key."""
    valid = pairwise_valid(pairs, a, b)
    if limit is not None:
        valid = sensitivity_filter(valid, a, b, limit, intercept)
    limits = cut_lineage(range_limits(valid, keys, a, b))  # one row per key
    inside = range_selection(valid.join(limits.select(*keys, "i", "j"), list(keys)), a, b, F.col("i"), F.col("j"))
    offset = fit_offset(density_filter(inside.filter("inside"), keys, a, b), keys, a, b)
    total = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    rows = limits.drop("share").join(offset, list(keys)).join(total, list(keys))
    return rows.withColumn("share_used", F.col("n_used") / F.col("_total")).drop("_total", "n_used")


# ---- results of many calibrations -----------------------------------------------------------
def preferred_rows(rows: DataFrame, date: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(used, excluded): per date the lowest rmse among solutions, or among the rest if there is none.

    Excluded are results without solution on dates that have one, and all but the first row (by
    ``order``) of dates with several candidates.
    """
    solved = rows.filter(F.col("solution_found") == FOUND).select(date).distinct()
    failed = rows.filter(F.col("solution_found") == NOT_FOUND)
    candidates = rows.filter(F.col("solution_found") == FOUND).unionByName(failed.join(solved, date, "left_anti"))
    rest = [c for c in rows.columns if c != date]
    used = (candidates.groupBy(date).agg(F.min_by(F.struct(*rest), F.struct("rmse", order)).alias("_r"))
            .select(date, *[F.col("_r")[c].alias(c) for c in rest]))
    first = candidates.groupBy(date).agg(F.min(order).alias("_first"))
    again = candidates.join(first, date).filter(F.col(order) > F.col("_first")).drop("_first")
    return used, failed.join(solved, date, "left_semi").unionByName(again)


def calib_stats(rows: DataFrame, date: str, order: str, constant: str) -> DataFrame:
    """One row: means, sample spreads and counts of used, solved, unsolved and all results."""
    used, excluded = preferred_rows(rows, date, order)
    c = F.col(constant)
    solved, failed = F.col("solution_found") == FOUND, F.col("solution_found") == NOT_FOUND
    per_date = rows.groupBy(date).agg(F.count_if(failed).alias("_f"))
    overall = rows.agg(
        F.avg(F.when(solved, c)).alias("solution_mean"), F.stddev_samp(F.when(solved, c)).alias("solution_std"),
        F.avg(F.when(failed, c)).alias("no_solution_mean"), F.stddev_samp(F.when(failed, c)).alias("no_solution_std"),
        F.avg(c).alias("all_mean"), F.stddev_samp(c).alias("all_std"), F.count(F.lit(1)).alias("total_entries"))
    chosen = used.agg(F.avg(c).alias("included_mean"), F.stddev_samp(c).alias("included_std"),
                      F.count(F.lit(1)).alias("priority_entries"))
    left = excluded.agg(F.count(F.lit(1)).alias("excluded_entries"))
    failures = per_date.agg(F.count_if(F.col("_f") == 1).alias("single_entries_no_solution"),
                            F.coalesce(F.sum(F.when(F.col("_f") > 1, F.col("_f"))), F.lit(0)).alias("multi_entries_no_solution"))
    return attach_row(attach_row(attach_row(overall, chosen), left), failures)


def calibration_timeline(rows: DataFrame, date: str, order: str, start: str, end: str, hour: int) -> DataFrame:
    """Used and excluded results with their total hours."""
    used, excluded = preferred_rows(rows, date, order)
    both = used.withColumn("used", F.lit(True)).unionByName(excluded.withColumn("used", F.lit(False)))
    return both.groupBy("used").agg(F.count(F.lit(1)).alias("entries"), (F.sum(F.col(end) - F.col(start)) / hour).alias("hours"))


# ---- ratio of two instruments at the layer top ----------------------------------------------
def cloudtop_dfr(w: DataFrame, ka: DataFrame, t: str, gate: str, value: str, window: int, step: int, depth_gates: int,
                 selected_gates: int, box: tuple[int, int, int], variance_limit: float, min_values: int = 10,
                 min_points: int | None = None, min_correlation: float | None = None,
                 min_ratio: float | None = None) -> DataFrame:
    """Mean ratio ka - w per half-open time window from the upper part of the layers both see.

    Both inputs hold the complete grid, NULL where there is no echo.
    Optional checks: number of points, correlation, share of box variances above the limit.
    ``box`` is (times, gates, least number of values).
    """
    both = w.select(t, gate, F.col(value).alias("_w")).join(ka.select(t, gate, F.col(value).alias("_ka")), [t, gate])
    seen = F.col("_w").isNotNull() & F.col("_ka").isNotNull()
    layers = cloudtop_depth(both, [t], gate, seen, depth_gates, selected_gates)
    top = layer_mask(both, layers, [t], gate, "from_gate", "to_gate").withColumn("in_layer", F.col("in_layer") & seen)
    top = top.select(t, gate, (F.floor(F.col(t) / window) * window).cast("long").alias("window"),
                     *[F.when(F.col("in_layer"), F.col(c)).alias(c) for c in ("_w", "_ka")])
    top = top.withColumn("dfr", F.col("_ka") - F.col("_w"))
    times, gates, least = box
    spread = rolling_var_2d(top, ["window"], t, gate, "dfr", step, times, gates, least, "_var")
    ratio = F.count_if(F.col("_var") > variance_limit) / F.count("_var")
    out = spread.groupBy("window").agg(
        F.count("dfr").alias("n"), F.avg("dfr").alias("mean_dfr"), F.corr("_ka", "_w").alias("correlation"),
        F.coalesce(F.when(F.count("_var") > 0, ratio), F.lit(0.0)).alias("ratio"))
    out = out.filter(F.col("n") >= (min_points or min_values))
    if min_correlation is not None:
        out = out.filter(F.col("correlation") >= min_correlation)
    return out.filter(F.col("ratio") >= min_ratio) if min_ratio is not None else out


def calibrated_ratio(ratio: Column, offset: float, lo: float, hi: float) -> Column:
    """Calibrated ratio; values outside the plotted range are left out."""
    moved = ratio + offset
    return F.when(moved.between(lo, hi), moved)


def scan_guard(rays: DataFrame, scan: str, t: str, nominal: float, longest: float = 2.0, shortest: float = 0.5,
               flagged: Column | None = None, unit: float = 1.0) -> DataFrame:
    """One row per scan with the reason it is left out (NULL: kept)."""
    span = (F.max(t) - F.min(t)) / unit
    start = F.min(t).alias("start")
    share = F.avg(flagged.cast("double")) if flagged is not None else F.lit(0.0)
    scans = rays.groupBy(scan).agg(start, span.alias("duration"), share.alias("flagged"), F.count(F.lit(1)).alias("rays"))
    reason = (F.when(F.col("duration") > longest * nominal, "too long").when(F.col("duration") < shortest * nominal, "too short")
              .when(F.col("flagged") >= 0.5, "flagged"))
    return scans.withColumn("reason", reason)


def exclude_scans(scans: DataFrame, scan: str, start: str, outages: DataFrame, processed: DataFrame) -> DataFrame:
    """Reasons that come before those of ``scan_guard``: the scan starts in an outage, or its result is there already."""
    from skycolumn.operators.intervals import interval_flag

    flagged = interval_flag(scans, outages, start, [], "_lost")
    done = processed.select(scan).distinct().withColumn("_done", F.lit(True))
    reason = (F.when(F.col("_lost"), "frequency lost").when(F.col("_done"), "already processed").otherwise(F.col("reason")))
    return flagged.join(done, scan, "left").withColumn("reason", reason).drop("_lost", "_done")
