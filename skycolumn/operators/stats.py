"""Grouped statistics, exact quantiles, histograms, campaign summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skycolumn.functions.scalar import cloud_type, iso0_zone
from skycolumn.operators.ordered import attach_row, floor_div, join_on
from skycolumn.session import cut_lineage

# name -> aggregate; users add their own entries. "std" is the population form.
STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "count": F.count,
}
# quantile statistics, found by ``exact_quantiles`` where a group may be large
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}
# rows of a piece of values that one task ranks
PIECE_ROWS = 1_000_000
# steps per power of two, as a power of two, of the codes that values are cut by
CODE_BITS = 42


# ---- exact quantiles -------------------------------------------------------------------------
def quantiles_from_counts(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                          count: str | None = None) -> DataFrame:
    """Exact quantiles of values with few levels (quantised data).

    Equal values are counted first, on the map side and spread over all tasks; what reaches the
    second aggregation is at most one row per level, e.g. 1051 for reflectivity stored to 0.1 dB.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    names = list(probs)
    found = counts.groupBy(*keys).agg(F.percentile(value, [float(probs[n]) for n in names], F.col("_n")).alias("_q"),
                                      F.sum("_n").alias("_total"))
    out = [F.col("_q")[i].alias(n) for i, n in enumerate(names)]
    return found.select(*keys, *out, *([F.col("_total").alias(count)] if count else []))


def ordered_code(x: Column) -> Column:
    """A LONG for a DOUBLE that never falls where the values rise: the logarithm of the magnitude in steps of 2^-42, negated below
    zero. (A logarithm may be off by its last digit, but it is monotone.) Infinities and NaN come last."""
    a = F.abs(x)
    steps = F.coalesce(F.floor((F.log2(a) + 1076) * float(1 << CODE_BITS)), F.lit(0).cast("long"))
    top = F.lit(2200 << CODE_BITS)
    return F.when(F.isnan(x), top + F.lit(1)).when(a == float("inf"), F.signum(x).cast("long") * top).otherwise(F.signum(x).cast("long") * steps)


def _digits(code: str, shift: int) -> Column:
    """The leading digits of a code: all bits but the last ``shift``."""
    return F.call_function("shiftright", F.col(code), F.lit(shift))


def _of_pieces(coded: DataFrame, pieces: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """Rows whose leading digits are those of a piece. ``pieces`` is a written table of at most two rows per key and rank, so Spark
    knows its size: it is sent to the rows where it is small and meets them in a shuffle where it is not."""
    return coded.withColumn("_piece", _digits("_code", shift)).join(pieces.drop("_size"), [*keys, "_piece"])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                    count: str | None = None, shifts: Sequence[int] = (34, 12), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exact, linearly interpolated quantiles of any DOUBLE column; no group is held by one task.

    Selection by digits: values become order-preserving LONGs, whose leading bits (all but ``shifts[0]``: 256 pieces per power of
    two) are counted on the map side. The sums over the pieces of a key say which of them hold the wanted ranks. While one of these has more
    than ``piece_rows`` rows its rows are counted by the next bits, and what is left is counted by value and
    ranked. Each pass reads the source once and shuffles counts alone; the pieces found are written, one row or two per key and
    rank. ``count`` names a column for the number of values.
    """
    v = F.col(value).cast("double")
    coded = df.filter(v.isNotNull()).select(*keys, v.alias("_v")).withColumn("_code", ordered_code(F.col("_v")))
    # Conditions of the ranks as SQL text: each is one expression, however many quantiles are asked for.
    ranks = {n: f"((_total - 1) * {float(p)!r}D)" for n, p in probs.items()}
    wanted = " OR ".join(f"(ceil({r}) >= _base AND floor({r}) < _base + _size)" for r in ranks.values())
    pieces, at = None, 64
    for shift in shifts:
        inside = coded if pieces is None else _of_pieces(coded, pieces, keys, at).withColumnRenamed("_piece", "_parent")
        parent = [] if pieces is None else ["_parent", "_base", "_total"]
        sizes = inside.groupBy(*keys, *parent, _digits("_code", shift).alias("_piece")).agg(F.count(F.lit(1)).alias("_size"))
        whole = Window.partitionBy(*keys, *parent[:1])
        before = F.coalesce(F.sum("_size").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        placed = sizes.withColumns({"_before": before} if parent else {"_before": before, "_total": F.sum("_size").over(whole)})
        placed = placed.withColumn("_base", F.col("_before") + (F.col("_base") if parent else 0)).filter(wanted)
        largest = Observation()
        pieces, at = cut_lineage(placed.select(*keys, "_piece", "_base", "_total", "_size").observe(largest, F.max("_size").alias("size"))), shift
        if (largest.get["size"] or 0) <= piece_rows:
            break
    counts = _of_pieces(coded, pieces, keys, at).groupBy(*keys, "_piece", "_base", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*keys, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_hi", F.col("_base") + F.sum("_n").over(inside))
    value_at = lambda k: f"max(CASE WHEN _hi - _n <= {k} AND {k} < _hi THEN _v END)"
    found = ranked.groupBy(*keys).agg(*[F.expr(f"struct({value_at(f'floor({r})')} AS a, {value_at(f'ceil({r})')} AS b, max({r} - floor({r})) AS f)").alias(f"_{n}") for n, r in ranks.items()],
                                      *([F.max("_total").alias(count)] if count else []))
    # equal neighbours, infinite ones among them, are taken as they are
    out = [F.expr(f"CASE WHEN _{n}.a = _{n}.b THEN _{n}.a ELSE _{n}.a + (_{n}.b - _{n}.a) * _{n}.f END").alias(n) for n in probs]
    return found.select(*keys, *out, *([count] if count else []))


# ---- grouped statistics ----------------------------------------------------------------------
def group_stats(df: DataFrame, keys: Sequence[str], value: str, stats: Sequence[str], quantised: bool = False,
                bounded: bool = False) -> DataFrame:
    """Registered statistics of one column per key, missing values skipped.

    ``quantised``: few distinct values, quantiles from counts. ``bounded``: groups are small by
    construction (the gates of a profile), so the built-in percentile is used directly.
    """
    plain = [s for s in stats if s not in QUANTILES]
    probs = {s: QUANTILES[s] for s in stats if s in QUANTILES}
    aggs = [STATS[s](F.col(value)).alias(s) for s in plain]
    if bounded:
        aggs += [F.percentile(value, F.lit(p)).alias(s) for s, p in probs.items()]
        return df.groupBy(*keys).agg(*aggs).select(*keys, *stats)
    if not probs:
        return df.groupBy(*keys).agg(*aggs)
    find = quantiles_from_counts if quantised else exact_quantiles
    quantiles = find(df, keys, value, probs)
    if not plain:
        return quantiles
    base = df.groupBy(*keys).agg(*aggs)
    if not keys:
        return attach_row(base, quantiles).select(*stats)
    return base.join(quantiles, list(keys), "left").select(*keys, *stats)


def range_stats(cells: DataFrame, keys: Sequence[str], gate: str, value: str,
                stats: Sequence[str] = ("mean", "min", "max", "std", "median", "count"), **how) -> DataFrame:
    return group_stats(cells, [*keys, gate], value, stats, **how)


def stats_by_numpeaks(cells: DataFrame, keys: Sequence[str], gate: str, peaks: str, value: str,
                      stats: Sequence[str], two_sided: bool = False, most: int = 5) -> DataFrame:
    """Per class of peak number: statistics per gate, then their mean over gates (counts are summed)."""
    n = F.ceil(F.col(peaks) / 2) if two_sided else F.col(peaks).cast("long")
    classed = cells.withColumn("no_peaks", n).filter(F.col("no_peaks").between(1, most))
    per_gate = group_stats(classed, [*keys, "no_peaks", gate], value, stats)
    return per_gate.groupBy(*keys, "no_peaks").agg(
        *[(F.sum(s) if s == "count" else F.avg(s)).alias(s) for s in stats])


def below_top(cells: DataFrame, tops: DataFrame, on: Sequence[str], height: str, top: str) -> DataFrame:
    """Cells strictly below the top of their time."""
    return cells.join(tops.select(*on, top), list(on)).filter(F.col(height) < F.col(top))


def long_stats(stats: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per (keys, stat)."""
    return stats.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(keys), list(names), "stat", "value")


def multi_stats(cells: DataFrame, keys: Sequence[str], values: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """(keys, variable, stat, value) for several variables in one scan."""
    unpivoted = cells.select(*keys, *values).unpivot(list(keys), list(values), "variable", "_v")
    return long_stats(group_stats(unpivoted, [*keys, "variable"], "_v", stats), [*keys, "variable"], stats)


CAMPAIGN_STATS = ("mean", "median", "std", "min", "max", "count")


def campaign_stats(cells: DataFrame, keys: Sequence[str], t: str, gate: str, value: str, day: int, hours: int = 3,
                   mask: Column | None = None, quantised: bool = False) -> dict[str, DataFrame]:
    """The four tables of a campaign: per range, per h-hour step, per day, and over the steps.

    Steps are gate means first; steps without any value are left out; the campaign row is made of
    the steps' unweighted means. ``day`` is one day in units of ``t``.
    """
    masked = cells.withColumn(value, F.when(mask, F.col(value))) if mask is not None else cells
    per_range = group_stats(masked, [*keys, gate], value, CAMPAIGN_STATS, quantised=quantised)

    def steps(width: int) -> DataFrame:
        slot = (F.floor(F.col(t) / width) * width).cast("long")
        means = masked.groupBy(*keys, slot.alias(t), gate).agg(F.avg(value).alias(value)).filter(F.col(value).isNotNull())
        return group_stats(means, [*keys, t], value, CAMPAIGN_STATS, bounded=True)

    hourly, daily = steps(day // 24 * hours), steps(day)
    # one row per step: some thousands for a campaign
    campaign = group_stats(hourly.select(*keys, F.col("mean").alias(value)), keys, value, CAMPAIGN_STATS, bounded=True)
    return {"per_range": per_range, "per_time_hourly": hourly, "per_time_daily": daily, "campaign": campaign}


def campaign_table(tables: Mapping[str, DataFrame], keys: Sequence[str], variable: str, suffix: str = "") -> DataFrame:
    """All campaign tables as (keys, name, at, value); names follow ``<variable>_<stat>_<table><suffix>``."""
    out = None
    for name, table in tables.items():
        at = next((c for c in table.columns if c not in (*keys, *CAMPAIGN_STATS)), None)
        rows = table.withColumn("at", F.col(at).cast("double") if at else F.lit(None).cast("double"))
        rows = long_stats(rows, [*keys, "at"], CAMPAIGN_STATS)
        label = F.concat(F.lit(f"{variable}_"), "stat", F.lit(f"_{name}{suffix}"))
        rows = rows.select(*keys, label.alias("name"), "at", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def cloudtype_summary(cells: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Per time over range, then the mean over time (counts summed); skewness is the population form."""
    q = lambda p: F.percentile(value, F.lit(p))
    skew = F.when(F.stddev_pop(value) > 0, F.skewness(value))
    per_time = cells.groupBy(*keys, t).agg(
        F.max(value).alias("max"), F.avg(value).alias("mean"), q(0.5).alias("median"), F.min(value).alias("min"),
        F.stddev_pop(value).alias("std"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.count(value).alias("count"),
        (q(0.75) - q(0.25)).alias("iqr"), skew.alias("skew"))
    names = ["max", "mean", "median", "min", "std", "q25", "q75", "iqr", "skew"]
    return per_time.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names], F.sum("count").alias("count"))


def daily_monthly_stats(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """min, max, mean per day and month as (keys, period, start, statistic, value)."""
    rows = df.select(*keys, value, F.explode(F.array(
        F.struct(F.lit("day").alias("period"), F.date_trunc("day", ts).cast("timestamp_ntz").alias("start")),
        F.struct(F.lit("month").alias("period"), F.date_trunc("month", ts).cast("timestamp_ntz").alias("start")))).alias("_p"))
    rows = rows.select(*keys, value, "_p.period", "_p.start")
    stats = rows.groupBy(*keys, "period", "start").agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return stats.unpivot([*keys, "period", "start"], ["min", "max", "mean"], "statistic", "value")


# ---- histograms -----------------------------------------------------------------------------
def bin_index(x: Column, lo: float | Column, hi: float | Column, n: int) -> Column:
    """0-based bin of uniform edges, the last edge inclusive; NULL outside, 0 where the edges coincide."""
    width = (hi - lo) / n
    inside = (x >= lo) & (x <= hi)
    return F.when(inside, F.least(F.coalesce(F.floor(F.try_divide(x - lo, F.lit(width) if isinstance(width, float) else width)), F.lit(0)), F.lit(n - 1)).cast("int"))


def hist2d(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: tuple[int, int], limits, weight: Column | None = None) -> DataFrame:
    """Counts (or summed weights) per bin pair."""
    (x0, x1), (y0, y1) = limits
    rows = df.withColumns({"ix": bin_index(F.col(x), x0, x1, bins[0]), "iy": bin_index(F.col(y), y0, y1, bins[1])})
    rows = rows.filter(F.col("ix").isNotNull() & F.col("iy").isNotNull())
    return rows.groupBy(*keys, "ix", "iy").agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("n"))


def _centre(i: str, lo: float, hi: float, n: int) -> Column:
    return lo + (F.col(i) + 0.5) * ((hi - lo) / n)


def cfad(df: DataFrame, keys: Sequence[str], height: str, value: str, bins: tuple[int, int], limits) -> DataFrame:
    """Height by value frequencies with bin centres."""
    (h0, h1), (v0, v1) = limits
    counts = hist2d(df, keys, height, value, bins, limits)
    return counts.select(*keys, _centre("ix", h0, h1, bins[0]).alias(height), _centre("iy", v0, v1, bins[1]).alias(value), "n")


def combine_counts(tables: Sequence[DataFrame], by: Sequence[str], count: str = "n") -> DataFrame:
    """Sum of count tables that share their bins."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out.groupBy(*by).agg(F.sum(count).alias(count))


def hist2d_percent(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: tuple[int, int], limits,
                   floor: float = 0.01) -> DataFrame:
    """Density in percent per unit area; bins below ``floor`` are left out."""
    (x0, x1), (y0, y1) = limits
    area = (x1 - x0) / bins[0] * ((y1 - y0) / bins[1])
    counts = hist2d(df, keys, x, y, bins, limits)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    rows = join_on(counts, totals, keys)
    return rows.withColumn("percent", F.col("n") / (F.col("_n") * area) * 100).filter(F.col("percent") >= floor).drop("_n")


def fd_bins(df: DataFrame, keys: Sequence[str], value: str, most: int = 200, **how) -> DataFrame:
    """Number of histogram bins by the Freedman-Diaconis rule, 10..most; 50 if the IQR is zero."""
    s = group_stats(df, keys, value, ["min", "max", "count", "q25", "q75"], **how)
    iqr = F.col("q75") - F.col("q25")
    width = 2 * iqr / F.pow(F.col("count").cast("double"), F.lit(1 / 3))
    n = F.greatest(F.lit(10), F.least(F.ceil((F.col("max") - F.col("min")) / width), F.lit(most)))
    return s.select(*keys, F.when(iqr == 0, 50).otherwise(n).cast("int").alias("bins"))


def hex_grid_size(df: DataFrame, keys: Sequence[str], x: str, y: str, **how) -> DataFrame:
    """Square root of the product of the two unclamped bin numbers, at least 10."""
    def n_bins(c: str) -> DataFrame:
        s = group_stats(df, keys, c, ["min", "max", "count", "q25", "q75"], **how)
        iqr = F.col("q75") - F.col("q25")
        width = F.when(iqr > 0, 2 * iqr / F.pow(F.col("count").cast("double"), F.lit(1 / 3))).otherwise(1.0)
        return s.select(*keys, F.ceil((F.col("max") - F.col("min")) / width).alias(f"_{c}"))

    both = join_on(n_bins(x), n_bins(y), keys)
    size = F.floor(F.sqrt((F.col(f"_{x}") * F.col(f"_{y}")).cast("double")))
    return both.select(*keys, F.greatest(F.lit(10), size).cast("int").alias("gridsize"))


def hex_bins(df: DataFrame, keys: Sequence[str], x: str, y: str, across: int) -> DataFrame:
    """Density on a lattice of hexagons: per key the hexagons with points, their centre and count.

    The lattice is two rectangular ones, ``across`` cells wide and sqrt(3) times fewer high, the second moved by half a cell both ways; a
    point belongs to the nearer of its two candidate centres (heights count threefold squared, which makes the cells hexagons).
    Edges are the key's extremes; an axis without extent has one cell.
    """
    high = max(1, int(across / 3**0.5))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ends = rows.groupBy(*keys).agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    scaled = lambda v, a, b, n: F.when(F.col(a) == F.col(b), F.lit(0.0)).otherwise((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * n)
    placed = join_on(rows, ends, keys).withColumns({"_u": scaled("_x", "_x0", "_x1", float(across)), "_w": scaled("_y", "_y0", "_y1", float(high))})
    u, w = F.col("_u"), F.col("_w")
    whole = F.struct(F.floor(u + 0.5).cast("double").alias("i"), F.floor(w + 0.5).cast("double").alias("j"))
    half = F.struct((F.floor(u) + 0.5).cast("double").alias("i"), (F.floor(w) + 0.5).cast("double").alias("j"))
    far = lambda c: (u - c["i"]) * (u - c["i"]) + 3 * ((w - c["j"]) * (w - c["j"]))
    cell = F.when(far(whole) < far(half), whole).otherwise(half).alias("_c")
    counts = placed.select(*keys, "_x0", "_x1", "_y0", "_y1", cell).groupBy(*keys, "_c", "_x0", "_x1", "_y0", "_y1").agg(F.count(F.lit(1)).alias("n"))
    back = lambda c, a, b, n: F.col(a) + F.col(c) / n * (F.col(b) - F.col(a))
    return counts.select(*keys, back("_c.i", "_x0", "_x1", float(across)).alias("x"), back("_c.j", "_y0", "_y1", float(high)).alias("y"), "n")


def binned_profile(df: DataFrame, keys: Sequence[str], height: str, value: str, width: float = 100.0,
                   lo: float = -500.0, hi: float = 4900.0, more_than: int = 10) -> DataFrame:
    """Mean per height bin [lo, hi) with more than ``more_than`` samples."""
    h = F.col(height)
    rows = df.filter((h >= lo) & (h < hi) & F.col(value).isNotNull())
    bottom = (F.floor((h - lo) / width) * width + lo).alias("bottom")
    return rows.groupBy(*keys, bottom).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def class_contrast(cells: DataFrame, keys: Sequence[str], over_zero: str, top: str, peaks: str, gradient: str) -> DataFrame:
    """Per cloud type and zone: share of multi-peak cells and mean gradient per kilometre."""
    rows = cells.withColumns({"cloud_type": cloud_type(F.col(top)), "zone": iso0_zone(F.col(over_zero))})
    return rows.filter(F.col("zone").isNotNull()).groupBy(*keys, "cloud_type", "zone").agg(
        F.count(peaks).alias("n"), F.try_divide(F.count_if(F.col(peaks) > 1), F.count(peaks)).alias("multi"),
        (F.avg(gradient) * 1000).alias("gradient_per_km"))


def class_distribution(cells: DataFrame, keys: Sequence[str], zone: str, cloud: str, value: str, bins: int,
                       limits: tuple[float, float]) -> DataFrame:
    """Distribution of a value per cloud type inside each zone: counts per bin and their share of the class."""
    rows = cells.filter(F.col(zone).isNotNull() & F.col(cloud).isNotNull())
    return normalised_hist(rows, [*keys, zone, cloud], value, bins, limits, count="n")


def stratified_density(df: DataFrame, strata: Sequence[str], x: str, y: str, bins: int = 50) -> DataFrame:
    """``bins`` x ``bins`` counts per stratum, edges from the stratum's own extremes."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = rows.groupBy(*strata).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    placed = rows.join(ends, list(strata))
    cut = lambda v, a, b: F.when(F.col(a) == F.col(b), F.lit(0)).otherwise(bin_index(F.col(v), F.col(a), F.col(b), bins))
    placed = placed.withColumns({"ix": cut(x, "_x0", "_x1"), "iy": cut(y, "_y0", "_y1")})
    return placed.groupBy(*strata, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def temperature_bins(t: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open band [edge, next edge); NULL outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        out = F.when((t >= edges[i]) & (t < edges[i + 1]), i).otherwise(out)
    return out


def outlier_share(df: DataFrame, keys: Sequence[str], z: str, height: str) -> DataFrame:
    """Percent of valid cells that are too strong, and too weak above 3 km and the sensitivity curve."""
    v, r = F.col(z), F.col(height)
    low = (v < -20) & (r > 3000) & (r > 100 * v + 5000)
    return df.groupBy(*keys).agg(F.count(z).alias("valid"), (F.try_divide(F.count_if(v > 20), F.count(z)) * 100).alias("high_percent"),
                                 (F.try_divide(F.count_if(low), F.count(z)) * 100).alias("low_percent"))


def flag_hours(df: DataFrame, keys: Sequence[str], flags: Sequence[str], step_hours: float) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.count_if(F.col(f)) * step_hours).alias(f"{f}_hours") for f in flags])


# ---- comparisons ---------------------------------------------------------------------------
def dfr_daily_summary(rows: DataFrame, day: str, ranges: str, dfr: str) -> DataFrame:
    """Per row: min, max, mean of its list, and the day's mean ratio joined back."""
    lo, hi = F.array_min(ranges), F.array_max(ranges)
    mean = F.aggregate(ranges, F.lit(0.0), lambda a, x: a + x) / F.size(ranges)
    daily = rows.groupBy(day).agg(F.avg(dfr).alias("daily_mean_DFR"))
    return rows.withColumns({"top_min": lo, "top_max": hi, "top_avg": mean}).join(daily, day, "left")


def attenuation_summary(table: DataFrame, keys: Sequence[str], elevation: str, pia: str, at: float) -> DataFrame:
    """Extremes of the attenuation at the level nearest to ``at``."""
    gap = F.abs(F.col(elevation) - at)
    nearest = table.select(*keys, elevation).distinct().groupBy(*keys).agg(F.min_by(elevation, F.struct(gap, F.col(elevation))).alias(elevation))
    return table.join(nearest, [*keys, elevation], "left_semi").groupBy(*keys).agg(F.min(pia).alias("min"), F.max(pia).alias("max"))


def normalised_hist(df: DataFrame, keys: Sequence[str], value: str, bins: int, limits: tuple[float, float],
                    count: str | None = None) -> DataFrame:
    """Share of each source's samples per bin, so that sources of different size compare."""
    rows = df.withColumn("bin", bin_index(F.col(value), *limits, bins)).filter(F.col("bin").isNotNull())
    counts = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    return join_on(counts, total, keys).select(*keys, "bin", *([F.col("_n").alias(count)] if count else []), (F.col("_n") / F.col("_t")).alias("share"))


def sounding_bias(a: DataFrame, b: DataFrame, sounding: str, altitude: str, value: str, step: float = 25.0) -> DataFrame:
    """Bias of a against b per altitude of a shared grid: mean and population std over soundings."""
    from skycolumn.operators.regrid import regrid_linear_range
    left = regrid_linear_range(a, [sounding], altitude, [value], step, 0.0)
    right = regrid_linear_range(b, [sounding], altitude, [value], step, 0.0).withColumnRenamed(value, "_b")
    diff = left.join(right, [sounding, altitude]).withColumn("_d", F.col(value) - F.col("_b"))
    return diff.groupBy(altitude).agg(F.avg("_d").alias("bias"), F.stddev_pop("_d").alias("std"), F.count("_d").alias("n"))


# ---- variogram ------------------------------------------------------------------------------
# steps of the resolution in one block of the lag sums, or the largest lag if that is more
LAG_BLOCK = 2048
MOST_LAGS = 1 << 15


def lag_sums(points: DataFrame, keys: Sequence[str], t: str, maxlag: int) -> DataFrame:
    """(keys, lag, d, m) for 0 < lag <= ``maxlag``: over all pairs of rows of a key that far apart, the sum of squared differences and the
    number of pairs.

    ``points`` has one row per (key, t) with the moments n, s, q (count, sum, sum of squares) of the rows at t, a whole number of steps. No pair is
    made: the axis is cut into blocks, each with the ``maxlag`` steps after it, and the sums of a lag are products of
    the moments shifted against each other, lag by lag on dense arrays. What leaves a block is one row per lag.
    """
    if maxlag > MOST_LAGS:
        raise ValueError(f"{maxlag} lags of one step: take a resolution that makes at most {MOST_LAGS}")
    block = max(LAG_BLOCK, maxlag)
    own = floor_div(F.col(t), block)
    rows = points.select(*keys, F.col(t).alias("_t"), "n", "s", "q", F.explode(F.when(F.pmod(F.col(t), F.lit(block)) < maxlag, F.array(own, own - 1)).otherwise(F.array(own))).alias("_b"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group[keys].iloc[:1]
        place = (group["_t"] - group["_b"] * block).to_numpy()
        n, s, q = np.zeros((3, block + maxlag))
        n[place], s[place], q[place] = group["n"], group["s"], group["q"]
        lags = np.arange(1, maxlag + 1)
        a, sa, qa = n[:block], s[:block], q[:block]
        m = np.array([a @ n[k:block + k] for k in lags])
        d = np.array([a @ q[k:block + k] + qa @ n[k:block + k] - 2 * (sa @ s[k:block + k]) for k in lags])
        some = m > 0
        out = pd.DataFrame({"lag": lags[some], "d": d[some], "m": m[some].astype(np.int64)})
        return first.merge(out, how="cross") if keys else out

    keys = list(keys)
    layout = ", ".join([f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys] + ["lag long", "d double", "m long"])
    parts = rows.groupBy(*keys, "_b").applyInPandas(lambda group: run(group)[[*keys, "lag", "d", "m"]], layout)
    return parts.groupBy(*keys, "lag").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))


def variogram(df: DataFrame, keys: Sequence[str], t: str, value: str, bins: int, maxlag: int, resolution: int = 1) -> DataFrame:
    """Half the mean squared difference per lag bin [b, b+1), the mean lag and the pair count.

    Lags are counted in steps of ``resolution`` and are exact where the times are multiples of it; rows within one step are
    no pair. Rows of a step are first reduced to (n, sum, sum of squares): a pair of steps then stands for all pairs of
    their rows, however many there are. Values are centred per key first, so that the sums do not cancel. Bins run over the
    observed lags and leave the largest one out; a key with a single lag has one bin.
    """
    known = df.filter(F.col(value).isNotNull())
    middle = known.groupBy(*keys).agg(F.avg(value).alias("_m"))
    x = F.col(value) - F.col("_m")
    step = F.floor(F.col(t) / resolution).cast("long").alias(t)
    points = join_on(known, middle, keys).groupBy(*keys, step).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    by_lag = lag_sums(points, keys, t, maxlag // resolution).withColumn("lag", (F.col("lag") * resolution).cast("double"))
    ends = by_lag.groupBy(*keys).agg(F.min("lag").alias("_a"), F.max("lag").alias("_b"))
    placed = join_on(by_lag, ends, keys).withColumn("bin", F.coalesce(F.floor(F.try_divide(F.col("lag") - F.col("_a"), (F.col("_b") - F.col("_a")) / bins)), F.lit(0)).cast("int"))
    return placed.filter(F.col("bin") < bins).groupBy(*keys, "bin").agg(
        (F.sum(F.col("lag") * F.col("m")) / F.sum("m")).alias("lag"), (F.sum("d") / F.sum("m") / 2).alias("gamma"), F.sum("m").alias("pairs"))
