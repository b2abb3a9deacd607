"""Moving samples onto regular grids.

On a regular grid a sample knows which targets it can serve, so nearest, mean, vote and linear
regridding are a map step and one hash aggregation (or one neighbour look-up): no join with the grid
and no search. The grid itself is only joined to keep empty steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycolumn.functions.scalar import to_db, to_linear
from skycolumn.operators.asof import asof
from skycolumn.operators.intervals import interval_flag
from skycolumn.operators.ordered import add_neighbours, add_running, attach_row, join_on
from skycolumn.session import cut_lineage


# ---- grids -------------------------------------------------------------------------------------
GRID_CHUNK = 4096


def make_time_grid(bounds: DataFrame, t: str, first: str, last: str, step: int) -> DataFrame:
    """Every grid time of each row's (first, last), made by the executors.

    A campaign's grid comes from a few rows: they are first cut into chunks of steps, and these are
    spread over the tasks before they are expanded.
    """
    rest = [c for c in bounds.columns if c not in (first, last)]
    length = step * GRID_CHUNK
    chunks = bounds.select(*rest, F.col(last).alias("_last"), F.explode(F.sequence(F.col(first), F.col(last), F.lit(length))).alias("_from"))
    chunks = chunks.repartition(int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rest, "_from")
    upto = F.least(F.col("_last"), F.col("_from") + (length - step))
    return chunks.select(*rest, F.explode(F.sequence(F.col("_from"), upto, F.lit(step))).alias(t))


def make_grid(bounds: DataFrame, t: str, first: str, last: str, step: int, axis: str, axis_first: float,
              axis_step: float, axis_n: int) -> DataFrame:
    """Empty time x range grid; the range axis is an inline array."""
    ranges = F.transform(F.sequence(F.lit(0), F.lit(axis_n - 1)), lambda i: axis_first + i * F.lit(axis_step))
    return make_time_grid(bounds, t, first, last, step).withColumn(axis, F.explode(ranges))


def on_grid(values: DataFrame, grid: DataFrame, on: Sequence[str]) -> DataFrame:
    return grid.join(values, list(on), "left")


def _index_down(coord: Column, origin, step) -> Column:
    return F.floor((coord - origin) / step).cast("long")


def _index_up(coord: Column, origin, step) -> Column:
    return F.ceil((coord - origin) / step).cast("long")


def _target(k: Column, origin, step) -> Column:
    return k * F.lit(step) + F.lit(origin)


# ---- nearest -------------------------------------------------------------------------------
def regrid_nearest(df: DataFrame, keys: Sequence[str], coord: str, values: Sequence[str], step, tolerance,
                   origin=0, tie: str = "later", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Nearest sample within ``tolerance`` for each target; ``lo``/``hi`` bound the target index."""
    c = F.col(coord)
    first, last = _index_up(c - tolerance, origin, step), _index_down(c + tolerance, origin, step)
    if lo is not None:
        first = F.greatest(first, F.lit(lo))
    if hi is not None:
        last = F.least(last, F.lit(hi))
    served = F.when(first <= last, F.sequence(first, last))
    rows = df.select(*keys, coord, *values, F.explode(served).alias("_k"))
    target = _target(F.col("_k"), origin, step)
    # distance first; on equal distance the side the tie rule names
    wrong_side = (c < target) if tie == "later" else (c > target)
    order = F.abs(c - target) * 2 + F.when(wrong_side, 1e-9 if isinstance(step, float) else 1).otherwise(0)
    # grouped by the target itself, so that a join with the grid needs no further shuffle
    rows = rows.withColumns({"_d": order, "_t": target}).drop(coord).withColumnRenamed("_t", coord)
    return rows.groupBy(*keys, coord).agg(*[F.min_by(v, "_d").alias(v) for v in values])


def align_to_grid(df: DataFrame, grid: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], step: int,
                  tolerance_factor: float = 0.51, origin: int = 0) -> DataFrame:
    """Every grid time with its nearest sample within a fraction of the step, else NULL."""
    near = regrid_nearest(df, keys, t, values, step, int(tolerance_factor * step), origin)
    return on_grid(near, grid.select(*keys, t), [*keys, t])


def regrid_nearest_range(df: DataFrame, profile: Sequence[str], axis: str, values: Sequence[str], step: float,
                         origin: float, n: int, tolerance: float | None = None) -> DataFrame:
    """Nearest gate for every target of a profile; without tolerance the outer gates reach to the ends."""
    w = Window.partitionBy(*profile).orderBy(axis)
    c = F.col(axis)
    below, above = (c + F.lag(axis).over(w)) / 2, (c + F.lead(axis).over(w)) / 2
    rows = df.select(*profile, axis, *values, below.alias("_a"), above.alias("_b"))
    first = F.coalesce(_index_up(F.col("_a"), origin, step), F.lit(0).cast("long"))
    # a target half-way between two gates belongs to the upper one
    last = F.coalesce(_index_up(F.col("_b"), origin, step) - 1, F.lit(n - 1).cast("long"))
    first, last = F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit(n - 1).cast("long"))
    rows = rows.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last))))
    out = rows.withColumn("_t", _target(F.col("_k"), origin, step))
    if tolerance is not None:
        out = out.filter(F.abs(F.col(axis) - F.col("_t")) <= tolerance)
    return out.select(*profile, F.col("_t").alias(axis), *values)


# ---- means and votes ---------------------------------------------------------------------------
def time_resample(df: DataFrame, keys: Sequence[str], t: str, step: int, db: Sequence[str] = (),
                  mean: Sequence[str] = (), first: Sequence[str] = (), grid: DataFrame | None = None) -> DataFrame:
    """Tumbling means; decibel fields are averaged in linear units, flags take the first sample."""
    slot = (F.floor(F.col(t) / step) * step).cast("long")
    aggs = [to_db(F.avg(to_linear(F.col(c)))).alias(c) for c in db] + [F.avg(c).alias(c) for c in mean]
    aggs += [F.min_by(c, "_at").alias(c) for c in first]
    out = df.withColumn("_at", F.col(t)).withColumn(t, slot).groupBy(*keys, t).agg(*aggs)
    return on_grid(out, grid, [*keys, t]) if grid is not None else out


def bin_average(df: DataFrame, keys: Sequence[str], coord: str, values: Sequence[str], step, origin=0) -> DataFrame:
    """Mean of the samples between the mid-points around each target."""
    k = _index_down(F.col(coord) + step / 2, origin, step)
    return df.withColumn(coord, _target(k, origin, step)).groupBy(*keys, coord).agg(*[F.avg(v).alias(v) for v in values])


def regrid_average_or_nearest(df: DataFrame, keys: Sequence[str], coord: str, values: Sequence[str], step, source_step,
                              tolerance, origin=0, factor: float = 1.5) -> DataFrame:
    """Bin average if the target is clearly coarser than the source, else the nearest sample."""
    if step > factor * source_step:
        return bin_average(df, keys, coord, values, step, origin)
    return regrid_nearest(df, keys, coord, values, step, tolerance, origin)


def majority_vote(df: DataFrame, keys: Sequence[str], coord: str, flag: str, step, tolerance, origin=0,
                  lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Most frequent flag per target, the smallest on ties, -1 if no sample is within ``tolerance``.

    Counts per (target, flag) are combined before the vote, so one crowded target is no hot group.
    """
    k = _index_down(F.col(coord) + step / 2, origin, step)
    if lo is not None:
        k = F.greatest(k, F.lit(lo).cast("long"))
    if hi is not None:
        k = F.least(k, F.lit(hi).cast("long"))
    rows = df.filter(F.col(flag).isNotNull()).withColumn("_k", k)
    rows = rows.withColumn("_d", F.abs(F.col(coord) - _target(F.col("_k"), origin, step)))
    votes = rows.groupBy(*keys, "_k", flag).agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_d"))
    won = votes.groupBy(*keys, "_k").agg(F.max_by(flag, F.struct(F.col("_n"), -F.col(flag))).alias("_v"), F.min("_d").alias("_d"))
    return won.select(*keys, _target(F.col("_k"), origin, step).alias(coord),
                      F.when(F.col("_d") <= tolerance, F.col("_v")).otherwise(-1).alias(flag))


# ---- linear ------------------------------------------------------------------------------------
def _linear(rows: DataFrame, keys: Sequence[str], coord: str, values: Sequence[str], nxt: Mapping[str, str], step,
            origin, max_gap) -> DataFrame:
    """Targets in [sample, next sample): each segment emits its own; the last sample only itself."""
    c, c1 = F.col(coord), F.col(nxt[coord])
    first = _index_up(c, origin, step)
    last = F.coalesce(_index_up(c1, origin, step) - 1, _index_down(c, origin, step))
    rows = rows.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last))))
    target = _target(F.col("_k"), origin, step)
    weight = (target - c) / (c1 - c)
    out = []
    for v in values:
        between = F.col(v) + (F.col(nxt[v]) - F.col(v)) * weight
        if max_gap is not None:
            between = F.when(c1 - c <= max_gap, between)
        out.append(F.when(target == c, F.col(v)).otherwise(between).alias(v))
    return rows.select(*keys, target.alias("_c"), *out).withColumnRenamed("_c", coord)


def regrid_linear_time(df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], step: int, origin: int = 0,
                       max_gap: int | None = None, bucket: int | None = None) -> DataFrame:
    """Linear interpolation in time; NULL brackets give NULL, nothing outside the samples."""
    rows = add_neighbours(df.select(*keys, t, *values).withColumn("_at", F.col(t)), keys, t,
                          next=["_at", *values], bucket=bucket)
    return _linear(rows, keys, t, values, {t: "next__at", **{v: f"next_{v}" for v in values}}, step, origin, max_gap)


def regrid_linear_range(df: DataFrame, profile: Sequence[str], axis: str, values: Sequence[str], step: float,
                        origin: float, max_gap: float | None = None) -> DataFrame:
    """The same along the axis of each profile."""
    w = Window.partitionBy(*profile).orderBy(axis)
    rows = df.select(*profile, axis, *values,
                     *[F.lead(c).over(w).alias(f"_n_{c}") for c in (axis, *values)])
    return _linear(rows, profile, axis, values, {c: f"_n_{c}" for c in (axis, *values)}, step, origin, max_gap)


interp_profile = regrid_linear_range
interp_series = regrid_linear_time


def regrid_mixed(cells: DataFrame, keys: Sequence[str], t: str, axis: str, linear: Sequence[str], flags: Sequence[str],
                 t_step: int, r_step: float, r_origin: float, r_n: int, t_tolerance: int, r_tolerance: float) -> DataFrame:
    """Continuous variables linearly, flags by vote, first in time, then in range; True if the vote is 1."""
    out = regrid_linear_time(cells, [*keys, axis], t, linear, t_step)
    out = regrid_linear_range(out, [*keys, t], axis, linear, r_step, r_origin)
    out = out.filter(F.col(axis) <= r_origin + (r_n - 1) * r_step).filter(F.col(axis) >= r_origin)
    for flag in flags:
        votes = majority_vote(cells, [*keys, axis], t, flag, t_step, t_tolerance)
        votes = votes.withColumn(flag, F.when(F.col(flag) >= 0, F.col(flag)))
        votes = majority_vote(votes, [*keys, t], axis, flag, r_step, r_tolerance, r_origin, 0, r_n - 1)
        out = out.join(votes.withColumn(flag, F.col(flag) == 1), [*keys, t, axis], "left")
    return out


def interp_at(table: DataFrame, points: DataFrame, t: str, axis: str, value: str, point_axis: str,
              name: str) -> DataFrame:
    """Bilinear value of a (time, axis) table at points, with linear extrapolation at all ends.

    The table (a model field: few levels per time) is first brought to the distinct point times,
    then kept as one array pair per time for a bracket search inside the row.
    """
    times = table.select(t).distinct()
    edges = add_neighbours(times.withColumn("_at", F.col(t)), [], t, prev=["_at"], next=["_at"])
    # a single time holds for all times
    end = F.coalesce("next__at", F.when(F.col("prev__at").isNull(), F.col(t)))
    segment = edges.filter(end.isNotNull()).select(F.col(t), F.col(t).alias("_t0"), end.alias("_t1"))
    segment = cut_lineage(segment)  # one row per time of the model field
    # times before the first segment use the first one, times after the last one the last
    first = segment.agg(F.min(t).alias("_first"))
    wanted = attach_row(points.select(t).distinct(), first).withColumns({"_want": F.col(t), t: F.greatest(t, "_first")}).drop("_first")
    placed = asof(wanted, segment, t, [], ["_t0", "_t1"]).drop("matched_t", t).withColumnRenamed("_want", t)
    levels = lambda at, out: table.select(F.col(t).alias(at), axis, F.col(value).alias(out))
    both = placed.join(levels("_t0", "_v0"), "_t0").join(levels("_t1", "_v1"), ["_t1", axis])
    moved = F.when(F.col("_t0") == F.col("_t1"), F.col("_v0")).otherwise(
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(F.col(t) - F.col("_t0"), F.col("_t1") - F.col("_t0")))
    profiles = (both.select(t, axis, moved.alias("_v")).groupBy(t)
                .agg(F.array_sort(F.collect_list(F.struct(axis, "_v"))).alias("_p")))
    joined = points.join(profiles, t, "left")
    n = F.size("_p")
    below = F.size(F.filter("_p", lambda p: p[axis] <= F.col(point_axis)))
    i = F.least(F.greatest(below, F.lit(1)), n - 1)
    lo, hi = F.element_at("_p", i), F.element_at("_p", i + 1)
    at = lo["_v"] + (hi["_v"] - lo["_v"]) * ((F.col(point_axis) - lo[axis]) / (hi[axis] - lo[axis]))
    return joined.withColumn(name, F.when(n >= 2, at)).drop("_p")


def gas_attenuation(cells: DataFrame, table: DataFrame, t: str, height: str, value: str, frequency: float, station: float,
                    name: str = "corrected", tolerance: float = 1.0) -> DataFrame:
    """Reflectivity plus the path attenuation of a model field (``t``, elevation, frequency, pia) at its time and height.

    The field's frequency is the given one, else the nearest within ``tolerance`` GHz, else the job fails; levels below
    the station are left out. A field without rows gives NULL.
    """
    gap = F.abs(F.col("frequency") - frequency)
    nearest = table.agg(F.min_by("frequency", F.struct(gap, "frequency")).alias("_f"), F.min(gap).alias("_gap"))
    known = F.when(F.col("_gap") > tolerance, F.raise_error(F.lit(f"no frequency within {tolerance} GHz of {frequency}")).cast("double")).otherwise(F.col("_f"))
    picked = attach_row(table, nearest.select(known.alias("_f"))).filter((F.col("frequency") == F.col("_f")) & (F.col("elevation") >= station))
    levels = picked.select(t, (F.col("elevation") - station).alias("_height"), "pia")
    found = interp_at(levels, cells, t, "_height", "pia", height, "_pia")
    return found.withColumn(name, F.col(value) + F.col("_pia")).drop("_pia")


# ---- checks, blocks, edges ---------------------------------------------------------------------
def needs_resampling(df: DataFrame, keys: Sequence[str], t: str, step: int, first: int, n: int, tolerance: int) -> DataFrame:
    """Per key: does the axis differ from first + i*step (i < n) in length or by more than tolerance?"""
    ranked = add_running(df.select(*keys, t), keys, t, {"_i": ("sum", F.lit(1))})
    off = F.abs(F.col(t) - (F.lit(first) + (F.col("_i") - 1) * step))
    stats = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(off).alias("_off"))
    return stats.select(*keys, ((F.col("_n") >= 2) & ((F.col("_n") != n) | (F.col("_off") > tolerance))).alias("resample"))


def coarsen(cells: DataFrame, keys: Sequence[str], t: str, gate: str, step: int, by_t: int, by_gate: int,
            mean: Sequence[str] = (), maximum: Sequence[str] = ()) -> DataFrame:
    """Blocks of ``by_t`` x ``by_gate`` cells of the complete grid; incomplete blocks are dropped.

    Blocks are counted from each key's first time.
    """
    start = cells.groupBy(*keys).agg(F.min(t).alias("_t0"))
    rows = join_on(cells, start, keys)
    rows = rows.withColumns({"_bt": F.floor((F.col(t) - F.col("_t0")) / (step * by_t)), "_bg": F.floor(F.col(gate) / by_gate)})
    out = rows.groupBy(*keys, "_bt", "_bg").agg(
        F.min(t).alias(t), F.min(gate).alias(gate), F.count(F.lit(1)).alias("_n"),
        *[F.avg(c).alias(c) for c in mean], *[F.max(c).alias(c) for c in maximum])
    return out.filter(F.col("_n") == by_t * by_gate).drop("_bt", "_bg", "_n")


def rebin_mask(df: DataFrame, keys: Sequence[str], coord: str, mask: str, width, origin=0) -> DataFrame:
    """True where at least half of the samples of a bin are set."""
    k = _index_down(F.col(coord), origin, width)
    return (df.withColumn("_k", k).groupBy(*keys, "_k").agg((F.avg(F.col(mask).cast("double")) >= 0.5).alias(mask))
            .select(*keys, _target(F.col("_k"), origin, width).alias(coord), mask))


def bin_edges(axis: DataFrame, key: Sequence[str], centre: str) -> DataFrame:
    """Edges around the centres of an axis table: mid-points, and half a step beyond the ends."""
    w = Window.partitionBy(*key).orderBy(centre)
    c, prev, nxt = F.col(centre), F.lag(centre).over(w), F.lead(centre).over(w)
    lower = F.when(prev.isNull(), c - (nxt - c) / 2).otherwise((prev + c) / 2)
    upper = F.when(nxt.isNull(), c + (c - prev) / 2).otherwise((c + nxt) / 2)
    return axis.select(*key, centre, lower.alias("lower"), upper.alias("upper"))


def resize_spectrum(power: Column, size: int) -> Column:
    """Linear interpolation of an array onto ``size`` equally spaced positions."""
    n = F.size(power)

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.lit(float(size - 1))
        lo = F.least(F.floor(x).cast("int"), n - 2)
        a, b = F.get(power, lo), F.get(power, lo + 1)
        return a + (b - a) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def flatten_sweep(df: DataFrame, keys: Sequence[str], t: str, means: Sequence[str]) -> DataFrame:
    """Mean over sweeps and repeated times."""
    return df.groupBy(*keys, t).agg(*[F.avg(c).alias(c) for c in means])


def collapse_doppler(power: Column, how: str) -> Column:
    if how == "max":
        return F.array_max(power)
    return F.aggregate(power, F.lit(0.0), lambda a, x: a + x) / F.size(power)


def harmonise_modes(cells: DataFrame, profile: Sequence[str], axis: str, step: float, origin: float, n: int,
                    db: Sequence[str] = (), velocity: Sequence[str] = (), masks: Sequence[str] = (),
                    two_gate: bool = False, tolerance: float = 13.0) -> DataFrame:
    """Bring one mode onto the common range axis.

    Decibel values are averaged and interpolated in linear units; masks take the nearest gate, after
    the maximum of gate pairs if the mode has half the gate length (``two_gate``).
    """
    rows = cells.withColumns({c: to_linear(F.col(c)) for c in db})
    w = Window.partitionBy(*profile).orderBy(axis)
    flags = rows.select(*profile, axis, *masks)
    if two_gate:
        pair = w.rowsBetween(-1, 0)
        rows = rows.withColumns({c: F.avg(c).over(pair) for c in (*db, *velocity)})
        flags = flags.withColumn("_b", F.floor((F.row_number().over(w) - 1) / 2))
        flags = (flags.groupBy(*profile, "_b").agg(F.avg(axis).alias(axis), F.count(F.lit(1)).alias("_n"),
                                                  *[F.max(c).alias(c) for c in masks])
                 .filter(F.col("_n") == 2).drop("_b", "_n"))
    smooth = regrid_linear_range(rows, profile, axis, [*db, *velocity], step, origin)
    smooth = smooth.filter(F.col(axis).between(origin, origin + (n - 1) * step))
    smooth = smooth.withColumns({c: to_db(F.col(c)) for c in db})
    if masks:
        near = regrid_nearest_range(flags, profile, axis, masks, step, origin, n, tolerance)
        smooth = smooth.join(near, [*profile, axis], "left")
    return smooth


def zenith_merge(rows: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], source: str,
                 grid: DataFrame) -> DataFrame:
    """Nearest sample for every grid time, then NULL outside the time spans of the source files."""
    spans = rows.groupBy(*keys, source).agg(F.min(t).alias("start"), F.max(t).alias("end"))
    near = asof(grid, rows.select(*keys, t, *values), t, keys, values, "nearest", None, "later").drop("matched_t")
    marked = interval_flag(near, spans, t, keys, "_in")
    return marked.select(*keys, t, *[F.when(F.col("_in"), F.col(v)).alias(v) for v in values])
