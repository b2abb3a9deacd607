"""Runs, intervals and events on long series, in two levels (bucket, then summary)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycolumn.operators.asof import on_times
from skycolumn.operators.ordered import (
    BUCKET, HOUR, MINUTE, add_groups, add_neighbours, add_running, attach_row, bucket_width, edges_of, enter, floor_div, halo, in_bucket,
    join_summary, owned, scan_summary)


# ---- runs --------------------------------------------------------------------------------------
def add_run(df: DataFrame, keys: Sequence[str], order: str, state: str, name: str = "run",
            bucket: int | None = None) -> DataFrame:
    """``name``: order value at which the run of equal ``state`` began."""
    same = lambda prev, row: prev("_at").isNotNull() & prev(state).eqNullSafe(row(state))
    return add_groups(df, keys, order, same, [state], name, bucket)


def runs(df: DataFrame, keys: Sequence[str], order: str, state: str, bucket: int | None = None,
         extra: Sequence[Column] = ()) -> DataFrame:
    """One row per run: keys, state, start, end, n and any ``extra`` aggregates."""
    return (add_run(df, keys, order, state, "_run", bucket).groupBy(*keys, "_run", state)
            .agg(F.max(order).alias("end"), F.count(F.lit(1)).alias("n"), *extra)
            .withColumnRenamed("_run", "start"))


def add_run_in_group(df: DataFrame, group: Sequence[str], order: str, state: str, name: str = "run_length") -> DataFrame:
    """Run length inside a group that is bounded by construction (the gates of a profile)."""
    w = Window.partitionBy(*group).orderBy(order)
    change = (~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("int")
    ids = df.withColumn("_id", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ids.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*group, "_id"))).drop("_id")


def mask_to_intervals(df: DataFrame, keys: Sequence[str], t: str, flag: str, fill: int | None = None,
                      bucket: int | None = None) -> DataFrame:
    """Runs of True as (start, end, n), both inclusive; False runs of at most ``fill`` rows count as True."""
    bucket = bucket or bucket_width(df, keys, t)
    state = df.select(*keys, t, F.coalesce(F.col(flag), F.lit(False)).alias("_on"))
    found = runs(state, keys, t, "_on", bucket)
    if fill:
        found = found.withColumn("_on", F.col("_on") | (F.col("n") <= fill))
        found = (add_run(found, keys, "start", "_on", "_run", bucket).groupBy(*keys, "_run", "_on")
                 .agg(F.max("end").alias("end"), F.sum("n").alias("n")).withColumnRenamed("_run", "start"))
    return found.filter("_on").select(*keys, "start", "end", "n")


def keep_runs(df: DataFrame, keys: Sequence[str], order: str, valid: str, n: int, step: int = 1,
              bounded: bool = False, bucket: int | None = None) -> DataFrame:
    """Set ``valid`` to False in runs shorter than ``n`` samples along a regular axis."""
    if bounded:
        out = add_run_in_group(df, keys, order, valid, "_len")
        length = F.col("_len")
        return out.withColumn(valid, F.col(valid) & (F.col("_len") >= n)).drop("_len")
    # rows further than n-1 steps into a run are safe; the others need their run's length, which is
    # bounded by looking n-1 steps ahead
    out = add_run(df, keys, order, valid, "_since", bucket)
    reach = (n - 1) * step
    rows = halo(out, keys, order, 0, reach, bucket)
    ahead = Window.partitionBy(*keys, BUCKET, "_since").orderBy(order).rangeBetween(0, reach)
    rows = owned(rows.withColumn("_until", F.max(order).over(ahead)))
    long_enough = F.col("_until") - F.col("_since") >= reach
    return rows.withColumn(valid, F.col(valid) & long_enough).drop("_since", "_until")


def clean_mask(cells: DataFrame, keys: Sequence[str], t: str, gate: str, value: str, min_gates: int,
               min_steps: int, step: int, bucket: int | None = None) -> DataFrame:
    """``clean``: valid and part of a long enough run on both axes of the complete grid."""
    rows = cells.withColumns({"_v": F.col(value).isNotNull(), "_w": F.col(value).isNotNull()})
    rows = keep_runs(rows, [*keys, t], gate, "_v", min_gates, bounded=True)
    rows = keep_runs(rows, [*keys, gate], t, "_w", min_steps, step, bucket=bucket)
    return rows.withColumn("clean", F.col("_v") & F.col("_w")).drop("_v", "_w")


def longest_run(df: DataFrame, keys: Sequence[str], order: str, flag: str, bucket: int | None = None) -> DataFrame:
    """Longest run of True per key, the first one on ties."""
    found = mask_to_intervals(df, keys, order, flag, bucket=bucket)
    best = F.max_by(F.struct("start", "end", "n"), F.struct(F.col("n"), -F.col("start")))
    return found.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.start", "_b.end", "_b.n")


# ---- interval sets ---------------------------------------------------------------------------
def add_merge_group(intervals: DataFrame, keys: Sequence[str], start: str, end: str, gap: int,
                    bucket: int | None = None) -> DataFrame:
    """``group``: start of the merged interval each interval belongs to; (keys, start) is unique.

    Inside a bucket a row opens a group if nothing before it reaches within ``gap``. What reaches in
    from earlier buckets (a running maximum over bucket summaries) closes the openings up to
    ``reach + gap``; starts only grow, so later openings of the bucket stand as they are.
    """
    rows, kept = enter(intervals, keys, start, bucket)
    inside = in_bucket(keys, start)
    up = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_fresh", F.when(reach.isNull() | (F.col(start) - reach > gap), F.col(start)))
    edge = edges_of(rows, keys, [F.max(end).alias("_far"), F.max("_fresh").alias("_last")])
    edge = scan_summary(edge, keys, {"_reach": ("max", F.col("_far"))})
    stands = F.col("_reach").isNull() | (F.col("_last") - F.col("_reach") > gap)
    edge = scan_summary(edge.select(*keys, BUCKET, "_reach", F.when(stands, F.col("_last")).alias("_open")), keys, {"_in": ("last", F.col("_open"))})
    edge = edge.select(*keys, BUCKET, "_reach", "_in")
    out = join_summary(rows, edge, keys)
    real = F.when(F.col("_reach").isNull() | (F.col("_fresh") - F.col("_reach") > gap), F.col("_fresh"))
    out = out.withColumn("group", F.coalesce(F.last(real, True).over(up), F.col("_in")))
    drop = ["_fresh", "_reach", "_in"]
    return out.drop(*drop) if kept else out.drop(BUCKET, *drop)


def merge_close(intervals: DataFrame, keys: Sequence[str], gap: int, start: str = "start", end: str = "end",
                bucket: int | None = None) -> DataFrame:
    """Join intervals that overlap or are at most ``gap`` apart."""
    unique = intervals.groupBy(*keys, start).agg(F.max(end).alias(end))
    return (add_merge_group(unique, keys, start, end, gap, bucket).groupBy(*keys, "group")
            .agg(F.max(end).alias(end)).withColumnRenamed("group", start).select(*keys, start, end))


def interval_flag(points: DataFrame, intervals: DataFrame, t: str, keys: Sequence[str], name: str = "inside",
                  bucket: int | None = None) -> DataFrame:
    """True where a point lies in any interval, ends included.

    That is so if the running maximum of ``end`` over all intervals that start at or before t is at
    least t; the flag is found on the distinct times and joined back.
    """
    starts = intervals.groupBy(*keys, F.col("start").alias(t)).agg(F.max("end").alias("_end"))
    times = points.select(*keys, t).distinct().withColumn("_end", F.lit(None).cast("long"))
    both = (times.withColumn("_o", F.col(t) * 2 + 1)
            .unionByName(starts.withColumn("_o", F.col(t) * 2)))
    found = add_running(both, keys, "_o", {"_reach": ("max", F.col("_end"))}, 2 * bucket if bucket else None)
    inside = F.coalesce(F.col("_reach") >= F.col(t), F.lit(False))
    return on_times(points, found.filter("_o % 2 = 1").select(*keys, t, inside.alias(name)), keys, t)


intervals_to_mask = interval_flag


def _level(length: Column, width: int) -> Column:
    """Smallest level whose slots, ``width`` times a power of two, are as long as the interval, give or take a rounding."""
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double") / width)), F.lit(0)).cast("int")


def _slot(value: Column, level: Column, width: int) -> Column:
    return floor_div(value, F.call_function("shiftleft", F.lit(width).cast("long"), level))


def interval_join(points: DataFrame, intervals: DataFrame, t: str, keys: Sequence[str], width: int) -> DataFrame:
    """Every (point, interval) pair with start <= t <= end, by equality on slots of ``width`` times powers of two.

    An interval goes to the level whose slots are just longer than it is, where it touches two (three after a rounding), however long it
    is. A point asks for its slot on each level that any interval uses, at most 64 and few in practice; a
    slot's candidates are at most four interval lengths away. A hot slot is split by the skew join.
    """
    length = F.col("end") - F.col("start") + 1
    right = intervals.filter(F.col("start") <= F.col("end")).withColumn("_level", _level(length, width))
    used = right.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))
    slots = F.sequence(_slot(F.col("start"), F.col("_level"), width), _slot(F.col("end"), F.col("_level"), width))
    right = right.withColumn("_slot", F.explode(slots))
    left = attach_row(points, used).withColumn("_level", F.explode("_levels")).drop("_levels")
    left = left.withColumn("_slot", _slot(F.col(t), F.col("_level"), width))
    inside = F.col(t).between(F.col("start"), F.col("end"))
    return left.join(right, [*keys, "_level", "_slot"]).filter(inside).drop("_level", "_slot")


# the wanted combinations of "inside the first" and "inside the second"
_ALGEBRA = {
    "union": lambda inside: inside("a") | inside("b"),
    "intersection": lambda inside: inside("a") & inside("b"),
    "difference": lambda inside: inside("a") & ~inside("b"),
}


def sweep_intervals(sets: Mapping[str, DataFrame], keys: Sequence[str], wanted: Mapping[str, Callable], bucket: int | None = None) -> DataFrame:
    """(keys, how, start, end): disjoint intervals of each combination in ``wanted`` of sets of half-open intervals [start, end).

    ``wanted`` names conditions; each gets a function from a set's name to the Column "inside that set". One sweep serves all of them: an interval is
    a step up and a step down of its set's depth; steps at one time are summed, the depths are running sums over the times, and what they were
    before a time is the sum less its own step, so a change shows in its own row. Overlaps within a set count once.
    """
    def steps(df: DataFrame, own: str) -> DataFrame:
        end = lambda c, sign: F.struct(F.col(c).alias("t"), *[F.lit(sign if n == own else 0).alias(f"_d_{n}") for n in sets])
        return df.filter(F.col("start") < F.col("end")).select(*keys, F.explode(F.array(end("start", 1), end("end", -1))).alias("_s")).select(*keys, "_s.*")

    every = None
    for name, df in sets.items():
        every = steps(df, name) if every is None else every.unionByName(steps(df, name))
    times, _ = enter(every.groupBy(*keys, "t").agg(*[F.sum(f"_d_{n}").alias(f"_d_{n}") for n in sets]), keys, "t", bucket)
    depths = add_running(times, keys, "t", {f"_n_{n}": ("sum", F.col(f"_d_{n}")) for n in sets})
    now, before = (lambda n: F.col(f"_n_{n}") > 0), (lambda n: F.col(f"_n_{n}") - F.col(f"_d_{n}") > 0)
    states = F.array(*[F.struct(F.lit(how).alias("how"), ok(now).alias("on"), ok(before).alias("was")) for how, ok in wanted.items()])
    changes = (depths.select(*keys, BUCKET, "t", F.explode(F.filter(states, lambda s: s["on"] != s["was"])).alias("_s"))
               .select(*keys, BUCKET, "_s.how", "t", "_s.on", F.col("t").alias("_at")))
    # a stretch ends where the next one, of the other state, begins; a single combination needs no key of its own
    by = [*keys, "how"] if len(wanted) > 1 else keys
    return add_neighbours(changes, by, "t", next=["_at"]).filter("on").select(*keys, "how", F.col("t").alias("start"), F.col("next__at").alias("end"))


def combine_intervals(first: DataFrame, second: DataFrame, keys: Sequence[str], how: str, bucket: int | None = None) -> DataFrame:
    """``union``, ``intersection`` or ``difference`` of two sets of half-open intervals [start, end) as disjoint intervals (``sweep_intervals``)."""
    return sweep_intervals({"a": first, "b": second}, keys, {how: _ALGEBRA[how]}, bucket).drop("how")


def complement(intervals: DataFrame, spans: DataFrame, keys: Sequence[str], bucket: int | None = None) -> DataFrame:
    """What the intervals leave of each key's span (keys, start, end)."""
    return combine_intervals(spans, intervals, keys, "difference", bucket)


def outside_outages(points: DataFrame, outages: DataFrame, t: str, keys: Sequence[str] = ()) -> DataFrame:
    """Points that lie in no outage."""
    return interval_flag(points, outages, t, keys, "_out").filter(~F.col("_out")).drop("_out")


def null_intervals(cells: DataFrame, keys: Sequence[str], t: str, value: str, step: int,
                   min_duration: int = 10 * MINUTE, bucket: int | None = None) -> DataFrame:
    """Stretches of at least ``min_duration`` in which every gate is missing."""
    times = cells.groupBy(*keys, t).agg((F.count(value) == 0).alias("_none"))
    found = mask_to_intervals(times, keys, t, "_none", bucket=bucket)
    return (merge_close(found, keys, step, bucket=bucket)
            .filter(F.col("end") - F.col("start") >= min_duration))


# ---- precipitation events ---------------------------------------------------------------------
def detect_events(cells: DataFrame, keys: Sequence[str], t: str, condition: Column, min_gates: int,
                  min_duration: int, means: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """Runs of times at which at least ``min_gates`` cells meet the condition.

    Each listed column is averaged per time over the given cells, then summarised per event as
    ``<c>_min``, ``<c>_max``, ``<c>_mean``.
    """
    times = cells.groupBy(*keys, t).agg((F.count_if(condition) >= min_gates).alias("_on"),
                                        *[F.avg(c).alias(c) for c in means])
    extra = [f(c).alias(f"{c}_{n}") for c in means for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    return (runs(times, keys, t, "_on", bucket, extra).filter("_on").drop("_on")
            .filter(F.col("end") - F.col("start") >= min_duration))


def precip_flag(cells: DataFrame, keys: Sequence[str], t: str, gate: str, z: str, v: str, n_lower: int = 10,
                fraction: float = 0.5, min_valid: int = 5, valid_only: bool = False,
                z_limit: float = -25.0, v_limit: float = -0.2) -> DataFrame:
    """``precip`` per time: share of the lowest gates with enough echo falling fast enough."""
    low = cells.filter(F.col(gate) < n_lower)
    hit = (F.col(z) >= z_limit) & (F.col(v) <= v_limit)
    usable = F.col(z).isNotNull() & F.col(v).isNotNull() if valid_only else F.lit(True)
    counts = low.groupBy(*keys, t).agg(F.count_if(hit).alias("_hit"), F.count_if(usable).alias("_n"))
    share = F.when(F.col("_n") >= min_valid, F.col("_hit") / F.col("_n"))
    return counts.select(*keys, t, F.coalesce(share >= fraction, F.lit(False)).alias("precip"))


def merge_events(events: DataFrame, keys: Sequence[str], gap: int, min_duration: int, stats: Sequence[str],
                 bucket: int | None = None) -> DataFrame:
    """Merge close events: extremes of extremes, means weighted by the true durations (plain means where all are zero)."""
    rows = add_merge_group(events, keys, "start", "end", gap, bucket)
    weight = (F.col("end") - F.col("start")).cast("double")
    aggs = [F.max("end").alias("end"), F.count(F.lit(1)).alias("n_events")]
    for s in stats:
        mean = F.col(f"{s}_mean")
        aggs += [F.min(f"{s}_min").alias(f"{s}_min"), F.max(f"{s}_max").alias(f"{s}_max"),
                 F.coalesce(F.try_divide(F.sum(mean * weight), F.sum(F.when(mean.isNotNull(), weight))), F.avg(mean)).alias(f"{s}_mean")]
    merged = rows.groupBy(*keys, "group").agg(*aggs).withColumnRenamed("group", "start")
    return merged.filter(F.col("end") - F.col("start") >= min_duration)


def precip_type(temp: Column, melt: Column, temp_limit: float, melt_limit: float) -> Column:
    """solid / liquid / unknown; with one quantity missing the other decides."""
    cold, low = temp < temp_limit, melt < melt_limit
    return (F.when(temp.isNull() & melt.isNull(), "unknown")
            .when(F.coalesce(cold, F.lit(True)) & F.coalesce(low, F.lit(True)), "solid").otherwise("liquid"))


def hourly_events(events: DataFrame, keys: Sequence[str], code: str, step: int = HOUR) -> DataFrame:
    """0 or the code of the last event per hour; an event fills the hour starts from ceil(start) to ceil(end)."""
    from skycolumn.operators.regrid import make_time_grid
    up = lambda c: (F.ceil(F.col(c) / step) * step).cast("long")
    spans = events.select(*keys, code, F.col("start").alias("_start"), up("start").alias("_a"), up("end").alias("_b"))
    filled = make_time_grid(spans, "t", "_a", "_b", step).groupBy(*keys, "t").agg(F.max_by(code, "_start").alias(code))
    grid = make_time_grid(spans.groupBy(*keys).agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")), "t", "_a", "_b", step)
    return grid.join(filled, [*keys, "t"], "left").fillna(0, [code])


# ---- coverage ------------------------------------------------------------------------------
def coverage_gaps(times: DataFrame, keys: Sequence[str], t: str, day: int, open_at: int, close_at: int,
                  limit: int, bucket: int | None = None) -> DataFrame:
    """Gaps longer than ``limit`` inside the daily window, labelled by what bounds them.

    ``times`` holds (keys, day start, t); every day is framed by two marker rows, so a missing
    start, a missing end and an empty day are ordinary gaps between neighbours.
    """
    days = times.select(*keys, F.col(day).alias("day")).distinct()
    marks = days.select(*keys, "day", F.explode(F.array(
        F.struct((F.col("day") + open_at).alias("t"), F.lit(0).alias("kind")),
        F.struct((F.col("day") + close_at).alias("t"), F.lit(2).alias("kind")))).alias("m")
    ).select(*keys, "day", "m.t", "m.kind")
    seen = (times.select(*keys, F.col(day).alias("day"), F.col(t).alias("t"), F.lit(1).alias("kind"))
            .filter(F.col("t").between(F.col("day") + open_at, F.col("day") + close_at)).distinct())
    rows = seen.unionByName(marks).withColumn("_o", F.col("t") * 4 + F.col("kind"))
    near = add_neighbours(rows, [*keys, "day"], "_o", prev=["t", "kind"], bucket=4 * bucket if bucket else None)
    first, last = F.col("prev_kind") == 0, F.col("kind") == 2
    note = (F.when(first & last, "full day missing").when(first, "late start")
            .when(last, "early end").otherwise("mid-day gap"))
    return near.filter(F.col("t") - F.col("prev_t") > limit).select(
        *keys, "day", F.col("prev_t").alias("start"), F.col("t").alias("end"), note.alias("note"))


def drop_scheduled(gaps: DataFrame, start_at: int, end_at: int, tolerance: int) -> DataFrame:
    """Leave out gaps that match a scheduled daily break."""
    near = lambda c, at: F.abs(F.col(c) - F.col("day") - at) <= tolerance
    return gaps.filter(~(near("start", start_at) & near("end", end_at)))


def covered_periods(gaps: DataFrame, days: DataFrame, keys: Sequence[str], open_at: int, close_at: int) -> DataFrame:
    """Complement of the gaps inside each day's window (few gaps per day, so a plain window)."""
    tail = days.select(*keys, "day", (F.col("day") + close_at).alias("start"), (F.col("day") + close_at).alias("end"))
    w = Window.partitionBy(*keys, "day").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.max("end").over(w), F.col("day") + open_at)
    return (gaps.select(*keys, "day", "start", "end").unionByName(tail)
            .select(*keys, "day", since.alias("from"), F.col("start").alias("to")).filter(F.col("from") < F.col("to")))


def availability_bars(cells: DataFrame, keys: Sequence[str], t: str, valid: Column, step: int, gap: int,
                      bucket: int | None = None) -> DataFrame:
    """Intervals in which any gate is valid, close ones merged."""
    times = cells.groupBy(*keys, t).agg(F.bool_or(F.coalesce(valid, F.lit(False))).alias("_ok")).filter("_ok")
    near = lambda prev, row: row("_at") - prev("_at") <= max(gap, step)
    return (add_groups(times, keys, t, near, bucket=bucket).groupBy(*keys, "run")
            .agg(F.max(t).alias("end")).withColumnRenamed("run", "start").select(*keys, "start", "end"))


def mask_bars(times: DataFrame, keys: Sequence[str], t: str, mask: Column, gap: int, bucket: int | None = None) -> DataFrame:
    """Runs of samples on which ``mask`` is True, close ones merged; a sample without the mask ends a run."""
    flagged = times.select(*keys, t, F.coalesce(mask, F.lit(False)).alias("_on"))
    found = mask_to_intervals(flagged, keys, t, "_on", bucket=bucket)
    return merge_close(found, keys, gap, bucket=bucket)


def ratio_outside(cells: DataFrame, keys: Sequence[str], t: str, valid: Column, ratio: str, constant: tuple[float, float], gap: int,
                  spreads: float = 2.0, bucket: int | None = None) -> DataFrame:
    """Bars of times with any valid gate whose ratio lies outside the calibration constant (mean, spread) by more than ``spreads`` spreads."""
    mean, spread = constant
    times = cells.groupBy(*keys, t).agg(F.bool_or(F.coalesce(valid, F.lit(False))).alias("_any"), F.max(ratio).alias("_ratio"))
    outside = (F.col("_ratio") < mean - spreads * spread) | (F.col("_ratio") > mean + spreads * spread)
    return mask_bars(times, keys, t, F.col("_any") & outside, gap, bucket)


def listed_bars(times: DataFrame, listed: DataFrame, keys: Sequence[str], t: str, gap: int, bucket: int | None = None) -> DataFrame:
    """Listed periods (ends included) as bars of the samples they hold, close ones merged."""
    flagged = interval_flag(times, listed, t, keys, "_listed", bucket)
    return mask_bars(flagged, keys, t, F.col("_listed"), gap, bucket)


def weekly_bars(bars: DataFrame, keys: Sequence[str], week: int, origin: int = 0) -> DataFrame:
    """Bars cut at the ends of weeks counted from ``origin``: (keys, week, start, end), both ends included."""
    from skycolumn.operators.regrid import make_time_grid
    first = floor_div(F.col("start") - origin, week) * week + origin
    spans = bars.select(*keys, "start", "end", first.alias("_a"), F.col("end").alias("_b"))
    cut = make_time_grid(spans, "week", "_a", "_b", week)
    return cut.select(*keys, "week", F.greatest("start", "week").alias("start"), F.least(F.col("end"), F.col("week") + week - 1).alias("end"))
