"""Lookups of the nearest or last earlier row.

The two sides are united, bucketed by time, and the wanted row is carried across bucket edges by
``add_carried``; no row is paired with more than two candidates and nothing is broadcast blindly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.operators.ordered import add_carried, enter, first_per_time


def _both_sides(left: DataFrame, right: DataFrame, t: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Tagged union ordered by 2t + side: a right row at the same time comes before the left one."""
    payload = [c for c in left.columns if c not in (*keys, t)]
    lhs = left.select(*keys, t, (F.col(t) * 2 + 1).alias("_o"), F.lit(True).alias("_is_left"),
                      F.struct(*[F.col(c) for c in payload] or [F.lit(0).alias("_none")]).alias("_left"))
    rhs = right.filter(F.col(t).isNotNull()).select(
        *keys, t, (F.col(t) * 2).alias("_o"), F.lit(False).alias("_is_left"),
        F.struct(F.col(t).alias("t"), *values).alias("_right"))
    return lhs.unionByName(rhs, allowMissingColumns=True)


def on_times(left: DataFrame, looked_up: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Bring what was found per (keys, t) back to all rows; a small table is broadcast by Spark's own check."""
    return left.join(looked_up, [*keys, t], "left")


def asof(left: DataFrame, right: DataFrame, t: str, keys: Sequence[str], values: Sequence[str],
         direction: str = "backward", tolerance: int | None = None, tie: str = "backward",
         bucket: int | None = None) -> DataFrame:
    """Left rows with ``values`` and ``matched_t`` of the chosen right row.

    direction ``backward``: last right row with time <= t; ``forward``: first with time >= t;
    ``nearest``: the closer of the two, ``tie`` says which wins at equal distance (``backward`` or
    ``later``). ``tolerance`` is in units of ``t``; without a match the values are NULL. ``t`` is a
    LONG. The lookup runs on the distinct (keys, t) of the left side and is joined back by equality,
    so repeated left times cost nothing and a hot time is split by the skew join.
    """
    times = left.select(*keys, t).distinct()
    unique = first_per_time(right.select(*keys, t, *values), keys, t)
    both = _both_sides(times, unique, t, keys, values)
    rows, _ = enter(both.select(*keys, t, "_o", "_is_left", "_right"), keys, "_o",
                    None if bucket is None else 2 * bucket)
    want_last = {"_prev": "_right"} if direction in ("backward", "nearest") else {}
    # the forward neighbour of a left row is at a later time, or at the same time via _prev
    want_next = {"_next": "_right"} if direction in ("forward", "nearest") else {}
    if direction == "forward":
        want_last = {"_prev": "_right"}
    found = add_carried(rows, keys, "_o", want_last, want_next).filter("_is_left")
    prev, nxt = F.col("_prev"), F.col("_next") if want_next else None
    if direction == "backward":
        hit = prev
    elif direction == "forward":
        hit = F.when(prev["t"] == F.col(t), prev).otherwise(nxt)
    else:
        before, after = F.col(t) - prev["t"], nxt["t"] - F.col(t)
        closer = after < before if tie == "backward" else after <= before
        hit = F.when(prev.isNull() | (closer & (before > 0)), nxt).otherwise(prev)
    found = found.select(*keys, t, hit.alias("_hit"))
    if tolerance is not None:
        found = found.withColumn("_hit", F.when(F.abs(F.col("_hit.t") - F.col(t)) <= tolerance, F.col("_hit")))
    found = found.select(*keys, t, F.col("_hit.t").alias("matched_t"), *[F.col(f"_hit.{v}").alias(v) for v in values])
    return on_times(left, found, keys, t)


def asof_nearest(left, right, t, keys, values, tolerance=None, tie="backward", bucket=None) -> DataFrame:
    return asof(left, right, t, keys, values, "nearest", tolerance, tie, bucket)


def asof_backward(left, right, t, keys, values, bucket=None) -> DataFrame:
    """Step function: the last correction at or before each time, without tolerance."""
    return asof(left, right, t, keys, values, "backward", None, "backward", bucket)


def near_event_flag(points: DataFrame, events: DataFrame, t: str, keys: Sequence[str], window: int,
                    side: str = "both") -> DataFrame:
    """``near`` is True if the nearest event lies within half a window; ``side='next'`` looks ahead only."""
    direction = "nearest" if side == "both" else "forward"
    found = asof(points, events.select(*keys, t), t, keys, [], direction)
    near = F.coalesce(F.abs(F.col("matched_t") - F.col(t)) <= window / 2, F.lit(False))
    return found.withColumn("near", near).drop("matched_t")


def temperature_band(cells: DataFrame, isotherms: DataFrame, t: str, keys: Sequence[str], height: str,
                     lower: str, upper: str, tolerance: int | None = None) -> DataFrame:
    """Keep the cells between two isotherm heights that are valid at their time."""
    joined = asof_nearest(cells, isotherms, t, keys, [lower, upper], tolerance)
    bottom, top = F.least(lower, upper), F.greatest(lower, upper)
    return joined.filter(F.col(lower).isNotNull() & F.col(upper).isNotNull()
                         & F.col(height).between(bottom, top)).drop("matched_t")


def add_corrected(df: DataFrame, corrections: DataFrame, t: str, keys: Sequence[str], value: str,
                  correction: str, name: str, mode: str = "backward", tolerance: int | None = None,
                  constant: float = 0.0) -> DataFrame:
    """``name`` = value + looked-up correction + constant; NULL where there is no correction."""
    found = asof(df, corrections, t, keys, [correction], mode, tolerance)
    total: Column = F.col(value) + F.col(correction)
    if constant:
        total = total + constant
    return found.withColumn(name, total).drop("matched_t")


def sample_every(df: DataFrame, t: str, keys: Sequence[str], valid: Column, step: int) -> DataFrame:
    """Nearest valid time to every ``step``-th grid time, without repeating the previous choice."""
    from skycolumn.operators.regrid import make_time_grid

    bounds = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    grid = make_time_grid(bounds, t, "_lo", "_hi", step)
    good = df.filter(valid).select(*keys, t).distinct()
    found = asof_nearest(grid, good, t, keys, [])
    return (found.filter(F.col("matched_t").isNotNull())
            .groupBy(*keys, "matched_t").agg(F.min(t).alias("wanted_t")))
