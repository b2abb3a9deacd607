"""Ordered work on long keyed series.

A window partitioned by the instrument alone puts a whole campaign into one task. Every operator
here cuts the series into time buckets instead, and carries what crosses a bucket edge through a
summary that has one row per bucket. A bucket is as wide as ``ROWS_PER_BUCKET`` allows, so a key has few of them; where a
series has no keys to spread by, its summary is cut once more (``scan_summary``), so that no task holds more of its rows than
``BUCKETS_PER_GROUP``, or one row per group of that many:

* ``add_neighbours``   previous / next row (lag and lead)
* ``add_carried``      last / next non-null value (forward and backward fill)
* ``add_running``      cumulative sums, maxima, minima
* ``add_groups``       chains of rows that belong together
* ``halo``             copies of the rows a bounded time frame needs from the neighbour buckets

Keys are not NULL. ``(keys, order)`` must be unique where stated; ``first_per_time`` makes it so with a hash
aggregation, which combines on the map side and is therefore safe for hot keys. With one row per
(key, microsecond) a one-second bucket can never hold more than 10**6 rows, so ``bucket_width``
always finds a width that bounds the rows of a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR

BUCKET = "_bucket"
GROUP = "_bucket_group"
OWN = "_own"
# Rows of a summary that one task scans; a second level has one row for each such group.
BUCKETS_PER_GROUP = 4096
ROWS_PER_BUCKET = 2_000_000
_WIDTHS = (30 * DAY, 7 * DAY, DAY, 6 * HOUR, HOUR, 10 * MINUTE, MINUTE, 10 * SECOND, SECOND)


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_epoch_us(us: Column) -> Column:
    """TIMESTAMP_NTZ of a microsecond count (session zone must be UTC)."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_div(col: Column, width: int | Column) -> Column:
    """Integer floor division that is exact for LONG columns."""
    width = F.lit(width) if isinstance(width, int) else width
    return ((col - F.pmod(col, width)) / width).cast("long")


def bucket_width(df: DataFrame, keys: Sequence[str], order: str, at_least: int = 0,
                 max_rows: int = ROWS_PER_BUCKET, scale: int = 1) -> int:
    """Widest bucket whose fullest instance holds at most ``max_rows`` rows.

    Where all rows together are no more than that, their number settles it. Else an aggregation job counts
    rows per hour, rolls the counts up to the wider candidates and returns one row per width to the
    driver; only when an hour is too full are minutes, then seconds counted.
    ``scale`` is the number of ``order`` units per microsecond. Frames wider than any bucket that fits
    (``at_least``) decide by themselves: their rows must meet in one task whatever the width.
    """
    finer = [w for w in _WIDTHS if w >= at_least] or [at_least]
    if df.select(*keys, order).count() <= max_rows:
        return max(finer) * scale
    for base in (HOUR, MINUTE, SECOND):
        widths = [w for w in finer if w >= base]
        if not widths:
            continue
        finer = [w for w in finer if w < base]
        counts = (df.groupBy(*keys, floor_div(F.col(order), base * scale).alias("_s"))
                  .agg(F.count(F.lit(1)).alias("_n")))
        rolled = (counts.withColumn("_w", F.explode(F.array(*[F.lit(w // base) for w in widths])))
                  .groupBy(*keys, "_w", floor_div(F.col("_s"), F.col("_w")).alias("_b"))
                  .agg(F.sum("_n").alias("_n"))
                  .groupBy("_w").agg(F.max("_n").alias("_n")))
        fits = [r["_w"] for r in rolled.collect() if r["_n"] <= max_rows]
        if fits:
            return max(fits) * base * scale
        if not finer:
            break
    return max(min(_WIDTHS), at_least) * scale


def first_per_time(df: DataFrame, keys: Sequence[str], t: str, tiebreak: str | None = None) -> DataFrame:
    """One row per (keys, t): the one with the smallest ``tiebreak`` (map-side combined)."""
    grouping = [*keys, t]
    rest = [c for c in df.columns if c not in grouping]
    rank = F.col(tiebreak) if tiebreak else F.struct(*rest)
    return (df.groupBy(*grouping).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
            .select(*grouping, *[F.col("_row")[c].alias(c) for c in rest])
            .select(*df.columns))


def with_bucket(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, floor_div(F.col(order), width))


def in_bucket(keys: Sequence[str], order: str, descending: bool = False):
    by = F.col(order).desc() if descending else F.col(order).asc()
    return Window.partitionBy(*keys, BUCKET).orderBy(by)


# how a fold combines within a level, and a level with what came before it
_FOLDS = {
    "last": (None, F.coalesce),
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def scan_summary(edge: DataFrame, keys: Sequence[str], folds: Mapping[str, tuple[str, Column]], descending: bool = False,
                 back: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Adds, per summary row, the fold of a column over all rows of its key before it (after it, if ``descending``): {name: (fold, column)}.
    ``back`` holds folds of the other direction.

    ``last`` is the nearest value that is not NULL, ``row`` the value of the adjacent row, NULL or not. With keys, each key's summary is one
    window. Without, there are two levels: inside groups of buckets, and over one row per group; both come from one exchange.
    """
    asked = {n: (how, c, descending) for n, (how, c) in folds.items()} | {n: (how, c, not descending) for n, (how, c) in (back or {}).items()}

    def before(by: Sequence[str], order: str, down: bool):
        return Window.partitionBy(*by).orderBy(F.col(order).desc() if down else F.col(order).asc()).rowsBetween(Window.unboundedPreceding, -1)

    def folded(how: str, column: Column, window) -> Column:
        return F.last(column, True).over(window) if how == "last" else _FOLDS[how][0](column).over(window)

    # a struct is never NULL, so the last one is the adjacent row's
    packed = {n: F.struct(c.alias("v")) if how == "row" else c for n, (how, c, _) in asked.items()}
    kinds = {n: "last" if how == "row" else how for n, (how, _, _) in asked.items()}
    unpacked = lambda n, c: c.getField("v") if asked[n][0] == "row" else c
    if keys:
        return edge.withColumns({n: unpacked(n, folded(kinds[n], packed[n], before(keys, BUCKET, down))) for n, (_, _, down) in asked.items()})
    rows = edge.withColumns({f"_in_{n}": c for n, c in packed.items()}).withColumn(GROUP, floor_div(F.col(BUCKET), BUCKETS_PER_GROUP)).repartition(GROUP)
    known = lambda n: F.when(F.col(f"_in_{n}").isNotNull(), F.col(BUCKET))
    aggs = [((F.min_by if down else F.max_by)(f"_in_{n}", known(n)) if kinds[n] == "last" else _FOLDS[kinds[n]][0](f"_in_{n}")).alias(f"_in_{n}")
            for n, (_, _, down) in asked.items()]
    groups = edges_of(rows, [], aggs, GROUP).select(GROUP, *[folded(kinds[n], F.col(f"_in_{n}"), before([], GROUP, down)).alias(f"_top_{n}") for n, (_, _, down) in asked.items()])
    low = rows.withColumns({f"_low_{n}": folded(kinds[n], F.col(f"_in_{n}"), before([GROUP], BUCKET, down)) for n, (_, _, down) in asked.items()})
    joined = {n: _FOLDS[kinds[n]][1](F.col(f"_low_{n}"), F.col(f"_top_{n}")) for n in asked}
    return low.join(groups, GROUP, "left").select(*edge.columns, *[unpacked(n, joined[n]).alias(n) for n in asked])


def join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the bucket's summary row to its rows; plain equality keeps the rows' partitioning."""
    return rows.join(summary, [*keys, BUCKET], "left")


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate to every row.

    ``row`` has exactly one row, so this join without condition adds columns and no rows.
    """
    return df.join(row)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on the keys; without keys ``right`` is a one-row aggregate."""
    return left.join(right, list(keys)) if keys else attach_row(left, right)


def enter(df: DataFrame, keys: Sequence[str], order: str, bucket: int | None) -> tuple[DataFrame, bool]:
    """Add the bucket column and deal the rows by (keys, bucket); a bucket that is there already is kept, so that
    chained steps share a shuffle. Rows without a key or a place in the order are left out."""
    if BUCKET in df.columns:
        return df, True
    rows = with_bucket(df, order, bucket or bucket_width(df, keys, order))
    for c in (*keys, BUCKET):
        rows = rows.filter(F.col(c).isNotNull())
    return rows.repartition(*keys, BUCKET), False


def edges_of(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Column], by: str = BUCKET) -> DataFrame:
    """One summary row per bucket (or group of buckets).

    The summary and the rows it is joined back to come from the same exchange, read once from the source, if
    both ask it for the same columns; the digest of all columns, which is never NULL, sees to that.
    """
    rest = [c for c in rows.columns if c not in keys and c != by]
    return (rows.groupBy(*keys, by).agg(*aggs, F.bit_xor(F.xxhash64(*rest)).alias("_all"))
            .filter(F.col("_all").isNotNull()).drop("_all"))


def _both_ways(edge: DataFrame, keys: Sequence[str], before: Mapping[str, tuple[str, Column]], after: Mapping[str, tuple[str, Column]]) -> DataFrame:
    return scan_summary(edge, keys, before, back=after).select(*keys, BUCKET, *before, *after)


def _leave(df: DataFrame, kept: bool, drop: Sequence[str]) -> DataFrame:
    return df.drop(*drop) if kept else df.drop(BUCKET, *drop)


def add_neighbours(df: DataFrame, keys: Sequence[str], order: str, prev: Sequence[str] = (),
                   next: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """``prev_<c>`` / ``next_<c>`` of the adjacent row in (keys, order); order is unique per key."""
    rows, kept = enter(df, keys, order, bucket)
    aggs = [F.max_by(c, order).alias(f"_l_{c}") for c in prev]
    aggs += [F.min_by(c, order).alias(f"_f_{c}") for c in next]
    edge = _both_ways(edges_of(rows, keys, aggs), keys, {f"_pv_{c}": ("row", F.col(f"_l_{c}")) for c in prev},
                      {f"_nx_{c}": ("row", F.col(f"_f_{c}")) for c in next})
    inside = in_bucket(keys, order)
    out = join_summary(rows, edge, keys)
    first = F.lag(F.lit(True)).over(inside).isNull()
    last = F.lead(F.lit(True)).over(inside).isNull()
    cols = {f"prev_{c}": F.when(first, F.col(f"_pv_{c}")).otherwise(F.lag(c).over(inside)) for c in prev}
    cols |= {f"next_{c}": F.when(last, F.col(f"_nx_{c}")).otherwise(F.lead(c).over(inside)) for c in next}
    return _leave(out.withColumns(cols), kept, [f"_pv_{c}" for c in prev] + [f"_nx_{c}" for c in next])


def add_carried(df: DataFrame, keys: Sequence[str], order: str, last: Mapping[str, str] | None = None,
                next: Mapping[str, str] | None = None, bucket: int | None = None) -> DataFrame:
    """Forward (``last``) and backward (``next``) fill: {new column: source column}, inclusive."""
    last, next = dict(last or {}), dict(next or {})
    rows, kept = enter(df, keys, order, bucket)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    aggs = [F.max_by(c, known(c)).alias(f"_l_{n}") for n, c in last.items()]
    aggs += [F.min_by(c, known(c)).alias(f"_f_{n}") for n, c in next.items()]
    edge = _both_ways(edges_of(rows, keys, aggs), keys, {f"_pv_{n}": ("last", F.col(f"_l_{n}")) for n in last},
                      {f"_nx_{n}": ("last", F.col(f"_f_{n}")) for n in next})
    out = join_summary(rows, edge, keys)
    up = in_bucket(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = in_bucket(keys, order, True).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {n: F.coalesce(F.last(c, True).over(up), F.col(f"_pv_{n}")) for n, c in last.items()}
    cols |= {n: F.coalesce(F.last(c, True).over(down), F.col(f"_nx_{n}")) for n, c in next.items()}
    return _leave(out.withColumns(cols), kept, [f"_pv_{n}" for n in last] + [f"_nx_{n}" for n in next])


def add_running(df: DataFrame, keys: Sequence[str], order: str, running: Mapping[str, tuple[str, Column]],
                bucket: int | None = None, descending: bool = False) -> DataFrame:
    """Cumulative {new column: ("sum" | "max" | "min", operand)} over (keys, order), inclusive."""
    rows, kept = enter(df.withColumns({f"_x_{n}": c for n, (_, c) in running.items()}), keys, order, bucket)
    inside = in_bucket(keys, order, descending).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aggs, cols = [], {}
    for n, (how, _) in running.items():
        fold, join = _FOLDS[how]
        aggs.append(fold(f"_x_{n}").alias(f"_s_{n}"))
        cols[n] = join(F.col(f"_b_{n}"), fold(f"_x_{n}").over(inside))
    edge = scan_summary(edges_of(rows, keys, aggs), keys, {f"_b_{n}": (how, F.col(f"_s_{n}")) for n, (how, _) in running.items()}, descending)
    edge = edge.select(*keys, BUCKET, *[f"_b_{n}" for n in running])
    out = join_summary(rows, edge, keys).withColumns(cols)
    return _leave(out, kept, [f"_b_{n}" for n in running] + [f"_x_{n}" for n in running])


def add_groups(df: DataFrame, keys: Sequence[str], order: str, joined, prev: Sequence[str] = (),
               start: str = "run", bucket: int | None = None) -> DataFrame:
    """Mark the chains of rows in which every row is ``joined`` to the one before it.

    ``joined(previous, row)`` gets two functions from column name to Column and may use the columns
    ``prev`` and ``_at`` (the order value). ``start`` becomes the order value of the first row of the
    chain; ``(keys, order)`` is unique.
    Chains are found inside each bucket; the summary row of a bucket says where its first and last
    chain reach, and only these can continue in a neighbour.
    """
    rows, kept = enter(df.withColumn("_at", F.col(order)), keys, order, bucket)
    inside = in_bucket(keys, order)
    up = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = lambda c: F.col(c)
    first = F.lag("_at").over(inside).isNull()
    cut = first | ~F.coalesce(joined(lambda c: F.lag(c).over(inside), row), F.lit(False))
    rows = rows.withColumn("_cut", cut).withColumn(start, F.last(F.when(F.col("_cut"), F.col("_at")), True).over(up))
    needed = list(dict.fromkeys([*prev, "_at"]))
    edge = edges_of(rows, keys, [
        F.min("_at").alias("_a"), F.max("_at").alias("_z"), F.max(start).alias("_s"), F.count_if("_cut").alias("_cuts"),
        *[F.min_by(c, "_at").alias(f"_f_{c}") for c in needed], *[F.max_by(c, "_at").alias(f"_l_{c}") for c in needed]])
    edge = scan_summary(edge, keys, {f"_b_{c}": ("row", F.col(f"_l_{c}")) for c in needed})
    link = F.coalesce(joined(lambda c: F.col(f"_b_{c}"), lambda c: F.col(f"_f_{c}")), F.lit(False))
    edge = edge.select(*keys, BUCKET, "_a", link.alias("_link"), F.when(~link | (F.col("_cuts") > 1), F.col("_s")).alias("_opened"))
    edge = scan_summary(edge, keys, {"_open": ("last", F.col("_opened"))})
    edge = edge.select(*keys, BUCKET, "_a", F.when(F.col("_link"), F.col("_open")).alias("_in"))
    out = join_summary(rows, edge, keys)
    out = out.withColumn(start, F.when((F.col(start) == F.col("_a")) & F.col("_in").isNotNull(), F.col("_in"))
                         .otherwise(F.col(start)))
    drop = ["_at", "_cut", "_a", "_in"]
    return _leave(out, kept, drop)


def halo(df: DataFrame, keys: Sequence[str], t: str, before: int, after: int,
         bucket: int | None = None) -> DataFrame:
    """Copy each row into every bucket whose frames [t-before, t+after] can reach it.

    The bucket is at least four frames wide, so the copies stay under half of the input. Keep the
    rows with ``_own`` after the window function has run.
    """
    width = bucket or bucket_width(df, keys, t, at_least=4 * (before + after))
    lo, hi = floor_div(F.col(t) - F.lit(after), width), floor_div(F.col(t) + F.lit(before), width)
    return (df.withColumn(BUCKET, F.explode(F.sequence(lo, hi)))
            .withColumn(OWN, F.col(BUCKET) == floor_div(F.col(t), width)))


def owned(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN)).drop(BUCKET, OWN)
