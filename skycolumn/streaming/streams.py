"""Streaming forms of gridding, storing, event detection and step corrections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skycolumn.session import path_exists, staged
from skycolumn.sources.store import touched_days, upsert_region
from skycolumn.specs import VariableSpec


def event_time(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the session zone is UTC, so the value does not change."""
    typed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return typed.withWatermark(ts, watermark) if df.isStreaming else typed


def stream_grid(events: DataFrame, ts: str, keys: Sequence[str], step: str, watermark: str,
                aggregates: Mapping[str, Column]) -> DataFrame:
    """Tumbling aggregates {name: Column}; rows later than the watermark are dropped, state is one row per step."""
    marked = event_time(events, ts, watermark)
    out = marked.groupBy(*keys, F.window(ts, step).alias("_w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias(ts), *aggregates)


def stream_intervals(events: DataFrame, ts: str, keys: Sequence[str], flag: Column, gap: str, watermark: str) -> DataFrame:
    """Sessions of flagged rows: (start, end, n); a session ends when no row follows within ``gap``."""
    on = event_time(events.filter(flag), ts, watermark)
    ntz = lambda c: c.cast("timestamp_ntz")
    return on.groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(
        ntz(F.min(ts)).alias("start"), ntz(F.max(ts)).alias("end"), F.count(F.lit(1)).alias("n")).drop("_w")


def stream_stepjoin(events: DataFrame, steps: DataFrame, ts: str, keys: Sequence[str], value: str, correction: str,
                    slot_seconds: int, name: str) -> DataFrame:
    """Add the step correction that is valid at each row's time, stream against a static table.

    ``steps`` has one row per slot and key (see ``steps_per_slot``), so the join is on equality and
    Spark decides by size whether the table is broadcast.
    """
    slot = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / slot_seconds)
    # the last slot of a key holds for all later times
    ends = steps.groupBy(*keys).agg(F.max("_slot").alias("_end"))
    placed = events.withColumn("_at", slot)
    placed = placed.join(ends, list(keys), "left") if keys else placed.join(ends)
    placed = placed.withColumn("_slot", F.least("_at", "_end")).drop("_at", "_end")
    joined = placed.join(steps, [*keys, "_slot"], "left")
    at = F.col(ts).cast("timestamp_ntz")
    # the slot's own steps in time order; before the first of them the value carried into the slot holds
    inside = F.filter("_steps", lambda s: s["t"] <= at)
    current = F.when(F.size(inside) > 0, F.element_at(inside, -1)["v"]).otherwise(F.col("_carried"))
    return joined.withColumn(correction, current).withColumn(name, F.col(value) + F.col(correction)).drop("_slot", "_steps", "_carried")


def steps_per_slot(steps: DataFrame, t: str, keys: Sequence[str], correction: str, slot_seconds: int) -> DataFrame:
    """Static side of ``stream_stepjoin``: per slot, up to the one after the last step, the carried value and its own steps."""
    from skycolumn.operators.ordered import add_carried

    seconds = F.unix_timestamp(F.col(t).cast("timestamp"))
    slotted = steps.withColumn("_slot", F.floor(seconds / slot_seconds))
    own = slotted.groupBy(*keys, "_slot").agg(
        F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(correction).alias("v")))).alias("_steps"),
        F.max_by(correction, t).alias("_final"))
    grid = own.groupBy(*keys).agg(F.min("_slot").alias("_a"), (F.max("_slot") + 1).alias("_b")).select(
        *keys, F.explode(F.sequence("_a", "_b")).alias("_slot"))
    rows = grid.join(own, [*keys, "_slot"], "left").withColumn("_next", F.col("_slot") + 1)
    carried = add_carried(rows, keys, "_slot", last={"_upto": "_final"}, bucket=100_000)
    before = carried.select(*keys, F.col("_next").alias("_slot"), F.col("_upto").alias("_carried"))
    empty = F.from_json(F.lit("[]"), "array<struct<t:timestamp_ntz,v:double>>")
    return (rows.select(*keys, "_slot", F.coalesce("_steps", empty).alias("_steps"))
            .join(before, [*keys, "_slot"], "left"))


def stream_store(events: DataFrame, path: str, checkpoint: str, specs: Sequence[VariableSpec], ts: str = "time",
                 watermark: str = "1 hour", keys: Sequence[str] = ("radar", "time", "range"),
                 trigger: Callable | None = None) -> StreamingQuery:
    """Write a stream into the store: each batch merges with the days it touches.

    Rows repeated as a whole within the watermark are dropped; of different rows of one key the smallest
    (in the order of the other columns) stays, in a batch and against the store. Replaying a batch rewrites
    the same days with the same rows, so the sink is idempotent.
    """
    unique = event_time(events, ts, watermark).dropDuplicatesWithinWatermark()

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
        # the days of a batch are few: as a filter on the partition columns they prune what is read
        days = batch.select("radar", F.to_date(ts).alias("date")).distinct()
        both = batch
        if path_exists(spark, path):  # not before the first batch
            both = batch.unionByName(touched_days(spark.read.parquet(path), days).drop("date"), allowMissingColumns=True)
        rest = [c for c in both.columns if c not in keys]
        merged = both.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
        # staged, because the partitions that are read are replaced afterwards
        with staged(merged) as rows:
            upsert_region(rows, path, specs)

    writer = unique.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if trigger is None else trigger(writer)).start()
