"""Step corrections from a stream of their own: rows are corrected as they arrive and revised when a correction comes late."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skycolumn.streaming.streams import event_time

# Groups that the rows of a key are dealt to; each holds the steps of the key.
SHARDS = 64

_EMPTY = {"t": np.zeros(0, np.int64), "id": np.zeros(0, object), "v": np.zeros(0), "c": np.zeros(0), "n": np.zeros(0, np.int64), "st": np.zeros(0, np.int64), "sc": np.zeros(0)}


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _received(held: dict, new: pd.DataFrame) -> dict:
    """The state with new rows and new steps; of steps at one time the one received last holds."""
    step = new["_c"].notna().to_numpy()
    rows, steps = new[~step & new["_id"].notna().to_numpy()], new[step]
    out = {"t": np.append(held["t"], _micros(rows["_t"])), "id": np.append(held["id"], rows["_id"].to_numpy(object)), "v": np.append(held["v"], rows["_v"].to_numpy(float)),
           "c": np.append(held["c"], np.full(len(rows), np.nan)), "n": np.append(held["n"], np.zeros(len(rows), np.int64))}
    st, sc = np.append(held["st"], _micros(steps["_t"])), np.append(held["sc"], steps["_c"].to_numpy(float))
    order = np.argsort(st, kind="stable")
    st, sc = st[order], sc[order]
    last = np.append(st[1:] != st[:-1], True)[:len(st)]
    return {**out, "st": st[last], "sc": sc[last]}


def _revised(held: dict) -> tuple[dict, np.ndarray]:
    """The state with the step that now holds for every row, and which rows are new or changed."""
    at = np.searchsorted(held["st"], held["t"], side="right") - 1
    c = np.where(at >= 0, np.append(held["sc"], np.nan)[at], np.nan)
    changed = (held["n"] == 0) | ~((c == held["c"]) | (np.isnan(c) & np.isnan(held["c"])))
    return {**held, "c": c, "n": held["n"] + changed}, changed


def _evicted(held: dict, watermark: int) -> dict:
    """What can still change or is still needed: rows and steps from the watermark on, and the step that holds at it."""
    keep, first = held["t"] >= watermark, max(0, int(np.searchsorted(held["st"], watermark, side="right")) - 1)
    return {**{k: held[k][keep] for k in ("t", "id", "v", "c", "n")}, "st": held["st"][first:], "sc": held["sc"][first:]}


def stream_late_corrections(rows: DataFrame, steps: DataFrame, ts: str, keys: Sequence[str], row_id: str, value: str, correction: str, name: str,
                            watermark: str, shards: int = SHARDS) -> DataFrame:
    """``name`` = value + the last step at or before the row's time, for two streams that may be late against each other.

    A row is given out when it arrives (``revision`` 1) and again whenever a step that arrived since changes its correction; the highest
    revision of a row is its state (see ``write_revisions``). The rows of a key are dealt to ``shards`` groups by a hash of their id and its steps, which are
    few, go to all of them, so that a task holds one group's rows and not a whole key's. State per group: the rows and steps younger than the
    watermark and the one step that holds at it; a timer drops the rest when no more data arrive for the group. A checkpoint is bound to its
    number of shards. Output mode is update.
    """
    def side(df: DataFrame, i, v, c, shard) -> DataFrame:
        return df.select(*keys, F.col(ts).cast("timestamp").alias("_t"), i.cast("string").alias("_id"), v.cast("double").alias("_v"), c.cast("double").alias("_c"),
                         shard.alias("_shard"))

    none = F.lit(None)
    dealt, copied = F.pmod(F.xxhash64(F.col(row_id).cast("string")), F.lit(shards)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    both = event_time(side(rows, F.col(row_id), F.col(value), none, dealt).unionByName(side(steps, none, none, F.col(correction), copied)), "_t", watermark)
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else _EMPTY
        parts = [] if state.hasTimedOut else list(frames)
        if parts:
            held = _received(held, pd.concat(parts, ignore_index=True))
        held, changed = _revised(held)
        out = pd.DataFrame({"_id": held["id"][changed], "_t": held["t"][changed].astype("datetime64[us]"), "_v": held["v"][changed], "_c": held["c"][changed], "revision": held["n"][changed]})
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        mark = state.getCurrentWatermarkMs()
        held = _evicted(held, mark * 1000)
        state.update((pickle.dumps(held),))
        if len(held["t"]):
            state.setTimeoutTimestamp(max(int(held["t"].min()) // 1000, mark) + 1)
        if len(out):
            yield out

    found = both.groupBy(*keys, "_shard").applyInPandasWithState(run, ", ".join([*kinds, "_id string, _t timestamp, _v double, _c double, revision long"]), "state binary", "update", "EventTimeTimeout")
    known = F.nanvl("_c", none.cast("double"))
    return found.select(*keys, F.col("_id").cast(rows.schema[row_id].dataType).alias(row_id), F.col("_t").cast("timestamp_ntz").alias(ts), F.col("_v").alias(value),
                        known.alias(correction), (F.col("_v") + known).alias(name), "revision")


def write_revisions(revised: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch's rows as a partition of their own, replaced if the batch runs again."""
    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return revised.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def latest(revisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The highest revision of each row."""
    rest = [c for c in revisions.columns if c not in (*keys, "batch")]
    return revisions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select(*keys, "_r.*")
