"""Interval joins and the algebra of interval sets against brute force; two-level scans; sketches, hexagons and lag sums."""

import math
import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from skycolumn.operators import intervals, ordered, sketches, stats

CENTURY = 100 * 365 * ordered.DAY


@pytest.mark.parametrize("width", [1, 1000, ordered.SECOND])
def test_interval_join_of_any_length(spark, width):
    rng = random.Random(1)
    spans = [("a", 1, 0, CENTURY), ("a", 2, 5 * ordered.SECOND, 6 * ordered.SECOND), ("a", 3, 7, 7), ("b", 4, -CENTURY, 10), ("b", 5, 10, 9), ("a", 6, 2**40 - 1, 2**41)]
    spans += [("b", 10 + i, s, s + rng.choice([0, 1, 999, 10**6, 3 * 10**9])) for i, s in enumerate(rng.randrange(10**10) for _ in range(30))]
    points = [(k, rng.choice([7, 8, 5 * ordered.SECOND, CENTURY, CENTURY + 1, -5, rng.randrange(10**10), rng.randrange(CENTURY)]), i) for i, k in enumerate("ab" * 100)]
    left = spark.createDataFrame(points, "k string, t long, i int")
    right = spark.createDataFrame(spans, "k string, id int, start long, end long")
    got = intervals.interval_join(left, right, "t", ["k"], width).select("i", "id")
    assert rows_of(got) == sorted([(i, j) for k, t, i in points for q, j, a, b in spans if k == q and a <= t <= b], key=repr)


def test_interval_join_copies_few_rows(spark):
    """However long an interval is, it is copied at most three times, and a point once per level in use."""
    right = spark.createDataFrame([(i, 0, 10**i) for i in range(17)] + [(99, -CENTURY, CENTURY)], "id int, start long, end long")
    level = intervals._level(F.col("end") - F.col("start") + 1, 1000)
    slots = right.select((intervals._slot(F.col("end"), level, 1000) - intervals._slot(F.col("start"), level, 1000) + 1).alias("n"), level.alias("l"))
    assert max(r.n for r in slots.collect()) <= 3
    assert intervals.interval_join(spark.range(3).select(F.col("id").alias("t")), right.limit(0), "t", [], 1000).count() == 0


@pytest.mark.parametrize("how", ["union", "intersection", "difference"])
def test_combined_intervals(spark, how):
    rng = random.Random(2)
    make = lambda n: [(k, a, a + rng.randrange(0, 12)) for k in "xy" for a in (rng.randrange(200) for _ in range(n))]
    first, second = make(15), [*make(12), ("z", 3, 9)]
    want = {}
    for key in "xyz":
        inside = lambda rows, t: any(k == key and a <= t < b for k, a, b in rows)
        test = {"union": lambda t: inside(first, t) or inside(second, t), "intersection": lambda t: inside(first, t) and inside(second, t),
                "difference": lambda t: inside(first, t) and not inside(second, t)}[how]
        on = [t for t in range(-1, 230) if test(t)]
        want[key] = [(key, t, next(e for e in range(t, 400) if not test(e))) for t in on if not test(t - 1)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, start long, end long")
    for bucket in (7, None):
        got = intervals.combine_intervals(frame(first), frame(second), ["k"], how, bucket)
        assert rows_of(got) == sorted(sum(want.values(), []), key=repr)


def test_complement_and_weeks(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, start long, end long")
    got = intervals.complement(frame([("a", 3, 5), ("a", 4, 8), ("a", 12, 30)]), frame([("a", 0, 20), ("b", 1, 2)]), ["k"])
    assert rows_of(got) == [("a", 0, 3), ("a", 8, 12), ("b", 1, 2)]
    cut = intervals.weekly_bars(frame([("a", 3, 25), ("b", 10, 19)]), ["k"], 10)
    assert rows_of(cut) == [("a", 0, 3, 9), ("a", 10, 10, 19), ("a", 20, 20, 25), ("b", 10, 10, 19)]


def test_bars_of_masks(spark):
    rows = [("a", 10 * i, g, None if i == 4 else float(g), 1.0 if i in (1, 2, 7) else 9.0) for i in range(10) for g in range(3)]
    cells = spark.createDataFrame(rows, "k string, t long, g int, z double, r double")
    got = intervals.ratio_outside(cells, ["k"], "t", F.col("z").isNotNull(), "r", (1.0, 0.5), 0)
    assert rows_of(got) == [("a", 0, 0), ("a", 30, 30), ("a", 50, 60), ("a", 80, 90)]
    merged = intervals.ratio_outside(cells, ["k"], "t", F.col("z").isNotNull(), "r", (1.0, 0.5), 30)
    assert rows_of(merged) == [("a", 0, 60), ("a", 80, 90)] or rows_of(merged) == [("a", 0, 90)]
    listed = spark.createDataFrame([("a", 15, 35), ("a", 71, 79)], "k string, start long, end long")
    assert rows_of(intervals.listed_bars(cells.select("k", "t").distinct(), listed, ["k"], "t", 0)) == [("a", 20, 30)]


@pytest.mark.parametrize("group", [2, 5, 4096])
def test_keyless_scans_in_two_levels(spark, monkeypatch, group):
    monkeypatch.setattr(ordered, "BUCKETS_PER_GROUP", group)
    rng = random.Random(group)
    times = sorted(rng.sample(range(-100, 400), 90))
    values = [None if rng.random() < 0.4 else rng.randrange(50) for _ in times]
    df = spark.createDataFrame(list(zip(times, values)), "t long, v int")
    got = ordered.add_neighbours(df, [], "t", ["v"], ["v"], bucket=7)
    assert rows_of(got.select("t", "prev_v", "next_v")) == sorted([(t, ([None] + values)[i], (values + [None])[i + 1]) for i, t in enumerate(times)], key=repr)
    got = ordered.add_carried(df, [], "t", {"l": "v"}, {"n": "v"}, bucket=7)
    last = lambda xs: next((x for x in xs if x is not None), None)
    assert rows_of(got.select("t", "l", "n")) == sorted([(t, last(values[i::-1]), last(values[i:])) for i, t in enumerate(times)], key=repr)
    known = lambda xs: [x for x in xs if x is not None]
    got = ordered.add_running(df, [], "t", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, bucket=7)
    assert rows_of(got.select("t", "s", "m")) == sorted([(t, sum(known(values[:i + 1])) if known(values[:i + 1]) else None, max(known(values[:i + 1]), default=None)) for i, t in enumerate(times)], key=repr)
    near = lambda prev, row: row("_at") - prev("_at") <= 5
    start = []
    for i, t in enumerate(times):
        start.append(start[-1] if i and t - times[i - 1] <= 5 else t)
    assert rows_of(ordered.add_groups(df, [], "t", near, bucket=7).select("t", "run")) == sorted(zip(times, start), key=repr)


def test_sketches_merge(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=30_000), np.full(10_000, 0.5), rng.exponential(size=20_000)])
    df = spark.createDataFrame([(int(i % 40), "a", float(v)) for i, v in enumerate(values)] + [(3, "a", None), (4, "a", float("nan")), (5, "b", 2.0), (6, "c", None)], "t long, k string, v double")
    path = str(tmp_path / "sketches")
    for part in ("t < 20", "t >= 20"):
        sketches.write_sketches(sketches.period_sketches(df.filter(part), ["k"], "t", "v", 5), path)
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.9, "e": 1.0}
    merged = sketches.sketch_quantiles(sketches.merge_sketches(sketches.read_sketches(spark, path), ["k"]), probs)
    rows = {r["k"]: r for r in merged.collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["n"], rows["a"]["min"], rows["a"]["max"]) == (len(values), values.min(), values.max())
    assert all(rows["b"][p] == 2.0 for p in probs)
    errors = {r["k"]: r for r in sketches.rank_errors(df, merged, ["k"], "v", probs).collect()}
    assert max(errors["a"][p] for p in probs) <= 2 * sketches.rank_error() and errors["b"]["c"] == 0
    assert sketches.rank_error(1600) < sketches.rank_error(400) / 3


def test_hexagons(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=800), rng.exponential(size=800)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("one", 3.0, 4.0), ("a", None, 1.0)], "k string, x double, y double")
    got = [r for r in stats.hex_bins(df, ["k"], "x", "y", 10).collect()]
    assert [(r["x"], r["y"], r["n"]) for r in got if r["k"] == "one"] == [(3.0, 4.0, 1)]
    cells = [r for r in got if r["k"] == "a"]
    assert sum(r["n"] for r in cells) == 800
    # every point belongs to the nearest of all centres of both lattices
    nx, ny = 10, int(10 / math.sqrt(3))
    u, w = (x - x.min()) / np.ptp(x) * nx, (y - y.min()) / np.ptp(y) * ny
    # ties between neighbours, at the extremes, go to the larger
    centres = [(i + h, j + h) for h in (0, 0.5) for i in range(nx + 1, -2, -1) for j in range(ny + 1, -2, -1)]
    far = np.array([(u - i) ** 2 + 3 * (w - j) ** 2 for i, j in centres])
    want = np.bincount(far.argmin(0), minlength=len(centres))
    place = lambda c: (round(x.min() + c[0] / nx * np.ptp(x), 6), round(y.min() + c[1] / ny * np.ptp(y), 6))
    assert {(round(r["x"], 6), round(r["y"], 6)): r["n"] for r in cells} == {place(c): n for c, n in zip(centres, want.tolist()) if n}


@pytest.mark.parametrize("block", [1, 2048])
def test_lag_sums(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "LAG_BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(k, int(t), float(v)) for k in "ab" for t, v in zip(rng.integers(-50, 200, 80), rng.normal(size=80))]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    points = df.groupBy("k", "t").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    want = {}
    for k, t, v in rows:
        for j, u, w in rows:
            if k == j and 0 < u - t <= 30:
                d, m = want.get((k, u - t), (0, 0))
                want[k, u - t] = d + (v - w) ** 2, m + 1
    got = {(r["k"], r["lag"]): (r["d"], r["m"]) for r in stats.lag_sums(points, ["k"], "t", 30).collect()}
    assert set(got) == set(want)
    assert all(got[p][1] == want[p][1] and got[p][0] == pytest.approx(want[p][0]) for p in want)
    with pytest.raises(ValueError):
        stats.lag_sums(points, ["k"], "t", stats.MOST_LAGS + 1)


def test_late_corrections_state():
    """Against a plain look-up after every arrival; what is evicted does not change what comes later."""
    import pandas as pd

    from skycolumn.streaming import corrections as late

    rng = random.Random(9)
    times = rng.sample(range(1000), 60)
    rows = [(t * 10, f"r{t}", float(t), None) for t in times[:40]]
    steps = [(t * 10 + rng.choice([0, 5]), None, None, float(i)) for i, t in enumerate(times[30:])]
    arrivals = sorted(rows + steps, key=lambda r: r[0] + rng.randrange(3000))
    held, known, given, watermark = late._EMPTY, [], {}, 0
    for start in range(0, len(arrivals), 9):
        part = arrivals[start:start + 9]
        known += part
        frame = pd.DataFrame(part, columns=["_t", "_id", "_v", "_c"]).astype({"_v": float, "_c": float})
        frame["_t"] = frame["_t"].astype("datetime64[us]")
        held, changed = late._revised(late._received(held, frame))
        for i, c, n in zip(held["id"][changed], held["c"][changed], held["n"][changed]):
            given[i] = (c, n)
        watermark = max(watermark, max(r[0] for r in known) - 4000)
        assert all(r[0] >= watermark - 4000 for r in part)
        held = late._evicted(held, watermark)
        assert (held["t"] >= watermark).all() and (held["st"] <= watermark).sum() <= 1
    # arrivals are at most 3000 late, so the watermark never drops what can change
    last = {}
    for t, _, _, c in known:
        if c is not None:
            last[t] = c
    for t, i, _, _ in rows:
        before = [s for s in last if s <= t]
        want = last[max(before)] if before else math.nan
        assert given[i][0] == want or (math.isnan(want) and math.isnan(given[i][0]))
    assert max(n for _, n in given.values()) > 1


def test_late_corrections_are_sharded(spark, tmp_path):
    """The rows of one key are dealt to many groups; every group gets all steps, and late ones revise."""
    from datetime import datetime, timedelta

    from skycolumn.streaming import corrections as late

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows, steps, out, marks = (str(tmp_path / n) for n in ("rows", "steps", "out", "marks"))
    kinds = ("k string, ts timestamp_ntz, id long, v double", "k string, ts timestamp_ntz, c double")
    spark.createDataFrame([("a", at(m), m, float(m)) for m in range(300)], kinds[0]).coalesce(1).write.parquet(rows)
    for first in (0, 50):
        spark.createDataFrame([("a", at(m), float(m)) for m in range(first, 300, 100)], kinds[1]).coalesce(1).write.mode("append").parquet(steps)
        read = lambda path, kind: spark.readStream.schema(kind).parquet(path)
        revised = late.stream_late_corrections(read(rows, kinds[0]), read(steps, kinds[1]), "ts", ["k"], "id", "v", "c", "fixed", "20000 days")
        query = late.write_revisions(revised, out, marks)
        query.awaitTermination()
    got = late.latest(spark.read.parquet(out), ["id"]).collect()
    assert {r["id"]: (r["fixed"], r["revision"]) for r in got} == {m: (m + m // 50 * 50.0, 1 + m // 50 % 2) for m in range(300)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == late.SHARDS
