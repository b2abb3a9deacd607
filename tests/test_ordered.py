"""Ordered primitives: results must not depend on the bucket width."""

import random

import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from skycolumn.operators import asof, intervals, ordered, regrid, windows

WIDTHS = [7, 50, 10_000]


def series(spark, n=200, seed=1, keys=("a", "b")):
    rnd = random.Random(seed)
    rows = []
    for key in keys:
        for t in sorted(rnd.sample(range(2000), n)):
            rows.append((key, t, None if rnd.random() < 0.2 else round(rnd.uniform(0, 10), 2)))
    return spark.createDataFrame(rows, "key string, t long, v double"), rows


def by_key(rows):
    return {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}


@pytest.mark.parametrize("bucket", WIDTHS)
def test_neighbours_fill_and_running(spark, bucket):
    df, rows = series(spark)
    got = ordered.add_neighbours(df, ["key"], "t", prev=["v", "t"], next=["v"], bucket=bucket)
    got = ordered.add_carried(got, ["key"], "t", last={"f": "v"}, next={"b": "v"}, bucket=bucket)
    got = ordered.add_running(got, ["key"], "t", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, bucket=bucket)
    want = []
    for part in by_key(rows).values():
        pdf = pd.DataFrame(part, columns=["key", "t", "v"])
        pdf["pv"], pdf["pt"], pdf["nv"] = pdf.v.shift(1), pdf.t.shift(1), pdf.v.shift(-1)
        pdf["f"], pdf["b"] = pdf.v.ffill(), pdf.v.bfill()
        pdf["s"], pdf["m"] = pdf.v.cumsum().ffill(), pdf.v.cummax().ffill()
        want += list(pdf.itertuples(index=False, name=None))
    clean = lambda r: tuple(None if x is None or x != x else round(x, 6) if isinstance(x, float) else x for x in r)
    out = got.select("key", "t", "v", "prev_v", F.col("prev_t").cast("double"), "next_v", "f", "b", "s", "m")
    assert [clean(r) for r in rows_of(out)] == sorted((clean(r) for r in want), key=repr)


@pytest.mark.parametrize("bucket", WIDTHS)
@pytest.mark.parametrize("fill", [None, 2])
def test_mask_to_intervals(spark, bucket, fill):
    df, rows = series(spark)
    got = rows_of(intervals.mask_to_intervals(df.withColumn("on", F.col("v") > 3), ["key"], "t", "on", fill, bucket))
    want = []
    for key, part in by_key(rows).items():
        flags = [(r[1], r[2] is not None and r[2] > 3) for r in part]
        if fill:
            out, i = [], 0
            while i < len(flags):
                j = i
                while j < len(flags) and flags[j][1] == flags[i][1]:
                    j += 1
                on = flags[i][1] or j - i <= fill
                out += [(t, on) for t, _ in flags[i:j]]
                i = j
            flags = out
        run = []
        for t, on in flags + [(None, False)]:
            if on:
                run.append(t)
            elif run:
                want.append((key, run[0], run[-1], len(run)))
                run = []
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("bucket", WIDTHS)
def test_intervals_back_to_mask(spark, bucket):
    df, _ = series(spark)
    flagged = df.withColumn("on", F.coalesce(F.col("v") > 3, F.lit(False)))
    found = intervals.mask_to_intervals(flagged, ["key"], "t", "on", bucket=bucket)
    back = intervals.interval_flag(flagged, found, "t", ["key"], "again", bucket)
    assert back.filter(F.col("on") != F.col("again")).count() == 0
    assert back.count() == flagged.count()


@pytest.mark.parametrize("bucket", WIDTHS)
@pytest.mark.parametrize("gap", [0, 15])
def test_merge_close_overlaps(spark, bucket, gap):
    rnd = random.Random(5)
    rows = [(k, s, s + rnd.choice([0, 3, 10, 400])) for k in "ab" for s in [rnd.randrange(3000) for _ in range(60)]]
    df = spark.createDataFrame(rows, "key string, start long, end long")
    want = []
    for k in "ab":
        current = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if current and s - current[1] <= gap:
                current[1] = max(current[1], e)
            else:
                current and want.append((k, *current))
                current = [s, e]
        want.append((k, *current))
    assert rows_of(intervals.merge_close(df, ["key"], gap, bucket=bucket)) == sorted(want, key=repr)


@pytest.mark.parametrize("bucket", WIDTHS)
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_against_pandas(spark, bucket, direction):
    left, lrows = series(spark, 150, 2)
    right, rrows = series(spark, 40, 3)
    got = asof.asof(left.select("key", "t"), right.select("key", "t", F.col("t").alias("w")), "t", ["key"], ["w"],
                    direction, 30, bucket=bucket)
    l = pd.DataFrame(lrows, columns=["key", "t", "v"]).sort_values("t")
    r = pd.DataFrame(rrows, columns=["key", "t", "v"]).sort_values("t").assign(w=lambda d: d.t)
    want = pd.merge_asof(l[["key", "t"]], r[["key", "t", "w"]], on="t", by="key", direction=direction, tolerance=30)
    clean = sorted(((k, t, None if w != w else int(w)) for k, t, w in want[["key", "t", "w"]].itertuples(index=False)), key=repr)
    assert rows_of(got.select("key", "t", "w")) == clean


def test_asof_ties(spark):
    left = spark.createDataFrame([(10,)], "t long")
    right = spark.createDataFrame([(5, "early"), (15, "late")], "t long, w string")
    pick = lambda tie: asof.asof_nearest(left, right, "t", [], ["w"], None, tie).first()["w"]
    assert (pick("backward"), pick("later")) == ("early", "late")


@pytest.mark.parametrize("bucket", WIDTHS)
def test_linear_regridding(spark, bucket):
    df, rows = series(spark)
    got = {(r[0], r[1]): r[2] for r in rows_of(regrid.regrid_linear_time(df, ["key"], "t", ["v"], 10, bucket=bucket))}
    for key, part in by_key(rows).items():
        for (_, t0, v0), (_, t1, v1) in zip(part, part[1:]):
            for x in range(-(-t0 // 10) * 10, t1, 10):
                want = v0 if x == t0 else None if v0 is None or v1 is None else v0 + (v1 - v0) * (x - t0) / (t1 - t0)
                have = got[(key, x)]
                assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
        assert min(x for k, x in got if k == key) >= part[0][1] and max(x for k, x in got if k == key) <= part[-1][1]


def test_regridding_onto_own_grid_is_identity(spark):
    rows = [("a", t, float(t % 7)) for t in range(0, 500, 10)]
    df = spark.createDataFrame(rows, "key string, t long, v double")
    for out in (regrid.regrid_nearest(df, ["key"], "t", ["v"], 10, 5), regrid.regrid_linear_time(df, ["key"], "t", ["v"], 10),
                regrid.bin_average(df, ["key"], "t", ["v"], 10)):
        assert rows_of(out) == sorted(rows, key=repr)


@pytest.mark.parametrize("bucket", [400, 10_000])
def test_rolling_and_smoothing(spark, bucket):
    rnd = random.Random(9)
    values = [None if rnd.random() < 0.1 else rnd.uniform(0, 5) for _ in range(120)]
    df = spark.createDataFrame([("a", i * 10, v) for i, v in enumerate(values)], "key string, t long, v double")
    got = windows.rolling_mean(df, ["key"], "t", "v", 10, 6, 2, bucket=bucket)
    want = pd.Series(values, dtype=float).rolling(6, center=True, min_periods=2).mean()
    for r in got.collect():
        w = want[r["t"] // 10]
        assert (r["v_mean"] is None) == (w != w) and (w != w or abs(r["v_mean"] - w) < 1e-9)
    smooth = {r["t"] // 10: r["smooth"] for r in windows.gap_interp_smooth(df, ["key"], "t", "v", 10, bucket=bucket).collect()}
    filled = list(values)
    for i, v in enumerate(values):
        if v is None:
            near = [(j, values[j]) for j in range(max(0, i - 5), min(120, i + 5)) if values[j] is not None]
            weights = [1 / (abs(j - i) + 1) for j, _ in near]
            filled[i] = sum(w * x for w, (_, x) in zip(weights, near)) / sum(weights)
    import numpy as np
    for i in range(120):
        at = min(max(i, 5), 114)
        poly = np.polyfit(range(at - 5, at + 6), filled[at - 5:at + 6], 3)
        assert abs(np.polyval(poly, i) - smooth[i]) < 1e-6


def test_keep_runs_on_a_long_axis(spark):
    flags = [1, 1, 1, 0, 1, 1, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([("a", i * 5, bool(f)) for i, f in enumerate(flags)], "key string, t long, ok boolean")
    for bucket in (7, 100):
        got = intervals.keep_runs(df, ["key"], "t", "ok", 3, 5, bucket=bucket)
        assert [int(r["ok"]) for r in got.orderBy("t").collect()] == [1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1]


def test_bucket_width_looks_at_the_fullest_bucket(spark):
    df = spark.range(5000).select(F.lit("a").alias("key"), (F.col("id") * 1000).alias("t"))  # 5 s of data
    assert ordered.bucket_width(df, ["key"], "t", max_rows=1000) == ordered.SECOND
    assert ordered.bucket_width(df, ["key"], "t", max_rows=10_000) == 30 * ordered.DAY
    assert ordered.bucket_width(df, ["key"], "t", max_rows=10) == ordered.SECOND
    assert ordered.bucket_width(df, ["key"], "t", at_least=7 * ordered.HOUR, max_rows=10) == 7 * ordered.HOUR
    wide = spark.range(5000).select(F.lit("a").alias("key"), (F.col("id") * ordered.MINUTE).alias("t"))
    assert ordered.bucket_width(wide, ["key"], "t", max_rows=1500) == ordered.DAY


def test_one_path_whatever_the_cut(spark):
    """Results do not depend on how often quantiles are cut or how many rows a bucket may hold."""
    from skycolumn.operators import stats

    df, _ = series(spark)
    found = [rows_of(stats.exact_quantiles(df, ["key"], "v", {"m": 0.5}, shifts=shifts, piece_rows=rows)) for shifts in ((34, 12), (50, 30, 8)) for rows in (0, 20, 10**6)]
    assert all(f == found[0] for f in found)
    bounds = spark.createDataFrame([("a", 0, 100_000), ("b", 5, 5)], "key string, lo long, hi long")
    assert regrid.make_time_grid(bounds, "t", "lo", "hi", 7).count() == 100_000 // 7 + 1 + 1


def test_first_per_time(spark):
    df = spark.createDataFrame([("a", 1, 3, "x"), ("a", 1, 2, "y"), ("a", 2, 9, "z")], "key string, t long, o long, v string")
    assert rows_of(ordered.first_per_time(df, ["key"], "t", "o")) == [("a", 1, 2, "y"), ("a", 2, 9, "z")]
