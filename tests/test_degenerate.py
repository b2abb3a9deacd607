"""Inputs without spread, without values or with odd values."""

import math

from pyspark.sql import functions as F

from conftest import rows_of
from skycolumn.operators import calibration, intervals, stats
from skycolumn.sources import files, packing, store
from skycolumn.specs import VariableSpec
from skycolumn.streaming import streams


def test_key_without_valid_cells(spark):
    cells = spark.createDataFrame([("a", None, 100.0), ("b", 25.0, 100.0)], "k string, z double, h double")
    assert rows_of(stats.outlier_share(cells, ["k"], "z", "h")) == [("a", 0, None, None), ("b", 1, 100.0, 0.0)]
    rows = spark.createDataFrame([("a", 1.0, 9000.0, None, None)], "k string, over double, top double, peaks long, g double")
    got = stats.class_contrast(rows, ["k"], "over", "top", "peaks", "g").collect()
    assert all(r["multi"] is None and r["n"] == 0 for r in got)


def test_constant_coordinate(spark):
    pairs = spark.createDataFrame([("a", 5.0, float(i % 7)) for i in range(50)] + [("b", float(i % 9), float(i % 9)) for i in range(90)], "k string, x double, y double")
    left = calibration.density_filter(pairs, ["k"], "x", "y").groupBy("k").count().collect()
    assert {r["k"] for r in left} == {"a"}  # all cells of b are equally dense
    limits = {r["k"]: r for r in calibration.range_limits(pairs, ["k"], "x", "y").collect()}
    assert limits["b"]["slope"] is not None and abs(limits["b"]["slope"] - 1) < 1e-9
    assert "a" not in limits or limits["a"]["rmse"] is None


def test_variogram_of_one_lag_and_of_large_values(spark):
    one = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0)], "k string, t long, v double")
    assert rows_of(stats.variogram(one, ["k"], "t", "v", 5, 100)) == [("a", 0, 10.0, 2.0, 1)]
    big = spark.createDataFrame([("a", t, 1e9 + t % 3) for t in range(20)], "k string, t long, v double")
    got = stats.variogram(big, ["k"], "t", "v", 4, 6).collect()
    pairs = [(b - a, (a % 3 - b % 3) ** 2) for a in range(20) for b in range(a + 1, 20) if b - a <= 6]
    low, width = 1, (6 - 1) / 4
    for r in got:
        inside = [d for lag, d in pairs if int((lag - low) / width) == r["bin"]]
        assert math.isclose(r["gamma"], sum(inside) / len(inside) / 2, rel_tol=1e-6)


def test_event_of_one_sample(spark):
    events = spark.createDataFrame([("a", 0, 0, 2.0, 2.0, 2.0), ("a", 5, 5, 4.0, 4.0, 4.0)], "k string, start long, end long, v_mean double, v_min double, v_max double")
    got = intervals.merge_events(events, ["k"], 10, 0, ["v"]).collect()
    assert [(r["start"], r["end"], r["v_mean"]) for r in got] == [(0, 5, 3.0)]


def test_nan_packs_as_missing(spark):
    spec = packing.packing_spec([VariableSpec("z", -60.0, 45.0, 0.1)])
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.04)], "i int, z double")
    back = packing.unpack(packing.pack(df, spec), spec)
    assert [(r["i"], r["z"] if r["z"] is None else round(r["z"], 6)) for r in back.orderBy("i").collect()] == [(1, None), (2, None), (3, 1.0)]


def test_null_in_delimited_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    store.append_calibration(spark.createDataFrame([("a", 1.5), ("b", None)], "name string, x double").coalesce(1), path)
    rows, bad = files.read_csv_table(spark, path, "name string, x double", "\t")
    assert rows_of(rows) == [("a", 1.5), ("b", None)] and bad.count() == 0


def test_corrections_after_the_last_step(spark, tmp_path):
    steps = spark.sql("SELECT TIMESTAMP_NTZ'2026-01-01 06:00:00' AS ts, 1.0D AS corr UNION ALL SELECT TIMESTAMP_NTZ'2026-01-03 06:00:00', 2.0D")
    events = spark.sql("""SELECT 1 AS i, TIMESTAMP_NTZ'2026-01-01 05:00:00' AS ts, 10.0D AS v UNION ALL SELECT 2, TIMESTAMP_NTZ'2026-01-02 00:00:00', 10.0D
        UNION ALL SELECT 3, TIMESTAMP_NTZ'2026-01-03 07:00:00', 10.0D UNION ALL SELECT 4, TIMESTAMP_NTZ'2031-05-05 00:00:00', 10.0D""")
    table = streams.steps_per_slot(steps, "ts", [], "corr", 86400)
    got = streams.stream_stepjoin(events, table, "ts", [], "v", "corr", 86400, "out").select("i", "out")
    assert rows_of(got) == [(1, None), (2, 11.0), (3, 12.0), (4, 12.0)]


def test_conflicting_rows_of_one_key_in_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [("a", 1.0, 5.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("a", 2.0, 7.0)]
    made = spark.createDataFrame(rows, "radar string, range double, z double").withColumn("time", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    for k in range(2):  # the second delivery brings nothing new
        made.write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        streams.stream_store(stream, out, str(tmp_path / "marks"), (VariableSpec("z", -60.0, 45.0, 0.1),)).awaitTermination()
    assert sorted((r["range"], r["z"]) for r in spark.read.parquet(out).collect()) == [(1.0, 3.0), (2.0, 7.0)]


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    from types import SimpleNamespace

    from skycolumn.plans import q_sources

    spark.range(100).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    t = SimpleNamespace(spark=spark, dir=str(tmp_path), events=spark.read.parquet(str(tmp_path / "events.parquet")))
    marks, out = str(tmp_path / "marks"), str(tmp_path / "out")
    q_sources.drain(q_sources.event_stream(t), out, marks)
    assert spark.read.parquet(out).count() == 100


def test_temporary_tables(spark, tmp_path):
    from skycolumn.session import cut_lineage, temporary_tables

    outer = cut_lineage(spark.range(3))
    with temporary_tables(spark):
        inner = cut_lineage(spark.range(5))
        path = inner.inputFiles()[0]
        assert inner.count() == 5
    import os
    assert not os.path.exists(path.removeprefix("file://")) and outer.count() == 3


def test_field_of_one_time(spark):
    from skycolumn.operators import regrid

    table = spark.createDataFrame([(100, 0.0, 1.0), (100, 10.0, 3.0)], "t long, h double, v double")
    points = spark.createDataFrame([(5, 5.0), (100, 0.0), (900, 20.0)], "t long, r double")
    got = {r["t"]: r["x"] for r in regrid.interp_at(table, points, "t", "h", "v", "r", "x").collect()}
    assert got == {5: 2.0, 100: 1.0, 900: 5.0}
