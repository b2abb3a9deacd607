"""Packing, the store, files and streams."""

import datetime as dt
import os
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from skycolumn.sources import files, packing, store
from skycolumn.specs import STORE_SPECS, VariableSpec
from skycolumn.streaming import streams

SPECS = (VariableSpec("z", -60.0, 45.0, 0.1), VariableSpec("wet", flag=True))
DAY = dt.datetime(2024, 11, 5)


def test_widths():
    spec = packing.packing_spec(STORE_SPECS)
    assert {n: p.bits for n, p in spec.items()} == {
        "reflectivity": 16, "velocity": 8, "skewness": 16, "spectrumwidth": 16, "LDR": 16, "rhohv": 8, "snrh": 16,
        "snrv": 16, "numpeaks": 8, "cloudtop": 16, "zdi": 16}
    assert spec["velocity"].fill == 255 and spec["reflectivity"].fill == 65535


def test_pack_round_trip(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.uniform(-60, 45), rnd.random() < 0.5) for i in range(300)] + [(300, None, None), (301, 99.0, True), (302, -99.0, True)]
    df = spark.createDataFrame(rows, "i long, z double, wet boolean")
    spec = packing.packing_spec(SPECS)
    back = {r["i"]: r for r in packing.unpack(packing.pack(df, spec), spec).collect()}
    for i, z, wet in rows[:300]:
        assert abs(back[i]["z"] - z) <= 0.05 + 1e-9 and back[i]["wet"] == wet
    assert back[300]["z"] is None and back[300]["wet"] is False
    assert abs(back[301]["z"] - 45) < 1e-9 and abs(back[302]["z"] + 60) < 1e-9


def test_half_even(spark):
    p = packing.Packing(1.0, 0.0, 255, 8, "short", 0.0, 100.0)
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(packing.pack_column(F.col("x"), p)).collect()] == [0, 2, 2]


def cells(spark, days, z):
    rows = [("Ka", DAY + dt.timedelta(days=d, hours=h), r * 25.0, z, "x") for d in days for h in (0, 12) for r in range(3)]
    return spark.createDataFrame(rows, "radar string, time timestamp_ntz, range double, z double, unknown string")


def test_store_rewrites_only_its_days(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert_region(cells(spark, [0, 1, 2], 1.0), path, SPECS[:1])
    for _ in range(2):
        store.upsert_region(cells(spark, [1], 2.0), path, SPECS[:1])
    back = spark.read.parquet(path)
    assert "unknown" not in back.columns and back.count() == 18
    assert {(r["date"].day, r["z"]) for r in back.select("date", "z").distinct().collect()} == {(5, 1.0), (6, 2.0), (7, 1.0)}
    window = store.read_cells(spark, path, "Ka", "2024-11-06 00:05:00", "2024-11-06 11:55:00")
    assert window.count() == 6  # the padding reaches both samples
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_update_columns(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert_region(cells(spark, [0, 1], 1.0), path, SPECS[:1])
    new = cells(spark, [1, 2], 5.0).filter("range = 25").select("radar", "time", "range", "z")
    report = {(r["date"].day): (r["matched"], r["unmatched"]) for r in store.update_columns(spark, new, path, ["z"], str(tmp_path / "st")).collect()}
    assert report == {6: (2, 0), 7: (0, 2)}
    back = spark.read.parquet(path)
    assert back.count() == 12 and back.filter("z = 5").count() == 2


def test_safe_reads(spark, tmp_path):
    good = str(tmp_path / "f")
    spark.range(10).withColumn("v", F.col("id") * 1.0).repartition(2).write.parquet(good)
    for name, text in (("empty.parquet", ""), ("bad.parquet", "nothing")):
        (tmp_path / "f" / name).write_text(text)
    rows, excluded = files.read_many_safe(spark, [good], "id bigint, v double")
    assert rows.count() == 10
    assert {os.path.basename(r[0]) for r in excluded.collect()} == {"empty.parquet", "bad.parquet"}


def test_safe_reads_keep_sound_files_without_rows(spark, tmp_path):
    folder = tmp_path / "a {b} [c]"
    spark.range(10).repartition(2).write.parquet(str(folder))
    spark.range(0).write.mode("append").parquet(str(folder))
    whole = next(folder.glob("part-*")).read_bytes()
    for name, content in (("none.parquet", b""), ("bad 1.parquet", b"PAR1 nothing PAR1"), ("cut.parquet", whole[:-20])):
        (folder / name).write_bytes(content)
    rows, excluded = files.read_many_safe(spark, [str(tmp_path / "a*")], "id bigint")
    assert rows.count() == 10
    assert {os.path.basename(r[0]) for r in excluded.collect()} == {"none.parquet", "bad%201.parquet", "cut.parquet"}
    sound = str(tmp_path / "sound")
    spark.range(3).write.parquet(sound)
    assert files.read_many_safe(spark, [sound], "id bigint")[1].count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_safe_reads_of_a_split_table(spark):
    """A table of one row group that is read in several parts: the first part has no row and writes a file without rows."""
    from skycolumn.plans import catalogue

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert {r["excluded"] for r in catalogue.QUERIES["safe_file_reads"](spark, "/root/testdata/sf0.001").collect()} == {2}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_selection_adds_the_one_before(spark):
    names = [f"a_20241105-{h:02d}00.nc" for h in range(0, 24, 6)] + ["junk.nc"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = files.select_files(df, "name", r"_(\d{8}-\d{4})", "yyyyMMdd-HHmm", "2024-11-05 07:00:00", "2024-11-05 13:00:00")
    assert sorted(r["name"] for r in got.collect()) == ["a_20241105-0600.nc", "a_20241105-1200.nc"]
    # HHMM, not HHMMSS
    late = files.select_files(spark.createDataFrame([("a_20241105-1230.nc",)], "name string"), "name", r"_(\d{8}-\d{4})", "yyyyMMdd-HHmm",
                              "2024-11-05 12:29:00", "2024-11-05 12:31:00")
    assert late.count() == 1


def test_csv_rejects(spark, tmp_path):
    path = tmp_path / "outages.csv"
    path.write_text("start,end\n2024-11-05T00:00:00,2024-11-05T01:00:00\n2024-11-05T0x,2024\n")
    rows, rejects = files.read_csv_table(spark, str(path), "start timestamp_ntz, end timestamp_ntz")
    assert rows.count() == 1 and rejects.count() == 1


def test_soundings(spark, tmp_path):
    names = ["Time", "UTC Time", "P", "T", "Hu", "Ws", "Wd", "Long.", "Lat.", "Geopot", "Dewp."]
    head = lambda n: "Station\nProfile Data:\n" + "\t".join(n) + "\n" + "\t".join("[u]" for _ in n) + "\n"
    rows = [["0.0", "23:59:58", "890.0", "-1.5", "80", "3", "200", "22.0", "38.0", "1690", "-3"], ["2.0", "23:59:59", "", "-1.6", "NaN", "-", "201", "22.0", "38.0", "1700", ""]]
    body = lambda order: "\n".join("\t".join(r[i] for i in order) for r in rows)
    (tmp_path / "x_20241105_a.txt").write_text(head(names) + body(range(11)) + "\nTropopauses:\n1\t2\t3\n")
    turned = [0, 3, 2, 1, *range(4, 9)]  # other order, two columns less
    (tmp_path / "x_20241106_b.txt").write_text((head([names[i] + " " for i in turned]) + body(turned)).replace("\n", "\r\n"))
    got = files.read_soundings(spark, str(tmp_path)).orderBy("file", "line").collect()
    assert len(got) == 4
    for day, r in zip((5, 5, 6, 6), got):
        assert r["time"].date() == dt.date(2024, 11, day)
    assert got[0]["time"] == dt.datetime(2024, 11, 5, 23, 59, 58) and got[0]["T_degC"] == -1.5 and got[0]["Tdew_degC"] == -3
    assert (got[1]["P_hPa"], got[1]["RH_perc"], got[1]["Wsp_mps"], got[1]["Tdew_degC"], got[1]["T_degC"]) == (None, None, None, None, -1.6)
    assert (got[2]["P_hPa"], got[2]["T_degC"], got[2]["elv_masl"], got[2]["lat_deg"]) == (890.0, -1.5, None, 38.0)


def test_append_and_total(spark, tmp_path):
    path = str(tmp_path / "cal")
    row = spark.createDataFrame([("2024-11-05", 1.23456789, 1)], "t string, cc double, found int")
    for _ in range(2):
        store.append_calibration(row, path)
    rows, _ = files.read_csv_table(spark, path, "t string, cc double, found int", "\t")
    assert [r["cc"] for r in rows.collect()] == [1.234568, 1.234568]
    assert store.column_total(spark.createDataFrame([("1.5",), ("n/a",), ("2",)], "h string"), "h").first()[0] == 3.5


@pytest.fixture()
def feed(spark, tmp_path):
    rnd = random.Random(2)
    base = [("a", DAY + dt.timedelta(minutes=m), float(m % 17)) for m in sorted(rnd.sample(range(600), 200))]
    folder = str(tmp_path / "feed")
    schema = "key string, ts timestamp_ntz, v double"
    spark.createDataFrame(base, schema).coalesce(1).write.parquet(folder)
    for d in (1, 2):
        spark.createDataFrame([("a", DAY + dt.timedelta(days=d), -1.0)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream, spark.createDataFrame(base, schema), tmp_path


def drain(spark, df, tmp_path):
    (df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, feed):
    stream, batch, tmp_path = feed
    make = lambda df: streams.stream_grid(df, "ts", ["key"], "30 minutes", "1 hour", {"n": F.count(F.lit(1)), "m": F.avg("v")})
    assert rows_of(drain(spark, make(stream), tmp_path).filter("m >= 0")) == rows_of(make(batch))


def test_stream_sessions_equal_batch(spark, feed):
    stream, batch, tmp_path = feed
    flag = (F.col("v") > 8) | (F.col("v") < 0)
    make = lambda df: streams.stream_intervals(df, "ts", ["key"], flag, "10 minutes", "1 hour")
    got = drain(spark, make(stream), tmp_path).filter(F.col("start") < F.lit(DAY + dt.timedelta(hours=12)).cast("timestamp_ntz"))
    assert rows_of(got) == rows_of(make(batch))


def test_stream_store_keeps_one_row_per_key(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "radar string, time timestamp_ntz, range double, z double"
    for z in (1.0, 2.0):  # the second delivery corrects the first
        rows = [("Ka", DAY + dt.timedelta(minutes=i), 25.0, z) for i in range(5 if z == 1.0 else 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        query = streams.stream_store(source, str(tmp_path / "store"), str(tmp_path / f"marks{z}"), SPECS[:1], watermark="1 day")
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 5
