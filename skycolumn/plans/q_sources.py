"""Queries that write, read back, pack, update and stream the given tables."""

import os
import uuid

from pyspark.sql import functions as F

from skycolumn.operators import joins as J
from skycolumn.operators.ordered import DAY, attach_row, epoch_us, from_epoch_us
from skycolumn.plans.bindings import SLOT, r6, sql
from skycolumn.plans.registry import query
from skycolumn.session import checkpoint_dir
from skycolumn.sources import files, packing, store, versions
from skycolumn.specs import INSTRUMENT_SPECS, VariableSpec
from skycolumn.streaming import streams

SPECS = (VariableSpec("z", -60.0, 45.0, 0.1), VariableSpec("vel", -2.0, 2.0, 0.05), VariableSpec("temp", -60.0, 40.0, 0.001))


def fresh(t, name):
    return os.path.join(checkpoint_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def timed(t):
    return t.cells().withColumn("time", from_epoch_us(F.col("t")))


def stored(t, name):
    path = fresh(t, name)
    store.upsert_region(timed(t), path, SPECS)
    return path


@query("store_window_read", "S1 S11", sql("cells", """
SELECT radar, t, range, z FROM cells WHERE radar = 'click' AND t BETWEEN epoch_us(TIMESTAMP '2024-01-05 11:50:00') AND epoch_us(TIMESTAMP '2024-01-09 18:10:00')"""))
def _(t):
    out = store.read_cells(t.spark, stored(t, "cells"), "click", "2024-01-05 12:00:00", "2024-01-09 18:00:00")
    return out.select("radar", epoch_us(F.col("time")).alias("t"), "range", "z")


@query("store_region_rewrite", "S11", sql("cells", """
SELECT radar, t, range, CASE WHEN t // 86400000000 % 2 = 0 THEN z + 1 ELSE z END AS z FROM cells"""))
def _(t):
    """Every other day is rewritten, twice; the store must not change the second time."""
    path = stored(t, "cells")
    again = timed(t).filter(F.floor(F.col("t") / DAY) % 2 == 0).withColumn("z", F.col("z") + 1)
    for _ in range(2):
        store.upsert_region(again, path, SPECS)
    return t.spark.read.parquet(path).select("radar", epoch_us(F.col("time")).alias("t"), "range", "z")


@query("store_column_update", "S12", sql("cells", """
SELECT radar, t, range, z, CASE WHEN t // 86400000000 % 3 = 0 AND z > -50 THEN vel * 2 ELSE vel END AS vel FROM cells"""))
def _(t):
    path = stored(t, "cells")
    new = timed(t).filter((F.floor(F.col("t") / DAY) % 3 == 0) & (F.col("z") > -50)).select("radar", "time", "range", (F.col("vel") * 2).alias("vel"))
    store.update_columns(t.spark, new, path, ["vel"], fresh(t, "staging"))
    return t.spark.read.parquet(path).select("radar", epoch_us(F.col("time")).alias("t"), "range", "z", "vel")


@query("safe_file_reads", "S2", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, CAST(2 AS BIGINT) AS excluded FROM events GROUP BY 1""")
def _(t):
    """Events written as many files next to an empty and a corrupt one."""
    path = fresh(t, "many")
    t.events.drop("ts").write.parquet(path)
    spark = t.spark
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content in (("empty.parquet", b""), ("corrupt.parquet", b"no parquet file")):
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fs_path, name))
        out.write(bytearray(content))
        out.close()
    rows, excluded = files.read_many_safe(spark, [path], "event_id bigint, user_id bigint, event_type string, value double, props string")
    bad = excluded.agg(F.count(F.lit(1)).alias("excluded"))
    return attach_row(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total")), bad)


@query("file_selection", "S3", """
WITH f AS (SELECT 'scan_' || strftime(ts, '%Y%m%d-%H%M') || '_' || event_type || '.nc' AS name, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ft, event_id FROM events)
SELECT name, epoch_us(ft) AS t, event_id FROM f WHERE ft BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-11 18:30:00'
UNION ALL SELECT name, t, event_id FROM (SELECT name, epoch_us(ft) AS t, event_id FROM f WHERE ft < TIMESTAMP '2024-01-10 06:00:00' ORDER BY ft DESC, name DESC, event_id DESC LIMIT 1)""")
def _(t):
    name = F.concat(F.lit("scan_"), F.date_format("ts", "yyyyMMdd-HHmm"), F.lit("_"), "event_type", F.lit(".nc"))
    manifest = t.events.select(name.alias("name"), "event_id")
    out = files.select_files(manifest, "name", r"_(\d{8}-\d{4})_", "yyyyMMdd-HHmm", "2024-01-10 06:00:00", "2024-01-11 18:30:00")
    return out.select("name", epoch_us(F.col("file_time")).alias("t"), "event_id")


@query("delimited_corrections", "S4 S15", """
SELECT epoch_us(o_orderdate) AS t, o_orderkey, round(o_totalprice / 7, 6) AS correction FROM orders""")
def _(t):
    path = fresh(t, "csv")
    store.append_calibration(t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), "o_orderkey",
                                             (F.col("o_totalprice") / 7).alias("correction")), path)
    rows, _ = files.read_csv_table(t.spark, path, "datetime timestamp_ntz, o_orderkey bigint, correction double", "\t")
    return rows.select(epoch_us(F.col("datetime")).alias("t"), "o_orderkey", "correction")


@query("versioned_days", "S11 S12", sql("cells", """
, d AS (SELECT radar, CAST(t // 86400000000 AS BIGINT) AS day, count(*) AS n, sum(z) AS z, bool_or(vel > 2.55) AS failed FROM cells GROUP BY 1, 2)
SELECT radar, day, n, round(z + CASE WHEN failed THEN 0 ELSE n END, 4) AS z, CASE WHEN failed THEN 'too fast' END AS reason FROM d"""))
def _(t):
    """All days are committed, then again with other values: days that break a rule keep their rows and are listed with the reason."""
    path = fresh(t, "versions")
    keys = ("radar", "time", "gate")
    cells = timed(t).select("radar", "time", "gate", "z", "vel")
    versions.commit_days(cells, path, keys=keys)
    versions.commit_days(cells.withColumn("z", F.col("z") + 1), path, {"too fast": F.col("vel") > 2.55}, keys)
    day = F.datediff("date", F.lit("1970-01-01")).cast("long").alias("day")
    rows = versions.read_versions(t.spark, path).groupBy("radar", day).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("z"), 4).alias("z"))
    return rows.join(versions.failed_days(t.spark, path).select("radar", day, "reason"), ["radar", "day"], "left")


@query("text_column_total", "S15 F21", """
SELECT sum(TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE)) AS total FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return store.column_total(t.orders.select(text.alias("hours")), "hours")


@query("sounding_texts", "S5", sql("scans", """
SELECT scan, gate AS line, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (scan % 28) * 86400000000 + gate * 60000000 AS t, CAST(1000 - gate AS DOUBLE) AS p, CASE WHEN disc = 0.1 THEN NULL ELSE qty - 20 END AS temp FROM scans"""))
def _(t):
    """One text per scan is built from its rows and parsed back."""
    num = lambda c: F.format_string("%.2f", c.cast("double"))
    # a line in ten has an empty field
    line = F.concat_ws("\t", F.format_string("%d.0", F.col("gate") * 60), F.format_string("00:%02d:00", F.col("gate")), num(1000.0 - F.col("gate")),
                       F.when(F.col("disc") == 0.1, "").otherwise(num(F.col("qty") - 20)), num(F.col("disc")), num(F.col("tax")), F.lit("0.0"), F.lit("22.0"), F.lit("38.0"), num(F.col("gate") * 100), F.lit("-5.0"))
    body = t.scans().groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("gate", line.alias("l")))).alias("rows"))
    head = "Station: x\nBalloon 1.0\nProfile Data:\nTime\tUTC Time\tP\tT\tHu\tWs\tWd\tLong.\tLat.\tGeopot\tDewp.\n[s]\t[h]\t[hPa]\t[C]\t[%]\t[m/s]\t[deg]\t[deg]\t[deg]\t[m]\t[C]\n"
    text = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["l"]), "\n"), F.lit("\nTropopauses\n1.0\t2.0\n"))
    name = F.concat(F.lit("profile_"), F.format_string("202401%02d", (F.col("scan") % 28 + 1).cast("int")), F.lit("_"), F.col("scan").cast("string"), F.lit(".txt"))
    out = files.parse_soundings(body.select(text.alias("value"), name.alias("file")))
    return out.select(F.regexp_extract("file", r"_(\d+)\.txt", 1).cast("long").alias("scan"), F.floor(F.col("time_sec") / 60).cast("int").alias("line"),
                      epoch_us(F.col("time")).alias("t"), F.col("P_hPa").alias("p"), F.col("T_degC").alias("temp"))


@query("daily_merge", "S6", sql("cells", """
, x AS (SELECT t, gate, max(vel) AS extra FROM cells WHERE radar = 'view' GROUP BY 1, 2)
SELECT radar, CAST(t // 86400000000 AS BIGINT) AS day, count(*) AS n, round(sum(z), 4) AS z, round(sum(extra), 4) AS extra FROM cells LEFT JOIN x USING (t, gate) GROUP BY 1, 2"""))
def _(t):
    c = timed(t)
    hour = F.floor(F.col("t") / SLOT) % 4
    pieces = [c.filter(hour == h).drop("vel") for h in range(4)]
    extra = c.filter("radar = 'view'").groupBy("t", "gate").agg(F.max("vel").alias("extra"))
    path = fresh(t, "daily")
    store.merge_daily(pieces, extra, ["t", "gate"], path)
    return t.spark.read.parquet(path).groupBy("radar", F.datediff("date", F.lit("1970-01-01")).cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("z"), 4).alias("z"), r6(F.sum("extra"), 4).alias("extra"))


def _pack_sql(lo, hi, prec, fill, col):
    return f"CASE WHEN {col} IS NULL THEN {fill} ELSE least(greatest(round_even((least(greatest({col}, {lo}::DOUBLE), {hi}::DOUBLE) - ({lo}::DOUBLE)) / {prec}::DOUBLE, 0), 0), {fill - 1}) END"


@query("packed_cells", "S7 S8", sql("grid_cells", f"""
SELECT radar, t, gate, CAST({_pack_sql(-60.0, 45.0, 0.1, 65535, 'z')} AS INT) AS z, CAST({_pack_sql(-2.0, 2.0, 0.05, 255, 'vel')} AS SMALLINT) AS vel,
       CAST({_pack_sql(-60.0, 40.0, 0.001, 4294967295, 'temp')} AS BIGINT) AS temp, coalesce(z > -50, false) AS strong FROM grid_cells"""))
def _(t):
    df = t.grid_cells().withColumn("strong", F.col("z") > -50)
    return packing.pack(df, packing.packing_spec(SPECS)).select("radar", "t", "gate", "z", "vel", "temp", "strong")


_X, _KA = ({s.name: s for s in INSTRUMENT_SPECS[k]} for k in ("X", "Ka"))


@query("instrument_packing", "S7 S8", f"""
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity / 9.7 AS spectrumwidth, l_tax * 13.1 AS rhohv FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST({_pack_sql(0.0, 6.0, 0.001, 65535, 'spectrumwidth')} AS INT) AS width_ka,
  CAST({_pack_sql(0.0, 3.0, 0.01, 65535, 'spectrumwidth')} AS INT) AS width_x, CAST({_pack_sql(0.0, 1.0, 0.01, 255, 'rhohv')} AS SMALLINT) AS rhohv_x FROM w""")
def _(t):
    w = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 9.7).alias("spectrumwidth"), (F.col("l_tax") * 13.1).alias("rhohv"))
    ka, x = (packing.packing_spec(s.values()) for s in (_KA, _X))
    return w.select("l_orderkey", "l_linenumber", packing.pack_column(F.col("spectrumwidth"), ka["spectrumwidth"]).alias("width_ka"),
                    packing.pack_column(F.col("spectrumwidth"), x["spectrumwidth"]).alias("width_x"), packing.pack_column(F.col("rhohv"), x["rhohv"]).alias("rhohv_x"))


@query("unpacked_cells", "S9", sql("grid_cells", f"""
, p AS (SELECT radar, t, gate, CAST({_pack_sql(-60.0, 45.0, 0.1, 65535, 'z')} AS INT) AS z FROM grid_cells)
SELECT radar, t, gate, round(CASE WHEN z <> 65535 THEN z * 0.1::DOUBLE + -60.0 END, 6) AS z FROM p"""))
def _(t):
    spec = packing.packing_spec(SPECS)
    out = packing.unpack(packing.pack(t.grid_cells(), spec), spec)
    return out.select("radar", "t", "gate", r6(F.col("z")).alias("z"))


@query("canonical_names", "S14", """
SELECT l_orderkey AS time, CAST(l_linenumber AS DOUBLE) AS range, l_quantity AS reflectivity, l_discount AS velocity, CAST(l_partkey AS DOUBLE) AS numpeaks FROM lineitem""")
def _(t):
    raw = t.lineitem.select(F.col("l_orderkey").alias("time"), F.col("l_linenumber").cast("double").alias("range"), F.col("l_quantity").alias("Zg"),
                            F.col("l_discount").alias("VELg"), F.col("l_partkey").alias("NPKg"), F.col("l_tax").alias("unknown"))
    return J.rename_canonical(raw, "Ka").select("time", "range", "reflectivity", "velocity", "numpeaks")


def event_stream(t):
    """The events as a stream; the pattern finds one file as well as a folder of part files."""
    return t.spark.readStream.schema(t.events.schema).parquet(os.path.join(t.dir, "events.parquet*"))


def drain(df, out, marks, mode="append"):
    """Run a stream over the files that are there; a second run goes on where the first one ended."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def drained(t, df):
    out = fresh(t, "out")
    drain(df, out, fresh(t, "marks"))
    return t.spark.read.schema(df.schema).parquet(out)


def replayed(t, make):
    """``make(stream)`` over the events, however many files they are, then over rows of a far later time.

    The later rows, marked by the column ``closing``, move the watermark past every open window.
    """
    path, out, marks = fresh(t, "replay"), fresh(t, "out"), fresh(t, "marks")
    parts = [t.events.withColumn("closing", F.lit(False))]
    late = t.events.groupBy("event_type").agg(*[F.max(c).alias(c) for c in t.events.columns if c != "event_type"])
    for days in (40, 41):
        parts.append(late.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days} DAY")).withColumn("closing", F.lit(True)).select(*parts[0].columns))
    for part in parts:
        part.write.mode("append").parquet(path)
        found = make(t.spark.readStream.schema(parts[0].schema).parquet(path))
        drain(found, out, marks)
    return t.spark.read.schema(found.schema).parquet(out)


@query("streamed_grid", "T1s", """
SELECT event_type AS key, epoch_us(ts) // 1800000000 * 1800000000 AS t, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1, 2""")
def _(t):
    found = {"n": F.count(F.lit(1)), "v": F.avg("value"), "closing": F.bool_or("closing")}
    out = replayed(t, lambda stream: streams.stream_grid(stream, "ts", ["event_type"], "30 minutes", "2 hours", found))
    return out.filter("NOT closing").select(F.col("event_type").alias("key"), epoch_us(F.col("ts")).alias("t"), "n", r6(F.col("v")).alias("v"))


@query("streamed_intervals", "T3s", """
WITH f AS (SELECT event_type AS key, epoch_us(ts) AS t FROM events WHERE value > 30),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) < 3600000000 THEN 0 ELSE 1 END AS ch FROM f),
s AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY t) AS id FROM g)
SELECT key, min(t) AS start, max(t) AS "end", count(*) AS n FROM s GROUP BY key, id""")
def _(t):
    on = (F.col("value") > 30) | F.col("closing")
    done = replayed(t, lambda stream: streams.stream_intervals(stream, "ts", ["event_type"], on, "1 hour", "2 hours"))
    last = t.events.agg(F.max("ts").alias("_last"))  # one row
    return attach_row(done, last).filter(F.col("start") <= F.col("_last")).select(
        F.col("event_type").alias("key"), epoch_us(F.col("start")).alias("start"), epoch_us(F.col("end")).alias("end"), "n")


@query("streamed_step_correction", "T4s", """
WITH s AS (SELECT o_orderdate + INTERVAL 9000 DAY AS ts, arg_min(o_totalprice, o_orderkey) / 1000 AS corr FROM orders GROUP BY 1)
SELECT event_id, round(value + corr, 6) AS corrected FROM events e ASOF LEFT JOIN s ON e.ts >= s.ts""")
def _(t):
    steps = (t.orders.groupBy((F.col("o_orderdate") + F.expr("INTERVAL 9000 DAY")).alias("ts"))
             .agg((F.min_by("o_totalprice", "o_orderkey") / 1000).alias("corr")))
    table = streams.steps_per_slot(steps, "ts", [], "corr", 86400)
    out = streams.stream_stepjoin(event_stream(t), table, "ts", [], "value", "corr", 86400, "corrected")
    return drained(t, out.select("event_id", "corrected")).select("event_id", r6(F.col("corrected")).alias("corrected"))


@query("streamed_late_corrections", "T4s J2", """
WITH s AS (SELECT o_orderdate + INTERVAL 9000 DAY AS ts, arg_min(o_totalprice, o_orderkey) / 1000 AS corr FROM orders GROUP BY 1),
n AS (SELECT ts, corr, epoch_us(ts) // 86400000000 % 2 AS half FROM s),
a AS (SELECT e.event_id, n.corr AS early FROM events e ASOF LEFT JOIN (SELECT * FROM n WHERE half = 0) n ON e.ts >= n.ts),
b AS (SELECT e.event_id, round(value + s.corr, 6) AS corrected, s.corr AS late FROM events e ASOF LEFT JOIN s ON e.ts >= s.ts)
SELECT event_id, corrected, CAST(CASE WHEN early IS DISTINCT FROM late THEN 2 ELSE 1 END AS BIGINT) AS revision FROM a JOIN b USING (event_id)""")
def _(t):
    """Events and the corrections of every other day arrive first, the other days' corrections afterwards."""
    from skycolumn.streaming import corrections as late
    rows, steps, out, marks = (fresh(t, n) for n in ("rows", "steps", "out", "marks"))
    every = (t.orders.groupBy((F.col("o_orderdate") + F.expr("INTERVAL 9000 DAY")).alias("ts")).agg((F.min_by("o_totalprice", "o_orderkey") / 1000).alias("corr"))
             .withColumn("half", F.floor(epoch_us(F.col("ts")) / 86_400_000_000) % 2))
    types = t.events.agg(F.array_sort(F.collect_set("event_type")).alias("_types"))
    every = attach_row(every, types).select("ts", "corr", "half", F.explode("_types").alias("event_type"))
    t.events.select("event_type", "ts", "event_id", "value").write.parquet(rows)
    for half in (0, 1):
        every.filter(F.col("half") == half).select("event_type", "ts", "corr").write.mode("append").parquet(steps)
        stream = lambda path, schema: t.spark.readStream.schema(schema).parquet(path)
        revised = late.stream_late_corrections(stream(rows, "event_type string, ts timestamp_ntz, event_id long, value double"),
                                               stream(steps, "event_type string, ts timestamp_ntz, corr double"), "ts", ["event_type"], "event_id", "value", "corr", "corrected", "20000 days")
        late.write_revisions(revised, out, marks).awaitTermination()
    return late.latest(t.spark.read.parquet(out), ["event_id"]).select("event_id", r6(F.col("corrected")).alias("corrected"), "revision")


@query("streamed_store", "T2s W16", """
SELECT event_type AS radar, epoch_us(ts) AS t, CAST(user_id AS DOUBLE) AS range, min(value) AS z FROM events GROUP BY 1, 2, 3""")
def _(t):
    """Each event arrives twice; the store keeps one row per key."""
    path = fresh(t, "store")
    twice = event_stream(t).select(F.col("event_type").alias("radar"), F.col("ts").alias("time"), F.col("user_id").cast("double").alias("range"),
                                   F.col("value").alias("z"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    streams.stream_store(twice, path, fresh(t, "marks"), (VariableSpec("z"),)).awaitTermination()
    return t.spark.read.parquet(path).select("radar", epoch_us(F.col("time")).alias("t"), "range", "z")
