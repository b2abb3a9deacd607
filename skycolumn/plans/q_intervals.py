"""Queries of runs, intervals and events."""

from pyspark.sql import functions as F

from skycolumn.operators import intervals as I
from skycolumn.operators.ordered import DAY, HOUR, MINUTE, epoch_us, floor_div
from skycolumn.plans.bindings import SLOT, STEP, r6, sql
from skycolumn.plans.registry import query

ISLANDS = """
, f AS (SELECT key, t, {flag} AS flag FROM {source}),
c AS (SELECT *, CASE WHEN lag(flag) OVER w IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS ch FROM f
      WINDOW w AS (PARTITION BY key ORDER BY t)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY t) AS id FROM c),
r AS (SELECT key, id, flag, min(t) AS s, max(t) AS e, count(*) AS n FROM g GROUP BY 1, 2, 3)"""


@query("true_runs", "I1", sql("series", ISLANDS.format(flag="v > 30", source="series") + """
SELECT key, s AS start, e AS "end", n FROM r WHERE flag"""))
def _(t):
    return I.mask_to_intervals(t.series().withColumn("flag", F.col("v") > 30), ["key"], "t", "flag")


@query("true_runs_small_gaps_filled", "I1", sql("series", ISLANDS.format(flag="v > 30", source="series") + """,
h AS (SELECT *, flag OR n <= 3 AS f2 FROM r),
h2 AS (SELECT *, CASE WHEN lag(f2) OVER (PARTITION BY key ORDER BY s) IS NOT DISTINCT FROM f2 THEN 0 ELSE 1 END AS ch FROM h),
h3 AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY s) AS id2 FROM h2)
SELECT key, min(s) AS start, max(e) AS "end", CAST(sum(n) AS BIGINT) AS n FROM h3 WHERE f2 GROUP BY key, id2"""))
def _(t):
    return I.mask_to_intervals(t.series().withColumn("flag", F.col("v") > 30), ["key"], "t", "flag", fill=3)


MERGE = """
, iv AS (SELECT event_type AS key, epoch_us(ts) AS s, max(epoch_us(ts) + CAST(round(value * 10000000) AS BIGINT)) AS e
         FROM events GROUP BY 1, 2),
p AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
q AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s) AS id FROM p),
m AS (SELECT key, min(s) AS s, max(e) AS e FROM q GROUP BY key, id)"""


def event_intervals(t):
    start = epoch_us(F.col("ts"))
    return t.events.select(F.col("event_type").alias("key"), start.alias("start"),
                           (start + F.round(F.col("value") * 10_000_000).cast("long")).alias("end"))


@query("merge_close_intervals", "I2", sql("series", MERGE.format(gap=5 * MINUTE) + """
SELECT key, s AS start, e AS "end" FROM m"""))
def _(t):
    return I.merge_close(event_intervals(t), ["key"], 5 * MINUTE)


@query("interval_membership", "I3 J6 F18", sql("series steps", MERGE.format(gap=0) + """
SELECT x.key, x.t, coalesce(bool_or(x.t <= m.e), false) AS inside
FROM steps x ASOF LEFT JOIN m ON x.key = m.key AND x.t >= m.s GROUP BY 1, 2"""))
def _(t):
    return I.interval_flag(t.steps().select("key", "t"), event_intervals(t), "t", ["key"])


@query("points_outside_outages", "F18", sql("series steps", MERGE.format(gap=0) + """
SELECT x.key, x.t FROM steps x ASOF LEFT JOIN m ON x.key = m.key AND x.t >= m.s
WHERE NOT coalesce(x.t <= m.e, false)"""))
def _(t):
    return I.outside_outages(t.steps().select("key", "t"), event_intervals(t), "t", ["key"])


@query("points_per_interval", "J6", sql("series", """
, iv AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + (o_custkey % 10) * 86400000000 AS e
         FROM orders),
d AS (SELECT epoch_us(l_shipdate) AS t, count(*) AS n FROM lineitem GROUP BY 1)
SELECT id, CAST(sum(n) AS BIGINT) AS n FROM iv JOIN d ON d.t BETWEEN iv.s AND iv.e GROUP BY 1"""))
def _(t):
    start = epoch_us(F.col("o_orderdate"))
    spans = t.orders.select(
        F.col("o_orderkey").alias("id"), start.alias("start"), (start + F.col("o_custkey") % 10 * DAY).alias("end"))
    days = t.lineitem.groupBy(epoch_us(F.col("l_shipdate")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return I.interval_join(days, spans, "t", [], 7 * DAY).groupBy("id").agg(F.sum("n").alias("n"))


@query("empty_stretches", "I4", sql("steps", """
, f AS (SELECT key, t, v IS NULL AS flag FROM steps),
c AS (SELECT *, CASE WHEN lag(flag) OVER w IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS ch FROM f
      WINDOW w AS (PARTITION BY key ORDER BY t)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY t) AS id FROM c)
SELECT key, min(t) AS start, max(t) AS "end" FROM g WHERE flag GROUP BY key, id
HAVING max(t) - min(t) >= 1200000000"""))
def _(t):
    return I.null_intervals(t.steps(), ["key"], "t", "v", STEP, 2 * STEP)


PRECIP = """
, w AS (SELECT radar AS key, t, count(*) FILTER (WHERE vel < 0.2 AND gate < 12) >= 3 AS flag,
               avg(temp) FILTER (WHERE gate < 12) AS temp, avg(z) FILTER (WHERE gate < 12) AS melt
        FROM grid_cells GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN lag(flag) OVER (PARTITION BY key ORDER BY t) IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS ch FROM w),
g AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY t) AS id FROM c),
ev AS (SELECT key, min(t) AS s, max(t) AS e, count(*) AS n, min(temp) AS temp_min, max(temp) AS temp_max, avg(temp) AS temp_mean,
              min(melt) AS melt_min, max(melt) AS melt_max, avg(melt) AS melt_mean
       FROM g WHERE flag GROUP BY key, id HAVING max(t) - min(t) >= 21600000000)"""


def precip_events(t):
    low = t.grid_cells().filter("gate < 12").select(F.col("radar").alias("key"), "t", "vel", "temp", F.col("z").alias("melt"))
    return I.detect_events(low, ["key"], "t", F.col("vel") < 0.2, 3, SLOT, ["temp", "melt"])


@query("precipitation_events", "I5", sql("grid_cells", PRECIP + """
SELECT key, s AS start, e AS "end", n, round(temp_min, 6) AS temp_min, round(temp_max, 6) AS temp_max,
       round(temp_mean, 6) AS temp_mean, round(melt_mean, 6) AS melt_mean FROM ev"""))
def _(t):
    names = ["temp_min", "temp_max", "temp_mean", "melt_mean"]
    return precip_events(t).select("key", "start", "end", "n", *[r6(F.col(c)).alias(c) for c in names])


@query("precipitation_flag", "I6 W2", sql("grid_cells", """
, k AS (SELECT radar, t, count(*) FILTER (WHERE z >= -48 AND vel <= 1.2) AS hit, count(*) AS n FROM grid_cells WHERE gate < 10 GROUP BY 1, 2)
SELECT radar, t, max(CAST(coalesce(CASE WHEN n >= 5 THEN CAST(hit AS DOUBLE) / n END >= 0.3, false) AS INT)) OVER
       (PARTITION BY radar ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) = 1 AS precip FROM k"""))
def _(t):
    from skycolumn.operators.windows import rolling_any
    flag = I.precip_flag(t.grid_cells(), ["radar"], "t", "gate", "z", "vel", fraction=0.3, z_limit=-48.0, v_limit=1.2)
    return rolling_any(flag, ["radar"], "t", "precip", SLOT, 4, "precip").select("radar", "t", "precip")


@query("merged_precipitation", "I7 I8", sql("grid_cells", PRECIP + """,
p AS (SELECT *, lag(e) OVER (PARTITION BY key ORDER BY s) AS pe FROM ev),
q AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s) AS id FROM p),
m AS (SELECT key, min(s) AS start, max(e) AS "end", count(*) AS n_events, min(temp_min) AS temp_min, max(temp_max) AS temp_max,
      sum(temp_mean * CAST(e - s AS DOUBLE)) / sum(CAST(e - s AS DOUBLE)) FILTER (WHERE temp_mean IS NOT NULL) AS temp_mean,
      sum(melt_mean * CAST(e - s AS DOUBLE)) / sum(CAST(e - s AS DOUBLE)) FILTER (WHERE melt_mean IS NOT NULL) AS melt_mean
      FROM q GROUP BY key, id)
SELECT key, start, "end", n_events, round(temp_min, 6) AS temp_min, round(temp_max, 6) AS temp_max,
       round(temp_mean, 6) AS temp_mean, round(melt_mean, 6) AS melt_mean,
       CASE WHEN temp_mean IS NULL AND melt_mean IS NULL THEN 'unknown'
            WHEN coalesce(temp_mean < -6, true) AND coalesce(melt_mean < -46, true) THEN 'solid' ELSE 'liquid' END AS kind
FROM m WHERE "end" - start >= 43200000000"""))
def _(t):
    merged = I.merge_events(precip_events(t), ["key"], 2 * SLOT, 2 * SLOT, ["temp", "melt"])
    kind = I.precip_type(F.col("temp_mean"), F.col("melt_mean"), -6.0, -46.0)
    names = ["temp_min", "temp_max", "temp_mean", "melt_mean"]
    return merged.select("key", "start", "end", "n_events", *[r6(F.col(c)).alias(c) for c in names], kind.alias("kind"))


@query("hourly_event_codes", "I9", sql("grid_cells", PRECIP + """,
k AS (SELECT key, s, e, CASE WHEN temp_mean < -6 THEN 2 ELSE 1 END AS code,
             CAST(ceil(s / 3600000000.0) AS BIGINT) AS a, CAST(ceil(e / 3600000000.0) AS BIGINT) AS b FROM ev),
x AS (SELECT key, h, arg_max(code, s) AS code FROM (SELECT key, s, code, unnest(generate_series(a, b)) AS h FROM k) GROUP BY 1, 2),
gr AS (SELECT key, unnest(generate_series(min(a), max(b))) AS h FROM k GROUP BY 1)
SELECT gr.key, gr.h * 3600000000 AS t, coalesce(x.code, 0) AS code FROM gr LEFT JOIN x ON x.key = gr.key AND x.h = gr.h"""))
def _(t):
    events = precip_events(t).withColumn("code", F.when(F.col("temp_mean") < -6, 2).otherwise(1))
    return I.hourly_events(events, ["key"], "code").select("key", "t", "code")


COVER = """
, o AS (SELECT DISTINCT key, t // 86400000000 * 86400000000 AS day, t FROM series),
d AS (SELECT DISTINCT key, day FROM o),
x AS (SELECT key, day, t, 1 AS kind FROM o WHERE t BETWEEN day + 18000000000 AND day + 61200000000
      UNION ALL SELECT key, day, day + 18000000000, 0 FROM d UNION ALL SELECT key, day, day + 61200000000, 2 FROM d),
n AS (SELECT *, lag(t) OVER w AS pt, lag(kind) OVER w AS pk FROM x WINDOW w AS (PARTITION BY key, day ORDER BY t, kind)),
gaps AS (SELECT key, day, pt AS s, t AS e, CASE WHEN pk = 0 AND kind = 2 THEN 'full day missing' WHEN pk = 0 THEN 'late start'
         WHEN kind = 2 THEN 'early end' ELSE 'mid-day gap' END AS note FROM n WHERE t - pt > 1800000000)"""


def coverage(t):
    times = t.series().select("key", (floor_div(F.col("t"), DAY) * DAY).alias("day"), "t")
    return I.coverage_gaps(times, ["key"], "t", "day", 5 * HOUR, 17 * HOUR, 30 * MINUTE), times


@query("coverage_gaps", "I10", sql("series", COVER + """
SELECT key, day, s AS start, e AS "end", note FROM gaps
WHERE NOT (abs(s - day - 28500000000) <= 600000000 AND abs(e - day - 36000000000) <= 600000000)"""))
def _(t):
    gaps, _ = coverage(t)
    return I.drop_scheduled(gaps, 7 * HOUR + 55 * MINUTE, 10 * HOUR, 10 * MINUTE)


@query("covered_periods", "I10", sql("series", COVER + """,
a AS (SELECT key, day, s, e FROM gaps UNION ALL SELECT key, day, day + 61200000000, day + 61200000000 FROM d),
b AS (SELECT key, day, coalesce(max(e) OVER (PARTITION BY key, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             day + 18000000000) AS f, s FROM a)
SELECT key, day, f AS "from", s AS "to" FROM b WHERE f < s"""))
def _(t):
    gaps, times = coverage(t)
    return I.covered_periods(gaps, times.select("key", "day").distinct(), ["key"], 5 * HOUR, 17 * HOUR)


@query("availability_bars", "I11 K2", sql("grid_cells", """
, f AS (SELECT radar AS key, t, bool_or(coalesce(z > -40, false)) AS flag FROM grid_cells GROUP BY 1, 2),
c AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t) AS pt FROM f WHERE flag),
g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t) AS id FROM c)
SELECT key, min(t) AS start, max(t) AS "end" FROM g GROUP BY key, id"""))
def _(t):
    cells = t.grid_cells().withColumnRenamed("radar", "key")
    return I.availability_bars(cells, ["key"], "t", F.col("z") > -40, SLOT, 2 * SLOT)


BARS = """
c AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t) AS pt FROM f WHERE flag),
g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t) AS id FROM c),
b AS (SELECT key, min(t) AS s, max(t) AS e FROM g GROUP BY key, id)"""


@query("availability_ratio", "I11", sql("grid_cells", """
, f AS (SELECT radar AS key, t, bool_or(coalesce(z > -40, false)) AND coalesce(max(vel) < 3.35 - 2 * 0.91 OR max(vel) > 3.35 + 2 * 0.91, false) AS flag FROM grid_cells GROUP BY 1, 2),""" + BARS + """
SELECT key, s AS start, e AS "end" FROM b"""))
def _(t):
    """Times with echo whose ratio lies outside the calibration constant by more than two spreads."""
    from skycolumn.specs import CALIBRATION_DB
    cells = t.grid_cells().withColumnRenamed("radar", "key")
    return I.ratio_outside(cells, ["key"], "t", F.col("z") > -40, "vel", CALIBRATION_DB["W"], 2 * SLOT)


@query("availability_lost", "I11 I3", sql("series grid_cells", MERGE.format(gap=0) + """,
x AS (SELECT DISTINCT radar AS key, t FROM grid_cells),
f AS (SELECT x.key, x.t, coalesce(x.t <= m.e, false) AS flag FROM x ASOF LEFT JOIN m ON x.key = m.key AND x.t >= m.s),""" + BARS + """
SELECT key, s AS start, e AS "end" FROM b"""))
def _(t):
    """Listed periods as bars of the samples that lie in them."""
    times = t.grid_cells().select(F.col("radar").alias("key"), "t").distinct()
    return I.listed_bars(times, event_intervals(t), ["key"], "t", 2 * SLOT)


WEEK = 7 * DAY


@query("weekly_type_bars", "I11 F13", sql("grid_cells", """
, tp AS (SELECT radar, t, max(range) FILTER (WHERE z > -45) AS top FROM grid_cells GROUP BY 1, 2),
f AS (SELECT radar || '/' || kind AS key, t, coalesce(CASE WHEN top < 500 THEN 'orographic' ELSE 'frontal' END = kind AND top IS NOT NULL, false) AS flag
      FROM tp, (SELECT unnest(['orographic', 'frontal']) AS kind)),""" + BARS + f""",
w AS (SELECT key, s, e, unnest(generate_series(s // {WEEK}, e // {WEEK})) * {WEEK} AS week FROM b)
SELECT split_part(key, '/', 1) AS key, split_part(key, '/', 2) AS kind, week, greatest(s, week) AS start, least(e, week + {WEEK} - 1) AS "end" FROM w"""))
def _(t):
    """Per cloud type the bars of its times, cut at the ends of weeks."""
    from skycolumn.functions.scalar import cloud_type
    tops = t.grid_cells().groupBy(F.col("radar").alias("key"), "t").agg(F.max(F.when(F.col("z") > -45, F.col("range"))).alias("top"))
    typed = tops.withColumn("_type", F.when(F.col("top").isNotNull(), cloud_type(F.col("top"), 500.0)))
    flags = typed.withColumn("kind", F.explode(F.array(F.lit("orographic"), F.lit("frontal"))))
    bars = I.mask_bars(flags, ["key", "kind"], "t", F.col("_type") == F.col("kind"), 2 * SLOT)
    return I.weekly_bars(bars, ["key", "kind"], WEEK)


@query("interval_algebra", "I2 I3 I11", sql("series", """
, a AS (SELECT event_type AS key, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 10000000) AS BIGINT) AS e FROM events),
b AS (SELECT event_type AS key, epoch_us(ts) - 1800000000 AS s, epoch_us(ts) + 1800000000 AS e FROM events WHERE value > 150),
d AS (SELECT key, min(s) // 86400000000 * 86400000000 AS s, max(e) AS e FROM a GROUP BY 1),
u AS (SELECT key, s AS t, 1 AS x, 0 AS y, 0 AS z FROM a WHERE s < e UNION ALL SELECT key, e, -1, 0, 0 FROM a WHERE s < e UNION ALL SELECT key, s, 0, 1, 0 FROM b
      UNION ALL SELECT key, e, 0, -1, 0 FROM b UNION ALL SELECT key, s, 0, 0, 1 FROM d UNION ALL SELECT key, e, 0, 0, -1 FROM d),
v AS (SELECT DISTINCT key, t, sum(x) OVER w > 0 AS ia, sum(y) OVER w > 0 AS ib, sum(z) OVER w > 0 AS id FROM u WINDOW w AS (PARTITION BY key ORDER BY t)),
l AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t) - t AS len FROM v),
k AS (SELECT key, unnest([{'how': 'union', 'ok': ia OR ib}, {'how': 'intersection', 'ok': ia AND ib}, {'how': 'difference', 'ok': ia AND NOT ib}, {'how': 'complement', 'ok': id AND NOT ia}]) AS h, t, len FROM l),
c AS (SELECT key, h.how AS how, h.ok AS ok, t, len, lag(h.ok) OVER (PARTITION BY key, h.how ORDER BY t) AS p FROM k)
SELECT key, how, count(*) FILTER (WHERE ok AND NOT coalesce(p, false)) AS n, CAST(coalesce(sum(len) FILTER (WHERE ok), 0) AS BIGINT) AS total FROM c GROUP BY 1, 2"""))
def _(t):
    """Number and total length of the stretches of each combination of two sets of intervals."""
    first = event_intervals(t)
    at = epoch_us(F.col("ts"))
    second = t.events.filter("value > 150").select(F.col("event_type").alias("key"), (at - 30 * MINUTE).alias("start"), (at + 30 * MINUTE).alias("end"))
    span = first.groupBy("key").agg((floor_div(F.min("start"), DAY) * DAY).alias("start"), F.max("end").alias("end"))
    made = {"union": lambda inside: inside("a") | inside("b"), "intersection": lambda inside: inside("a") & inside("b"),
            "difference": lambda inside: inside("a") & ~inside("b"), "complement": lambda inside: inside("d") & ~inside("a")}
    out = I.sweep_intervals({"a": first, "b": second, "d": span}, ["key"], made).select("key", "how", (F.col("end") - F.col("start")).alias("len"))
    kinds = span.select("key", F.explode(F.array(*[F.lit(h) for h in made])).alias("how"))
    sums = out.groupBy("key", "how").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"))
    return kinds.join(sums, ["key", "how"], "left").fillna(0, ["n", "total"])


@query("spectral_patches", "I12", sql("spectra", """
, x AS (SELECT vec_id, vec_id % 10 AS scan, b, power[b] > 0.08 AS ok FROM spectra, (SELECT unnest(generate_series(1, 64)) AS b)),
a AS (SELECT *, sum(ch) OVER (PARTITION BY vec_id ORDER BY b) AS id FROM
      (SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY vec_id ORDER BY b) IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END AS ch FROM x)),
k AS (SELECT vec_id, scan, b, ok AND count(*) OVER (PARTITION BY vec_id, id) >= 3 AS ok FROM a),
a2 AS (SELECT *, sum(ch) OVER (PARTITION BY scan, b ORDER BY vec_id) AS id FROM
      (SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY scan, b ORDER BY vec_id) IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END AS ch FROM k)),
k2 AS (SELECT vec_id, b, ok AND count(*) OVER (PARTITION BY scan, b, id) >= 2 AS ok FROM a2)
SELECT vec_id, CAST(b AS INT) AS bin FROM k2 WHERE ok"""))
def _(t):
    bins = t.spectra().select("vec_id", (F.col("vec_id") % 10).alias("scan"), F.posexplode("power").alias("pos", "p"))
    bins = bins.select("vec_id", "scan", (F.col("pos") + 1).alias("bin"), (F.col("p") > 0.08).alias("ok"))
    kept = I.keep_runs(bins, ["vec_id"], "bin", "ok", 3, bounded=True)
    kept = I.keep_runs(kept, ["scan", "bin"], "vec_id", "ok", 2, step=10)
    return kept.filter("ok").select("vec_id", "bin")


@query("longest_true_run", "I13", sql("series", ISLANDS.format(flag="v > 30", source="series") + """
SELECT key, s AS start, e AS "end", n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, s) AS rn FROM r WHERE flag)
WHERE rn = 1"""))
def _(t):
    return I.longest_run(t.series().withColumn("flag", F.col("v") > 30), ["key"], "t", "flag")


CLEAN = """
, v AS (SELECT radar, t, gate, z, z IS NOT NULL AS ok FROM grid_cells),
a AS (SELECT *, sum(ch) OVER (PARTITION BY radar, t ORDER BY gate) AS id FROM
      (SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY radar, t ORDER BY gate) IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END AS ch FROM v)),
b AS (SELECT *, sum(ch2) OVER (PARTITION BY radar, gate ORDER BY t) AS id2 FROM
      (SELECT *, CASE WHEN lag(ok) OVER (PARTITION BY radar, gate ORDER BY t) IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END AS ch2 FROM a))
"""


@query("clean_mask", "I14", sql("grid_cells", CLEAN + """
SELECT radar, t, gate, ok AND count(*) OVER (PARTITION BY radar, t, id) >= 3
       AND count(*) OVER (PARTITION BY radar, gate, id2) >= 2 AS clean FROM b"""))
def _(t):
    return I.clean_mask(t.grid_cells(), ["radar"], "t", "gate", "z", 3, 2, SLOT).select("radar", "t", "gate", "clean")


@query("sample_every_step", "I15", sql("steps", """
, g AS (SELECT key, unnest(generate_series(min(t), max(t), 21600000000)) AS t FROM steps GROUP BY 1),
ok AS (SELECT key, t FROM steps WHERE v > 40),
b AS (SELECT g.key, g.t, ok.t AS bt FROM g ASOF LEFT JOIN ok ON g.key = ok.key AND g.t >= ok.t),
f AS (SELECT b.key, b.t, bt, ok.t AS ft FROM b ASOF LEFT JOIN ok ON b.key = ok.key AND b.t <= ok.t),
n AS (SELECT key, t, CASE WHEN bt IS NULL OR ft - t < t - bt THEN ft ELSE bt END AS m FROM f)
SELECT key, m AS matched_t, min(t) AS wanted_t FROM n WHERE m IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    from skycolumn.operators.asof import sample_every
    return sample_every(t.steps(), "t", ["key"], F.col("v") > 40, 6 * HOUR)
