"""Queries of statistics, histograms and campaign summaries."""

from pyspark.sql import functions as F

from skycolumn.operators import stats as A
from skycolumn.operators.ordered import DAY, HOUR, epoch_us
from skycolumn.plans.bindings import SLOT, r6, sql
from skycolumn.plans.registry import query

SIX = ["mean", "min", "max", "std", "median", "count"]


def rounded(df, keys, names, digits=6):
    return df.select(*keys, *[F.col(n) if n == "count" else r6(F.col(n), digits).alias(n) for n in names])


STAT_SQL = """round(avg({v}), 6) AS mean, round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(stddev_pop({v}), 6) AS std,
 round(quantile_cont({v}, 0.5), 6) AS median, count({v}) AS count"""


@query("range_statistics", "A1", sql("cells", f"SELECT radar, gate, {STAT_SQL.format(v='z')} FROM cells GROUP BY 1, 2"))
def _(t):
    return rounded(A.range_stats(t.cells(), ["radar"], "gate", "z", SIX), ["radar", "gate"], SIX)


@query("range_statistics_quantised", "A1 A22", f"SELECT l_linenumber AS gate, {STAT_SQL.format(v='l_quantity')} FROM lineitem GROUP BY 1")
def _(t):
    df = t.lineitem.select(F.col("l_linenumber").alias("gate"), "l_quantity")
    return rounded(A.range_stats(df, [], "gate", "l_quantity", SIX, quantised=True), ["gate"], SIX)


@query("statistics_by_peak_number", "A2 G7", sql("cells", """
, p AS (SELECT radar, gate, z, CAST(ceil((CAST(floor(abs(vel * 4)) AS BIGINT) + 1) / 2.0) AS BIGINT) AS no_peaks FROM cells),
g AS (SELECT radar, no_peaks, gate, avg(z) AS mean, max(z) AS max, count(z) AS count FROM p WHERE no_peaks BETWEEN 1 AND 5 GROUP BY 1, 2, 3)
SELECT radar, no_peaks, round(avg(mean), 6) AS mean, round(avg(max), 6) AS max, CAST(sum(count) AS BIGINT) AS count FROM g GROUP BY 1, 2"""))
def _(t):
    c = t.cells().withColumn("peaks", F.floor(F.abs(F.col("vel") * 4)) + 1)
    out = A.stats_by_numpeaks(c, ["radar"], "gate", "peaks", "z", ["mean", "max", "count"], two_sided=True)
    return rounded(out, ["radar", "no_peaks"], ["mean", "max", "count"])


@query("statistics_below_top", "A3", sql("cells", """
, tp AS (SELECT t, max(range) AS top FROM cells WHERE radar = 'view' GROUP BY 1)
SELECT radar, gate, round(avg(z), 6) AS mean, count(z) AS count FROM cells JOIN tp USING (t) WHERE range < top GROUP BY 1, 2"""))
def _(t):
    tops = t.cells().filter("radar = 'view'").groupBy("t").agg(F.max("range").alias("top"))
    below = A.below_top(t.cells(), tops, ["t"], "range", "top")
    return rounded(A.range_stats(below, ["radar"], "gate", "z", ["mean", "count"]), ["radar", "gate"], ["mean", "count"])


@query("series_statistics", "A4", f"SELECT {STAT_SQL.format(v='o_totalprice')} FROM orders".replace(", 6)", ", 3)"))
def _(t):
    return rounded(A.group_stats(t.orders, [], "o_totalprice", SIX), [], SIX, 3)


@query("statistics_of_all_instruments", "A5", sql("cells", """
, u AS (SELECT radar, gate, 'z' AS variable, z AS v FROM cells UNION ALL SELECT radar, gate, 'vel', vel FROM cells),
s AS (SELECT radar, gate, variable, avg(v) AS mean, quantile_cont(v, 0.5) AS median, CAST(count(v) AS DOUBLE) AS count FROM u GROUP BY 1, 2, 3)
SELECT radar, gate, variable, stat, round(value, 6) + 0.0 AS value FROM (UNPIVOT s ON mean, median, count INTO NAME stat VALUE value)"""))
def _(t):
    out = A.multi_stats(t.cells(), ["radar", "gate"], ["z", "vel"], ["mean", "median", "count"])
    return out.select("radar", "gate", "variable", "stat", r6(F.col("value")).alias("value"))


def _campaign_sql() -> str:
    stats = "avg({v}) AS mean, quantile_cont({v}, 0.5) AS median, stddev_pop({v}) AS std, min({v}) AS min, max({v}) AS max, CAST(count({v}) AS DOUBLE) AS count"
    z, m = stats.format(v="z"), stats.format(v="mean")
    return sql("cells", f"""
, c AS (SELECT radar, t, gate, CASE WHEN vel < 1.5 THEN z END AS z FROM cells),
h AS (SELECT radar, t // {12 * HOUR} * {12 * HOUR} AS t, gate, avg(z) AS z FROM c GROUP BY 1, 2, 3 HAVING avg(z) IS NOT NULL),
d AS (SELECT radar, t // {DAY} * {DAY} AS t, gate, avg(z) AS z FROM c GROUP BY 1, 2, 3 HAVING avg(z) IS NOT NULL),
hs AS (SELECT radar, t, {z} FROM h GROUP BY 1, 2),
a AS (SELECT 'per_range' AS tb, radar, CAST(gate AS DOUBLE) AS "at", {z} FROM c GROUP BY 1, 2, 3
      UNION ALL SELECT 'per_time_hourly', radar, CAST(t AS DOUBLE), mean, median, std, min, max, count FROM hs
      UNION ALL SELECT 'per_time_daily', radar, CAST(t AS DOUBLE), {z} FROM d GROUP BY radar, t
      UNION ALL SELECT 'campaign', radar, NULL, {m} FROM hs GROUP BY radar)
SELECT radar, 'z_' || stat || '_' || tb || '_rain' AS name, "at", round(value, 6) AS value
FROM (UNPIVOT a ON mean, median, std, min, max, count INTO NAME stat VALUE value)""")


@query("campaign_statistics", "A6", _campaign_sql())
def _(t):
    tables = A.campaign_stats(t.cells(), ["radar"], "t", "gate", "z", DAY, 12, F.col("vel") < 1.5)
    out = A.campaign_table(tables, ["radar"], "z", "_rain")
    return out.filter(F.col("value").isNotNull()).select("radar", "name", "at", r6(F.col("value")).alias("value"))


@query("cloud_type_summary", "A7 F13", sql("cells", """
, tp AS (SELECT radar, t, max(range) AS top FROM cells GROUP BY 1, 2),
c AS (SELECT radar, t, z, CASE WHEN top < 500 THEN 'orographic' ELSE 'frontal' END AS kind FROM cells JOIN tp USING (radar, t) WHERE range <= top),
m AS (SELECT radar, t, kind, z, avg(z) OVER (PARTITION BY radar, t) AS mu FROM c),
p AS (SELECT radar, kind, t, max(z) AS max, avg(z) AS mean, quantile_cont(z, 0.5) AS median, min(z) AS min, stddev_pop(z) AS std, quantile_cont(z, 0.25) AS q25,
      quantile_cont(z, 0.75) AS q75, count(z) AS count, CASE WHEN stddev_pop(z) > 0 THEN avg(pow(z - mu, 3)) / pow(avg(pow(z - mu, 2)), 1.5) END AS skew FROM m GROUP BY 1, 2, 3)
SELECT radar, kind, round(avg(max), 6) AS max, round(avg(mean), 6) AS mean, round(avg(median), 6) AS median, round(avg(min), 6) AS min, round(avg(std), 6) AS std,
       round(avg(q25), 6) AS q25, round(avg(q75), 6) AS q75, round(avg(q75 - q25), 6) AS iqr, round(avg(skew), 6) AS skew, CAST(sum(count) AS BIGINT) AS count
FROM p GROUP BY 1, 2"""))
def _(t):
    from skycolumn.functions.scalar import cloud_type
    tops = t.cells().groupBy("radar", "t").agg(F.max("range").alias("top"))
    c = t.cells().join(tops, ["radar", "t"]).filter("range <= top").withColumn("kind", cloud_type(F.col("top"), 500.0))
    out = A.cloudtype_summary(c, ["radar", "kind"], "t", "z")
    return rounded(out, ["radar", "kind"], [x for x in out.columns if x not in ("radar", "kind")])


@query("daily_and_monthly_statistics", "A8", """
WITH p AS (SELECT event_type AS key, 'day' AS period, date_trunc('day', ts) AS start, value FROM events
           UNION ALL SELECT event_type, 'month', date_trunc('month', ts), value FROM events),
s AS (SELECT key, period, CAST(start AS TIMESTAMP) AS start, min(value) AS min, max(value) AS max, avg(value) AS mean FROM p GROUP BY 1, 2, 3)
SELECT key, period, epoch_us(start) AS start, statistic, round(value, 6) AS value FROM (UNPIVOT s ON min, max, mean INTO NAME statistic VALUE value)""")
def _(t):
    out = A.daily_monthly_stats(t.events.withColumnRenamed("event_type", "key"), ["key"], "ts", "value")
    return out.select("key", "period", epoch_us(F.col("start")).alias("start"), "statistic", r6(F.col("value")).alias("value"))


HIST = """
, b AS (SELECT radar, range, z, CAST(least(floor((range - 0) / 60.0), 9) AS INT) AS ix, CAST(least(floor((z + 60) / 2.5), 15) AS INT) AS iy
        FROM cells WHERE range BETWEEN 0 AND 600 AND z BETWEEN -60 AND -20)"""
BINS, LIMITS = (10, 16), ((0.0, 600.0), (-60.0, -20.0))


@query("joint_histogram", "A12", sql("cells", HIST + """
SELECT radar, ix, iy, count(*) AS n FROM b GROUP BY 1, 2, 3"""))
def _(t):
    return A.hist2d(t.cells(), ["radar"], "range", "z", BINS, LIMITS)


@query("joint_histogram_weighted", "A12", sql("cells", HIST + """
, k AS (SELECT radar, count(*) AS total FROM cells GROUP BY 1)
SELECT ix, iy, round(sum(1.0::DOUBLE / total), 9) AS n FROM b JOIN k USING (radar) GROUP BY 1, 2"""))
def _(t):
    totals = t.cells().groupBy("radar").agg(F.count(F.lit(1)).alias("total"))
    df = t.cells().join(totals, "radar")
    return A.hist2d(df, [], "range", "z", BINS, LIMITS, 1 / F.col("total")).withColumn("n", r6(F.col("n"), 9))


@query("height_frequency_diagram", "A13", sql("cells", HIST + """
SELECT 0 + (ix + 0.5) * 60.0 AS range, -60 + (iy + 0.5) * 2.5 AS z, count(*) AS n FROM b GROUP BY ix, iy""").replace("0 + (ix + 0.5) * 60.0", "CAST(0 + (ix + 0.5) * 60.0 AS DOUBLE)").replace("-60 + (iy + 0.5) * 2.5", "CAST(-60 + (iy + 0.5) * 2.5 AS DOUBLE)"))
def _(t):
    c = t.cells()
    parts = [A.cfad(c.filter(test), [], "range", "z", BINS, LIMITS) for test in ("vel < 0", "vel >= 0")]
    return A.combine_counts(parts, ["range", "z"])


@query("joint_density_percent", "A14", sql("cells", HIST + """
, n AS (SELECT radar, ix, iy, count(*) AS n FROM b GROUP BY 1, 2, 3), k AS (SELECT radar, count(*) AS total FROM b GROUP BY 1)
SELECT radar, ix, iy, n, round(n / (total * (60.0 * 2.5)) * 100, 6) AS percent FROM n JOIN k USING (radar) WHERE n / (total * (60.0 * 2.5)) * 100 >= 0.001"""))
def _(t):
    out = A.hist2d_percent(t.cells(), ["radar"], "range", "z", BINS, LIMITS, 0.001)
    return out.select("radar", "ix", "iy", "n", r6(F.col("percent")).alias("percent"))


@query("histogram_bin_number", "A15", """
WITH s AS (SELECT event_type AS key, count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1),
h AS (SELECT l_returnflag AS key, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr,
      min(l_tax) AS lo2, max(l_tax) AS hi2, quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25) AS iqr2 FROM lineitem GROUP BY 1)
SELECT key, 'fd' AS rule, CAST(CASE WHEN iqr = 0 THEN 50 ELSE greatest(10, least(ceil((hi - lo) / (2 * iqr / pow(n, 1 / 3.0::DOUBLE))), 200)) END AS INT) AS size FROM s
UNION ALL SELECT key, 'hex', CAST(greatest(10, floor(sqrt(ceil((hi - lo) / (2 * iqr / pow(n, 1 / 3.0::DOUBLE))) * ceil((hi2 - lo2) / (2 * iqr2 / pow(n, 1 / 3.0::DOUBLE)))))) AS INT) FROM h""")
def _(t):
    fd = A.fd_bins(t.events.withColumnRenamed("event_type", "key"), ["key"], "value")
    hexes = A.hex_grid_size(t.lineitem.withColumnRenamed("l_returnflag", "key"), ["key"], "l_quantity", "l_tax", quantised=True)
    return (fd.select("key", F.lit("fd").alias("rule"), F.col("bins").alias("size"))
            .union(hexes.select("key", F.lit("hex").alias("rule"), F.col("gridsize").alias("size"))))


@query("binned_height_profile", "A16", sql("cells", """
SELECT radar, floor((range - 100 + 500) / 100.0) * 100 - 500 AS bottom, round(avg(z), 6) AS z, count(*) AS n
FROM cells WHERE range - 100 >= -500 AND range - 100 < 4900 GROUP BY 1, 2 HAVING count(*) > 10"""))
def _(t):
    c = t.cells().withColumn("h", F.col("range") - 100)
    out = A.binned_profile(c, ["radar"], "h", "z")
    return out.select("radar", F.col("bottom").cast("double").alias("bottom"), r6(F.col("z")).alias("z"), "n")


@query("cloud_class_contrast", "A17 F12", sql("cells", """
, c AS (SELECT radar, range * 6 - 400 AS h, CASE WHEN temp < -10 THEN temp * -100 END AS top, CAST(floor(abs(vel)) AS INT) AS peaks, vel / 100 AS g FROM cells),
k AS (SELECT *, CASE WHEN top < 3000 THEN 'orographic' ELSE 'frontal' END AS cloud_type,
      CASE WHEN h >= 460 AND h <= 1230 THEN 1 WHEN h > 1230 AND h <= 2300 THEN 2 WHEN h > 2300 AND h <= 3850 THEN 3 END AS zone FROM c)
SELECT radar, cloud_type, zone, count(peaks) AS n, round(count(*) FILTER (WHERE peaks > 1) / CAST(count(peaks) AS DOUBLE), 6) AS multi,
       round(avg(g) * 1000, 6) + 0.0 AS gradient_per_km FROM k WHERE zone IS NOT NULL GROUP BY 1, 2, 3"""))
def _(t):
    c = t.cells().select("radar", (F.col("range") * 6 - 400).alias("h"), F.when(F.col("temp") < -10, F.col("temp") * -100).alias("top"),
                         F.floor(F.abs("vel")).cast("int").alias("peaks"), (F.col("vel") / 100).alias("g"))
    out = A.class_contrast(c, ["radar"], "h", "top", "peaks", "g")
    return out.select("radar", "cloud_type", "zone", "n", r6(F.col("multi")).alias("multi"), r6(F.col("gradient_per_km")).alias("gradient_per_km"))


@query("class_ratio_distribution", "A17", sql("cells", """
, k AS (SELECT radar, CASE WHEN temp >= -10 THEN NULL WHEN temp * -100 < 3000 THEN 'orographic' ELSE 'frontal' END AS cloud_type,
   CASE WHEN range * 6 - 400 >= 460 AND range * 6 - 400 <= 1230 THEN 1 WHEN range * 6 - 400 > 1230 AND range * 6 - 400 <= 2300 THEN 2
        WHEN range * 6 - 400 > 2300 AND range * 6 - 400 <= 3850 THEN 3 END AS zone, vel FROM cells),
b AS (SELECT radar, zone, cloud_type, CAST(least(floor((vel + 3) / 0.25), 23) AS INT) AS bin FROM k WHERE zone IS NOT NULL AND cloud_type IS NOT NULL AND vel BETWEEN -3 AND 3)
SELECT radar, zone, cloud_type, bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY radar, zone, cloud_type) AS DOUBLE), 6) AS share FROM b GROUP BY 1, 2, 3, 4"""))
def _(t):
    top = F.when(F.col("temp") < -10, F.col("temp") * -100)
    c = t.cells().select("radar", A.iso0_zone(F.col("range") * 6 - 400).alias("zone"), F.when(top.isNotNull(), A.cloud_type(top)).alias("cloud_type"), "vel")
    out = A.class_distribution(c, ["radar"], "zone", "cloud_type", "vel", 24, (-3.0, 3.0))
    return out.select("radar", "zone", "cloud_type", "bin", "n", r6(F.col("share")).alias("share"))


@query("density_by_temperature_band", "A18", sql("cells", """
, c AS (SELECT CASE WHEN temp >= -40 AND temp < -30 THEN 0 WHEN temp >= -30 AND temp < -20 THEN 1 WHEN temp >= -20 AND temp < 0 THEN 2 END AS band, z, vel FROM cells),
e AS (SELECT band, min(z) AS x0, max(z) AS x1, min(vel) AS y0, max(vel) AS y1 FROM c WHERE band IS NOT NULL GROUP BY 1)
SELECT band, CAST(least(floor((z - x0) / ((x1 - x0) / 20)), 19) AS INT) AS ix, CAST(least(floor((vel - y0) / ((y1 - y0) / 20)), 19) AS INT) AS iy, count(*) AS n
FROM c JOIN e USING (band) GROUP BY 1, 2, 3"""))
def _(t):
    band = A.temperature_bins(F.col("temp"), [-40.0, -30.0, -20.0, 0.0])
    c = t.cells().select(band.alias("band"), "z", "vel").filter(F.col("band").isNotNull())
    return A.stratified_density(c, ["band"], "z", "vel", 20)


@query("hex_density", "A15 A18", sql("cells", """
, e AS (SELECT radar, min(z) AS x0, max(z) AS x1, min(vel) AS y0, max(vel) AS y1 FROM cells WHERE z IS NOT NULL AND vel IS NOT NULL GROUP BY 1),
s AS (SELECT radar, x0, x1, y0, y1, CASE WHEN x0 = x1 THEN 0.0 ELSE (z - x0) / (x1 - x0) * 20.0::DOUBLE END AS u,
      CASE WHEN y0 = y1 THEN 0.0 ELSE (vel - y0) / (y1 - y0) * 11.0::DOUBLE END AS w FROM cells JOIN e USING (radar) WHERE z IS NOT NULL AND vel IS NOT NULL),
c AS (SELECT *, floor(u + 0.5) AS i1, floor(w + 0.5) AS j1, floor(u) + 0.5 AS i2, floor(w) + 0.5 AS j2 FROM s),
k AS (SELECT *, (u - i1) * (u - i1) + 3 * ((w - j1) * (w - j1)) < (u - i2) * (u - i2) + 3 * ((w - j2) * (w - j2)) AS one FROM c)
SELECT radar, round(x0 + (CASE WHEN one THEN i1 ELSE i2 END) / 20.0::DOUBLE * (x1 - x0), 6) AS x, round(y0 + (CASE WHEN one THEN j1 ELSE j2 END) / 11.0::DOUBLE * (y1 - y0), 6) AS y,
       count(*) AS n FROM k GROUP BY ALL"""))
def _(t):
    out = A.hex_bins(t.cells(), ["radar"], "z", "vel", 20)
    return out.select("radar", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "n")


@query("sketched_monthly_quantiles", "A1 A8", sql("cells", """
SELECT radar, epoch_us(date_trunc('month', make_timestamp(t))) AS month, count(*) AS n, round(min(z), 6) AS low, round(max(z), 6) AS high, true AS within
FROM cells GROUP BY 1, 2"""))
def _(t):
    """Daily sketches per gate, merged over gates and days of a month; ``within``: all quantiles keep the bound against the exact ranks."""
    from skycolumn.operators import sketches as S
    from skycolumn.operators.ordered import from_epoch_us
    month = lambda c: epoch_us(F.date_trunc("month", from_epoch_us(F.col(c))).cast("timestamp_ntz"))
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}
    daily = S.period_sketches(t.cells(), ["radar", "gate"], "t", "z", DAY)
    monthly = S.sketch_quantiles(S.merge_sketches(daily.withColumn("month", month("t")), ["radar", "month"]), probs)
    errors = S.rank_errors(t.cells().withColumn("month", month("t")), monthly, ["radar", "month"], "z", probs)
    within = F.greatest(*probs) <= 2 * S.rank_error()
    return (monthly.select("radar", "month", "n", r6(F.col("min")).alias("low"), r6(F.col("max")).alias("high"))
            .join(errors.select("radar", "month", within.alias("within")), ["radar", "month"]))


@query("outlier_shares", "A19", """
SELECT event_type AS key, count(z) AS valid, round(count(*) FILTER (WHERE z > 20) / CAST(count(z) AS DOUBLE) * 100, 6) AS high_percent,
       round(count(*) FILTER (WHERE z < -20 AND r > 3000 AND r > 100 * z + 5000) / CAST(count(z) AS DOUBLE) * 100, 6) AS low_percent
FROM (SELECT event_type, value - 60 AS z, CAST(user_id * 60 AS DOUBLE) AS r FROM events) GROUP BY 1""")
def _(t):
    c = t.events.select(F.col("event_type").alias("key"), (F.col("value") - 60).alias("z"), (F.col("user_id") * 60).cast("double").alias("r"))
    out = A.outlier_share(c, ["key"], "z", "r")
    return out.select("key", "valid", r6(F.col("high_percent")).alias("high_percent"), r6(F.col("low_percent")).alias("low_percent"))


@query("flagged_hours", "A20", sql("grid_cells", """
, f AS (SELECT radar, t, coalesce(bool_or(z > -40), false) AS strong, coalesce(bool_or(vel < -2), false) AS falling FROM grid_cells GROUP BY 1, 2)
SELECT radar, CAST(count(*) FILTER (WHERE strong) * 6.0 AS DOUBLE) AS strong_hours, CAST(count(*) FILTER (WHERE falling) * 6.0 AS DOUBLE) AS falling_hours FROM f GROUP BY 1"""))
def _(t):
    flags = t.grid_cells().groupBy("radar", "t").agg(F.coalesce(F.bool_or(F.col("z") > -40), F.lit(False)).alias("strong"),
                                                     F.coalesce(F.bool_or(F.col("vel") < -2), F.lit(False)).alias("falling"))
    return A.flag_hours(flags, ["radar"], ["strong", "falling"], SLOT / HOUR)


@query("ratio_daily_summary", "A25 F23", """
WITH r AS (SELECT event_id, epoch_us(date_trunc('day', ts)) AS day, value AS dfr, [value, CAST(user_id AS DOUBLE), CAST(event_id % 50 AS DOUBLE)] AS x FROM events),
d AS (SELECT day, avg(dfr) AS m FROM r GROUP BY 1)
SELECT event_id, list_min(x) AS top_min, list_max(x) AS top_max, round(list_avg(x), 6) AS top_avg, round(m, 6) AS daily_mean_DFR FROM r JOIN d USING (day)""")
def _(t):
    rows = t.events.select("event_id", (F.floor(epoch_us(F.col("ts")) / DAY) * DAY).alias("day"), F.col("value").alias("dfr"),
                           F.array("value", F.col("user_id").cast("double"), (F.col("event_id") % 50).cast("double")).alias("x"))
    out = A.dfr_daily_summary(rows, "day", "x", "dfr")
    return out.select("event_id", "top_min", "top_max", r6(F.col("top_avg")).alias("top_avg"), r6(F.col("daily_mean_DFR")).alias("daily_mean_DFR"))


@query("attenuation_extremes", "A27", sql("scans", """
, k AS (SELECT scan % 3 AS freq, gate, disc FROM scans), n AS (SELECT freq, arg_min(gate, {'d': abs(gate - 5.4), 'g': gate}) AS gate FROM k GROUP BY 1)
SELECT freq, min(disc) AS min, max(disc) AS max FROM k JOIN n USING (freq, gate) GROUP BY 1"""))
def _(t):
    k = t.scans().select((F.col("scan") % 3).alias("freq"), "gate", "disc")
    return A.attenuation_summary(k, ["freq"], "gate", "disc", 5.4)


@query("normalised_distributions", "A27", """
WITH b AS (SELECT event_type AS key, CAST(least(floor(value / 12.5), 39) AS INT) AS bin FROM events WHERE value BETWEEN 0 AND 500), k AS (SELECT key, count(*) AS n FROM b GROUP BY 1)
SELECT key, bin, round(count(*) / CAST(max(n) AS DOUBLE), 9) AS share FROM b JOIN k USING (key) GROUP BY 1, 2""")
def _(t):
    out = A.normalised_hist(t.events.withColumnRenamed("event_type", "key"), ["key"], "value", 40, (0.0, 500.0))
    return out.select("key", "bin", r6(F.col("share"), 9).alias("share"))


@query("sounding_bias", "A28 R3", sql("scans", """
, a AS (SELECT scan, gate * 30.0::DOUBLE AS alt, qty AS v FROM scans), b AS (SELECT scan, gate * 35.0::DOUBLE AS alt, qty + disc AS v FROM scans),
an AS (SELECT *, lead(alt) OVER w AS a1, lead(v) OVER w AS v1 FROM a WINDOW w AS (PARTITION BY scan ORDER BY alt)),
bn AS (SELECT *, lead(alt) OVER w AS a1, lead(v) OVER w AS v1 FROM b WINDOW w AS (PARTITION BY scan ORDER BY alt)),
g AS (SELECT CAST(25 * unnest(generate_series(1, 10)) AS DOUBLE) AS h),
x AS (SELECT scan, h, CASE WHEN h = alt THEN v ELSE v + (v1 - v) * ((h - alt) / (a1 - alt)) END AS v FROM an, g WHERE h >= alt AND (h < a1 OR h = alt)),
y AS (SELECT scan, h, CASE WHEN h = alt THEN v ELSE v + (v1 - v) * ((h - alt) / (a1 - alt)) END AS v FROM bn, g WHERE h >= alt AND (h < a1 OR h = alt))
SELECT h AS alt, round(avg(x.v - y.v), 6) AS bias, round(stddev_pop(x.v - y.v), 6) AS std, count(x.v - y.v) AS n FROM x JOIN y USING (scan, h) GROUP BY 1"""))
def _(t):
    s = t.scans()
    a = s.select("scan", (F.col("gate") * 30.0).alias("alt"), F.col("qty").alias("v"))
    b = s.select("scan", (F.col("gate") * 35.0).alias("alt"), (F.col("qty") + F.col("disc")).alias("v"))
    out = A.sounding_bias(a, b, "scan", "alt", "v")
    return out.select("alt", r6(F.col("bias")).alias("bias"), r6(F.col("std")).alias("std"), "n")


@query("variogram", "A24 B6 J12", sql("series", """
, q AS (SELECT key, t // 600000000 AS t, v FROM series),
p AS (SELECT a.key, CAST(b.t - a.t AS DOUBLE) AS lag, (b.v - a.v) * (b.v - a.v) AS d FROM q a JOIN q b ON a.key = b.key AND b.t > a.t AND b.t - a.t <= 60),
e AS (SELECT *, min(lag) OVER (PARTITION BY key) AS lo, max(lag) OVER (PARTITION BY key) AS hi FROM p),
b AS (SELECT key, CAST(floor((lag - lo) / ((hi - lo) / 13)) AS INT) AS bin, lag, d FROM e)
SELECT key, bin, round(avg(lag), 6) AS lag, round(avg(d) / 2, 3) AS gamma, count(*) AS pairs FROM b WHERE bin < 13 GROUP BY 1, 2"""))
def _(t):
    s = t.series().withColumn("t", F.floor(F.col("t") / 600_000_000))
    out = A.variogram(s, ["key"], "t", "v", 13, 60)
    return out.select("key", "bin", r6(F.col("lag")).alias("lag"), r6(F.col("gamma"), 3).alias("gamma"), "pairs")
