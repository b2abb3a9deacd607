"""Queries of the column functions."""

from pyspark.sql import functions as F

from skycolumn.functions import scalar as S
from skycolumn.operators.ordered import epoch_us
from skycolumn.plans.bindings import r6, sql
from skycolumn.plans.registry import query


@query("decibel_conversion", "F1", """
SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part,
       round(CASE WHEN l_discount > 0 THEN 10 * log10(l_discount) END, 6) AS db,
       round(pow(10.0, l_quantity / 10), 3) AS linear FROM lineitem""")
def _(t):
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                             F.col("l_partkey").alias("part"), r6(S.to_db(F.col("l_discount"))).alias("db"),
                             F.round(S.to_linear(F.col("l_quantity")), 3).alias("linear"))


@query("range_limits_and_clip", "F2 F3 F7", sql("cells", """
SELECT radar, t, range, CASE WHEN z BETWEEN -50 AND -20 THEN z END AS bounded,
       least(greatest(z, -45.0), -30.0) AS clipped,
       (CASE WHEN z BETWEEN -60 AND 0 THEN z END + 60.0) / 60.0 AS unit FROM cells"""))
def _(t):
    z = F.col("z")
    return t.cells().select("radar", "t", "range", S.valid_range(z, -50, -20).alias("bounded"),
                            S.clip(z, -45.0, -30.0).alias("clipped"),
                            S.normalise(z, -60.0, 0.0).alias("unit"))


@query("snr_masking", "F4", sql("cells", """
SELECT radar, t, range, CASE WHEN vel > -1 AND temp > -20 THEN z END AS z,
       z AS z_full FROM cells"""))
def _(t):
    df = t.cells().withColumn("z_full", F.col("z"))
    return S.snr_mask(df.withColumns({"snrh": F.col("vel"), "snrv": F.col("temp") + 19.0}),
                      ["snrh", "snrv"], -1.0, ["z"]).select("radar", "t", "range", "z", "z_full")


@query("gate_filtering", "F5 F6", sql("cells", """
SELECT radar, t, range, z AS z_full, x AS excluded, CASE WHEN NOT x THEN z END AS z,
       CASE WHEN NOT x THEN vel END AS vel
FROM (SELECT *, (z < -50) OR (vel > -0.5 AND vel < 0.5) OR (temp < -40 OR temp > -12) AS x FROM cells)"""))
def _(t):
    rules = {"z": ("below", -50.0), "vel": ("inside", (-0.5, 0.5)), "temp": ("outside", (-40.0, -12.0))}
    df = t.cells().withColumn("excluded", S.gate_filter(rules))
    masked = S.mask_addvars(df, F.col("excluded"), ["z"])
    return (S.mask_remove(masked, F.col("excluded"), ["vel"])
            .select("radar", "t", "range", "z_full", "excluded", "z", "vel"))


@query("angle_corrections", "F8 F22", """
SELECT event_id, CASE WHEN e + 3.5 > 0 THEN e + 3.5 - 180 ELSE e + 3.5 + 180 END AS elevation,
       CASE WHEN a + 200 > 360 THEN a + 200 - 360 ELSE a + 200 END AS azimuth, e IN (90.0, -1000.0) AS zenith
FROM (SELECT event_id, CAST(user_id % 181 AS DOUBLE) - 90.0 AS e,
             CAST(event_id % 360 AS DOUBLE) AS a FROM events)
WHERE e > -200""")
def _(t):
    df = t.events.select("event_id", ((F.col("user_id") % 181).cast("double") - 90.0).alias("e"),
                         (F.col("event_id") % 360).cast("double").alias("a"))
    zenith = F.col("e").isin(90.0, -1000.0)
    return df.select("event_id", S.elevation_correction(F.col("e"), 3.5).alias("elevation"),
                     S.azimuth_correction(F.col("a"), 200.0).alias("azimuth"), zenith.alias("zenith"))


@query("zenith_rows", "F22", """
SELECT event_id, e AS elevation FROM (SELECT event_id, CAST(CASE WHEN user_id % 7 = 0 THEN -1000 ELSE user_id % 97 END AS DOUBLE) AS e FROM events)
WHERE e = 90 OR e = -1000""")
def _(t):
    angle = F.when(F.col("user_id") % 7 == 0, F.lit(-1000)).otherwise(F.col("user_id") % 97).cast("double")
    return S.zenith_only(t.events.select("event_id", angle.alias("elevation")), "elevation")


@query("azimuth_steps", "F9", sql("scans", """
, az AS (SELECT scan, gate, CAST((CAST(floor(price) AS BIGINT) % 360) AS DOUBLE) AS a FROM scans),
d AS (SELECT scan, gate, coalesce(lead(a) OVER w - a, a - lag(a) OVER w) AS s FROM az
      WINDOW w AS (PARTITION BY scan ORDER BY gate))
SELECT scan, gate, step FROM (SELECT scan, gate, abs(s - 360 * CAST(s > 300 AS INT)) AS step FROM d)
WHERE step > 0.25 * 40"""))
def _(t):
    az = t.scans().select("scan", "gate", (F.floor("price") % 360).cast("double").alias("a"))
    return S.angle_step(az, ["scan"], "gate", "a", 40.0).select("scan", "gate", "step")


@query("geopotential_altitude", "F10 F20", """
SELECT l_linenumber AS level, round(avg(6378000.0 * (l_extendedprice / 9.80665)
         / (6378000.0 - l_extendedprice / 9.80665)), 6) AS altitude,
       round(avg(sqrt(l_quantity * l_quantity + l_tax * l_tax)), 6) AS speed,
       round(avg(l_extendedprice / 9.81), 6) AS gph, round(avg(l_discount * 1e5), 6) AS vorticity
FROM lineitem GROUP BY 1""")
def _(t):
    c = F.col
    return t.lineitem.groupBy(c("l_linenumber").alias("level")).agg(
        r6(F.avg(S.geopotential_to_alt(c("l_extendedprice")))).alias("altitude"),
        r6(F.avg(S.wind_speed(c("l_quantity"), c("l_tax")))).alias("speed"),
        r6(F.avg(S.geopotential_height(c("l_extendedprice")))).alias("gph"),
        r6(F.avg(S.vorticity_scaled(c("l_discount")))).alias("vorticity"))


@query("layer_thickness", "F20", sql("scans", """
SELECT scan, round((max(CASE WHEN gate = 5 THEN price END) - max(CASE WHEN gate = 1 THEN price END)) / 9.81, 6)
       AS thickness FROM scans WHERE gate IN (1, 5) GROUP BY 1"""))
def _(t):
    return S.thickness(t.scans(), ["scan"], "gate", "price", 5, 1).select("scan", r6(F.col("thickness")).alias("thickness"))


@query("beam_height", "F11", """
WITH g AS (SELECT s_suppkey AS id, CAST(s_suppkey % 180 AS DOUBLE) - 90 AS lat, abs(s_acctbal) AS r,
                  CAST(s_nationkey * 3 AS DOUBLE) AS elev FROM supplier),
r AS (SELECT *, sqrt((pow(6378137.0::DOUBLE * 6378137.0::DOUBLE * cos(radians(lat)), 2.0)
                      + pow(6356752.3::DOUBLE * 6356752.3::DOUBLE * sin(radians(lat)), 2.0))
                     / (pow(6378137.0::DOUBLE * cos(radians(lat)), 2.0) + pow(6356752.3::DOUBLE * sin(radians(lat)), 2.0))) AS radius FROM g)
SELECT id, round(radius, 3) AS radius,
       round(sqrt(r * r + (radius * (4.0 / 3.0)) * (radius * (4.0 / 3.0))
             + 2.0 * r * (radius * (4.0 / 3.0)) * sin(radians(elev))) - radius * (4.0 / 3.0), 3) AS height FROM r""")
def _(t):
    g = t.supplier.select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 180).cast("double") - 90).alias("lat"),
                          F.abs("s_acctbal").alias("r"), (F.col("s_nationkey") * 3).cast("double").alias("elev"))
    radius = S.earth_radius(F.col("lat"))
    return g.select("id", r6(radius, 3).alias("radius"),
                    r6(S.gate_height(F.col("r"), F.col("elev"), radius), 3).alias("height"))


@query("isotherm_heights_and_types", "F12 F13", """
SELECT event_id, h, round(-(h / 1000.0) * 6.5, 6) AS temperature,
       CASE WHEN h >= 460 AND h <= 1230 THEN 1 WHEN h > 1230 AND h <= 2300 THEN 2
            WHEN h > 2300 AND h <= 3850 THEN 3 END AS zone,
       CASE WHEN CASE WHEN user_id % 5 > 0 THEN h END < 3000 THEN 'orographic' ELSE 'frontal' END AS kind
FROM (SELECT event_id, user_id, value * 20 - 1000 AS h FROM events)""")
def _(t):
    h = S.height_over_iso0(F.col("value") * 20, F.lit(1000))
    top = F.when(F.col("user_id") % 5 > 0, F.col("h"))
    return (t.events.select("event_id", "user_id", h.alias("h"))
            .select("event_id", "h", r6(S.temperature_approx(F.col("h"))).alias("temperature"),
                    S.iso0_zone(F.col("h")).alias("zone"), S.cloud_type(top).alias("kind")))


@query("melting_layer_index", "F16", """
SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part,
       round((least(greatest(l_quantity * 1.5, 10.0), 60.0) - 10.0) / 50.0
             * (1 - (least(greatest(l_discount + 0.6 + l_tax * 4, 0.65), 1.0) - 0.65) / 0.35), 6) AS ml
FROM lineitem""")
def _(t):
    c = F.col
    ml = S.ml_index(c("l_quantity") * 1.5, c("l_discount") + 0.6 + c("l_tax") * 4)
    return t.lineitem.select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"),
                             c("l_partkey").alias("part"), r6(ml).alias("ml"))


@query("nearest_index_and_limits", "F17", sql("scans", """
SELECT scan, arg_min(disc, o) AS nearest, arg_min(gate, o) AS nearest_index,
       bool_or(disc BETWEEN 0.02 AND 0.03) AS any_within
FROM (SELECT *, {'d': abs(disc - 0.05), 'g': gate} AS o FROM scans) GROUP BY 1"""))
def _(t):
    near = S.find_nearest(t.scans(), ["scan"], "disc", 0.05, "gate")
    within = t.scans().groupBy("scan").agg(F.bool_or(S.is_within(F.col("disc"), (0.02, 0.03))).alias("any_within"))
    return near.join(within, "scan")


@query("display_formats", "F19", """
WITH e AS (SELECT event_id, event_type, user_id, value * 700 AS x, CAST(floor(value * 700) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s >= 86400 THEN printf('%dd %dh %dm %ds', s // 86400, (s % 86400) // 3600, (s % 3600) // 60, s % 60)
       WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, (s % 3600) // 60, s % 60)
       WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%.2fs', x) END AS elapsed,
       CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN event_type || ' and ' || CAST(user_id AS VARCHAR)
            ELSE event_type || ', ' || CAST(user_id AS VARCHAR) || ' and last' END AS listed FROM e""")
def _(t):
    parts = F.slice(F.array("event_type", F.col("user_id").cast("string"), F.lit("last")), F.lit(1), (F.col("user_id") % 3 + 1).cast("int"))
    return t.events.select("event_id", S.format_elapsed(F.col("value") * 700).alias("elapsed"), S.format_list(parts).alias("listed"))


@query("clean_text_columns", "F21", """
SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END), '') AS name,
       TRY_CAST(CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE trim(' ' || CAST(c_nationkey AS VARCHAR) || ' ') END AS DOUBLE) AS nation
FROM customer""")
def _(t):
    c = F.col
    raw = t.customer.select(
        "c_custkey", F.when(c("c_custkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("name"),
        F.when(c("c_custkey") % 5 == 0, "n/a")
        .otherwise(F.concat(F.lit(" "), c("c_nationkey").cast("string"), F.lit(" "))).alias("nation"))
    return S.clean_strings(raw, ["nation"])


@query("list_columns", "F23", """
SELECT event_id, list_min(x) AS lo, list_max(x) AS hi, round(list_avg(x), 6) AS mean, CAST(len(x) AS INT) AS n
FROM (SELECT event_id, [value, CAST(user_id AS DOUBLE), CAST(event_id % 100 AS DOUBLE)] AS x FROM events)""")
def _(t):
    text = F.concat(F.lit("["), F.concat_ws(" ", F.col("value").cast("string"), F.col("user_id").cast("string"),
                                            (F.col("event_id") % 100).cast("string")), F.lit("]"))
    df = t.events.select("event_id", S.parse_list(text).alias("x"))
    lo, hi, mean = S.list_min_max_avg(F.col("x"))
    return df.select("event_id", lo.alias("lo"), hi.alias("hi"), r6(mean).alias("mean"), F.size("x").alias("n"))


@query("day_list_with_counts", "F24", """
SELECT CAST(d AS DATE) AS day, count(e.event_id) AS n
FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE)::TIMESTAMP, CAST(max(ts) AS DATE)::TIMESTAMP + INTERVAL 2 DAY,
             INTERVAL 1 DAY)) AS d FROM events) g
LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(g.d AS DATE) GROUP BY 1""")
def _(t):
    days = (t.events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
            .select(F.explode(S.date_sequence(F.col("a"), F.date_add(F.col("b").cast("date"), 2))).alias("day")))
    counts = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("event_id").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("sentinels_to_missing", "S13", """
SELECT event_id, CASE WHEN NOT (abs(x) > 998) AND x <> -99 THEN x END AS x
FROM (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN -999.0 WHEN user_id % 10 = 1 THEN 9999.0
             WHEN user_id % 10 = 2 THEN -99.0 ELSE value END AS x FROM events)""")
def _(t):
    u = F.col("user_id") % 10
    x = (F.when(u == 0, -999.0).when(u == 1, 9999.0).when(u == 2, -99.0)
         .when(u == 3, F.col("value")).otherwise(F.col("value")))
    return t.events.select("event_id", S.missing_to_null(x, 998.0, [-99.0]).alias("x"))


@query("iso0_from_lapse", "F14 R4 W18", sql("grid_cells", """
, z AS (SELECT radar, t, temp - range * -0.0065::DOUBLE AS surface FROM grid_cells WHERE gate = 0),
h AS (SELECT radar, t, surface, surface / 0.0065::DOUBLE AS h, CASE WHEN surface IS NOT NULL THEN t END AS kt FROM z),
n AS (SELECT *, last_value(h IGNORE NULLS) OVER u AS v0, last_value(kt IGNORE NULLS) OVER u AS t0, last_value(h IGNORE NULLS) OVER d AS v1, last_value(kt IGNORE NULLS) OVER d AS t1
      FROM h WINDOW u AS (PARTITION BY radar ORDER BY t), d AS (PARTITION BY radar ORDER BY t DESC))
SELECT radar, t, round(surface, 6) AS surface, round(CASE WHEN h IS NOT NULL THEN h WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
       ELSE v0 + (v1 - v0) * ((t - t0) / CAST(t1 - t0 AS DOUBLE)) END, 4) AS iso0 FROM n"""))
def _(t):
    from skycolumn.operators.windows import interpolate_missing
    surface, zero = S.lapse_iso0(F.col("temp"), F.col("range"), -0.0065)
    h = t.grid_cells().filter("gate = 0").select("radar", "t", surface.alias("surface"), zero.alias("iso0"))
    out = interpolate_missing(h, ["radar"], "t", "iso0")
    return out.select("radar", "t", r6(F.col("surface")).alias("surface"), r6(F.col("iso0"), 4).alias("iso0"))
