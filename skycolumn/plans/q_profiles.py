"""Queries of layer tops, bases, levels and artefacts."""

from pyspark.sql import functions as F

from skycolumn.operators import profiles as P
from skycolumn.plans.bindings import r6, sql
from skycolumn.plans.registry import query

PROFILE = ["radar", "t"]


def merged(t):
    """All instruments on one grid: the fullest profiles the events give."""
    return t.cells().groupBy("t", "gate", "range").agg(F.max("z").alias("z")).withColumn("radar", F.lit("all"))


def valid():
    return F.col("z") > -48

RUNS = """
, v AS (SELECT radar, t, gate, range FROM {src} WHERE z > -48),
i AS (SELECT *, gate - lag(gate) OVER (PARTITION BY radar, t ORDER BY gate) - 1 AS gap FROM v),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY radar, t ORDER BY gate) AS id FROM i),
r AS (SELECT radar, t, id, min(gate) AS a, max(gate) AS b, count(*) AS n, min(range) AS bottom, max(range) AS top FROM g GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT radar, t FROM {src})"""
MERGED = """
, m AS (SELECT 'all' AS radar, t, gate, range, max(z) AS z FROM cells GROUP BY 2, 3, 4)"""


@query("cloudtop_and_base", "P1 P5", sql("cells", RUNS.format(src="cells", gap=0) + """
SELECT p.radar, p.t, max(top) FILTER (WHERE n >= 4) AS cloudtop, min(bottom) FILTER (WHERE n >= 4) AS cloudbase
FROM p LEFT JOIN r USING (radar, t) GROUP BY 1, 2"""))
def _(t):
    c = t.cells()
    top = P.cloudtop_generic(c, PROFILE, "gate", "range", valid(), 4)
    return top.join(P.cloudbase(c, PROFILE, "gate", "range", valid(), 4), PROFILE)


@query("cloudtop_layer", "P2 P6", sql("cells", RUNS.format(src="cells", gap=0) + """,
k AS (SELECT radar, t, max(b) FILTER (WHERE n >= 5) - 1 AS hi FROM r GROUP BY 1, 2)
SELECT c.radar, c.t, c.gate, c.z, coalesce(c.gate BETWEEN hi - 2 AND hi, false) AS in_layer FROM cells c LEFT JOIN k USING (radar, t)"""))
def _(t):
    c = t.cells()
    layer = P.cloudtop_depth(c, PROFILE, "gate", valid(), 5, 3, 1)
    return P.layer_mask(c, layer, PROFILE, "gate", "from_gate", "to_gate").select("radar", "t", "gate", "z", "in_layer")


@query("cloudtop_connected", "P3 P5", sql("cells", MERGED + RUNS.format(src="m", gap=2) + """,
x AS (SELECT radar, t, min(a) AS a, arg_min(top, a) AS top, arg_min(b, a) AS b FROM r GROUP BY 1, 2),
q AS (SELECT radar, t, gate, range, sum(CASE WHEN gap IS NULL OR gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY radar, t ORDER BY gate) AS id FROM i),
ct AS (SELECT radar, t, max(top) AS cloudtop FROM (SELECT radar, t, id, max(range) AS top FROM q GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1, 2)
SELECT p.t, ct.cloudtop, CASE WHEN x.a < 3 AND x.b > 0 AND ct.cloudtop IS NOT NULL THEN least(ct.cloudtop, x.top) END AS continuous
FROM p LEFT JOIN ct USING (radar, t) LEFT JOIN x USING (radar, t)"""))
def _(t):
    c = merged(t)
    tops = P.cloudtop(c, PROFILE, "gate", "range", valid(), 3)
    return P.cloudtop_continuous(c, tops, PROFILE, "gate", "range", valid(), 3).select("t", "cloudtop", "continuous")


@query("cloudbase_connected", "P4", sql("cells", MERGED + RUNS.format(src="m", gap=0) + """,
cb AS (SELECT radar, t, min(bottom) + 100 AS base FROM r GROUP BY 1, 2),
w AS (SELECT a.radar, a.t, a.range FROM m a JOIN r USING (radar, t) JOIN cb USING (radar, t) WHERE r.n >= 3 AND a.gate BETWEEN r.a AND r.b - 2 AND a.range >= base)
SELECT p.t, min(w.range) AS continuous FROM p LEFT JOIN w USING (radar, t) GROUP BY 1"""))
def _(t):
    c = merged(t)
    base = P.cloudbase(c, PROFILE, "gate", "range", valid(), 1).withColumn("cloudbase", F.col("cloudbase") + 100)
    return P.cloudbase_continuous(c, base, PROFILE, "gate", "range", valid(), 3).select("t", "continuous")


LEVELS = """
, lev AS (SELECT scan, gate, qty - 25 AS temp, gate * 500.0::DOUBLE + disc * 100 AS alt FROM scans)"""


def levels(t):
    return t.scans().select("scan", "gate", (F.col("qty") - 25).alias("temp"),
                            (F.col("gate") * 500.0 + F.col("disc") * 100).alias("alt"))


@query("isotherm_heights", "P7", sql("scans", LEVELS + """,
b AS (SELECT *, lead(temp) OVER w AS t1, lead(alt) OVER w AS a1 FROM lev WINDOW w AS (PARTITION BY scan ORDER BY temp, alt)),
h AS (SELECT scan, arg_min(CASE WHEN t1 = temp THEN alt ELSE alt + (a1 - alt) * (0 - temp) / (t1 - temp) END - 100, {'t': temp, 'a': alt}) AS iso
      FROM b WHERE temp <= 0 AND t1 >= 0 GROUP BY 1)
SELECT s.scan, round(h.iso, 6) AS isotherm FROM (SELECT DISTINCT scan FROM lev) s LEFT JOIN h USING (scan)"""))
def _(t):
    return P.isotherm_linear(levels(t), ["scan"], "temp", "alt", 0.0, 100.0).select("scan", r6(F.col("isotherm")).alias("isotherm"))


@query("isotherm_nearest_level", "P8", sql("scans", LEVELS + """,
h AS (SELECT scan, arg_min(alt, {'d': abs(temp), 'a': alt}) AS iso FROM lev WHERE alt BETWEEN 500 AND 2600 AND abs(temp) < 2 GROUP BY 1)
SELECT s.scan, h.iso - 100 AS isotherm FROM (SELECT DISTINCT scan FROM lev) s LEFT JOIN h USING (scan)"""))
def _(t):
    return P.isotherm_nearest(levels(t), ["scan"], "temp", "alt", 0.0, (500.0, 2600.0), station=100.0)


@query("layer_mean_temperature", "P9", sql("scans", LEVELS + """
SELECT scan, round(avg(temp) FILTER (WHERE alt BETWEEN 400 AND 1600), 6) AS mean_temp FROM lev GROUP BY 1"""))
def _(t):
    out = P.layer_mean(levels(t), ["scan"], "alt", 400.0, 1600.0, "temp")
    return out.select("scan", r6(F.col("mean_temp")).alias("mean_temp"))


@query("mode_artefacts", "P11", sql("cells ring", """
, n AS (SELECT before AS radar, t, gate, z FROM cells JOIN ring ON ring.key = cells.radar)
SELECT a.radar, a.t, a.gate, abs(coalesce(b.z, 999) - coalesce(a.z, 999)) > 10 AS strict,
       abs(coalesce(b.z, 999) - coalesce(a.z, 999)) > 10 AND (a.range BETWEEN 0 AND 200 OR a.range BETWEEN 400 AND 500) AS loose
FROM cells a LEFT JOIN n b ON b.radar = a.radar AND a.t = b.t AND a.gate = b.gate"""))
def _(t):
    fine = t.cells()
    coarse, on = t.under_previous(fine, "radar"), ["radar", "t", "gate"]
    strict = P.artefact_mask(fine, coarse, on, "z", "range").withColumnRenamed("artefact", "strict")
    loose = P.artefact_mask(strict, coarse, on, "z", "range", [(0.0, 200.0), (400.0, 500.0)])
    return loose.select("radar", "t", "gate", "strict", F.col("artefact").alias("loose"))


FIELD = """
, fld AS (SELECT scan % 50 AS t, gate AS level, CAST(scan // 50 % 12 AS DOUBLE) / 4 + 40 AS lat, CAST(scan // 600 % 10 AS DOUBLE) / 4 + 20 AS lon,
                 max(price) AS z, avg(qty) AS temp FROM scans GROUP BY 1, 2, 3, 4)"""


def field(t):
    s = t.scans()
    whole = lambda c, n: F.floor(F.col(c) / n)
    return s.groupBy((F.col("scan") % 50).alias("t"), F.col("gate").alias("level"),
                     ((whole("scan", 50) % 12).cast("double") / 4 + 40).alias("lat"),
                     ((whole("scan", 600) % 10).cast("double") / 4 + 20).alias("lon")).agg(
        F.max("price").alias("z"), F.avg("qty").alias("temp"))


@query("domain_mean_levels", "P14 F10", sql("scans", FIELD + """
SELECT t, level, round(avg(temp), 6) AS temp, count(*) AS n FROM fld WHERE lat BETWEEN 40.5 AND 41.5 AND lon BETWEEN 20.25 AND 21.75 GROUP BY 1, 2"""))
def _(t):
    box = P.domain_box(field(t), (40.5, 41.5), (20.25, 21.75))
    return box.groupBy("t", "level").agg(r6(F.avg("temp")).alias("temp"), F.count(F.lit(1)).alias("n"))


@query("nearest_grid_point", "P14 F17", sql("scans", FIELD + """,
b AS (SELECT t, level, arg_min({'lat': lat, 'lon': lon}, {'d': (lat - 41.1) * (lat - 41.1) + (lon - 20.6) * (lon - 20.6), 'a': lat, 'o': lon}) AS p FROM fld GROUP BY 1, 2)
SELECT fld.t, fld.level, lat, lon, z FROM fld JOIN b ON b.t = fld.t AND b.level = fld.level AND lat = p.lat AND lon = p.lon"""))
def _(t):
    return P.nearest_point(field(t), ["t", "level"], 41.1, 20.6).select("t", "level", "lat", "lon", "z")


@query("latitude_cross_section", "P13", sql("scans", FIELD + """,
s AS (SELECT t, level, lon, lat, z, temp FROM fld WHERE level BETWEEN 2 AND 6 QUALIFY dense_rank() OVER (ORDER BY abs(lat - 41.1), lat) = 1),
h AS (SELECT t, lon, level, level * 400 + (avg(z) OVER (PARTITION BY level)) / 1e4 AS height, temp FROM s),
n AS (SELECT *, lead(height) OVER w AS h1, lead(temp) OVER w AS t1 FROM h WINDOW w AS (PARTITION BY t, lon ORDER BY height))
SELECT t, lon, g AS height, round(temp + (t1 - temp) * ((g - height) / (h1 - height)), 6) AS temp
FROM n, (SELECT CAST(250 * unnest(generate_series(1, 12)) AS DOUBLE) AS g) WHERE g >= height AND g < h1"""))
def _(t):
    from skycolumn.operators.levels import cross_section
    f = field(t).filter(F.col("level").between(2, 6))
    out = cross_section(f, ["t"], "level", "lat", 41.1, "lon", F.col("level") * 400 + F.col("mean_z") / 1e4, "z", ["temp"], 250.0)
    return out.select("t", "lon", "height", r6(F.col("temp")).alias("temp"))


@query("profile_arrays", "S14", sql("cells", """
SELECT radar, t, CAST(count(*) AS INT) AS gates, max(z) AS top, arg_max(z, range) AS z_last FROM cells GROUP BY 1, 2"""))
def _(t):
    p = P.to_profiles(t.cells(), ["radar"], "t", "range", ["z"])
    return p.select("radar", "t", F.size("z").alias("gates"), F.array_max("z").alias("top"), F.element_at("z", -1).alias("z_last"))
