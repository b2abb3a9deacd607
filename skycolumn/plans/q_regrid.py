"""Queries of grids and regridding."""

from pyspark.sql import functions as F

from skycolumn.operators import regrid as R
from skycolumn.operators.ordered import DAY, HOUR, MINUTE, SECOND, floor_div
from skycolumn.plans.bindings import GATES, SLOT, STEP, r6, sql
from skycolumn.plans.registry import query

GRID = f"""
, grid AS (SELECT key, unnest(generate_series(lo, hi, {STEP})) AS t FROM
          (SELECT key, min(t) // {STEP} * {STEP} AS lo, max(t) // {STEP} * {STEP} AS hi FROM series GROUP BY 1))"""


def time_grid(t):
    bounds = t.series().groupBy("key").agg((floor_div(F.min("t"), STEP) * STEP).alias("a"), (floor_div(F.max("t"), STEP) * STEP).alias("b"))
    return R.make_time_grid(bounds, "t", "a", "b", STEP)


@query("empty_grid", "S10", sql("cells", f"""
SELECT radar, t, CAST(25 + 25 * i AS DOUBLE) AS range FROM (SELECT radar, unnest(generate_series(min(t), max(t), {SLOT})) AS t FROM cells GROUP BY 1),
(SELECT unnest(generate_series(0, 23)) AS i)"""))
def _(t):
    bounds = t.cells().groupBy("radar").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return R.make_grid(bounds, "t", "a", "b", SLOT, "range", 25.0, 25.0, GATES)


NEAR = GRID + """,
b AS (SELECT g.key, g.t, s.t AS bt, s.v AS bv FROM grid g ASOF LEFT JOIN series s ON g.key = s.key AND g.t >= s.t),
f AS (SELECT b.*, s.t AS ft, s.v AS fv FROM b ASOF LEFT JOIN series s ON b.key = s.key AND b.t <= s.t),
n AS (SELECT key, t, CASE WHEN bt IS NULL OR ft - t <= t - bt THEN ft ELSE bt END AS m, CASE WHEN bt IS NULL OR ft - t <= t - bt THEN fv ELSE bv END AS v FROM f)
"""


@query("align_to_grid", "J3", sql("series", NEAR + """
SELECT key, t, CASE WHEN abs(m - t) <= 306000000 THEN v END AS v FROM n"""))
def _(t):
    return R.align_to_grid(t.series(), time_grid(t), ["key"], "t", ["v"], STEP)


@query("regrid_nearest_time", "J4", sql("series", NEAR.replace("(lo, hi,", f"(lo, hi + {STEP},") + """
SELECT key, t, v FROM n WHERE abs(m - t) <= 240000000"""))
def _(t):
    return R.regrid_nearest(t.series(), ["key"], "t", ["v"], STEP, 4 * MINUTE)


RANGE_NEAR = """
, x AS (SELECT scan, gate * 31.18::DOUBLE AS range, qty FROM scans),
n AS (SELECT scan, 25.0 * i AS target, qty, range, row_number() OVER (PARTITION BY scan, i ORDER BY abs(range - 25.0 * i), range DESC) AS rn
      FROM x, (SELECT unnest(generate_series(1, 9)) AS i))
"""


@query("regrid_nearest_range", "J4", sql("scans", RANGE_NEAR + "SELECT scan, CAST(target AS DOUBLE) AS range, qty FROM n WHERE rn = 1"))
def _(t):
    cells = t.scans().select("scan", (F.col("gate") * 31.18).alias("range"), "qty")
    return R.regrid_nearest_range(cells, ["scan"], "range", ["qty"], 25.0, 25.0, 9)


@query("regrid_nearest_range_within", "J4", sql("scans", RANGE_NEAR + "SELECT scan, CAST(target AS DOUBLE) AS range, qty FROM n WHERE rn = 1 AND abs(range - target) <= 10"))
def _(t):
    cells = t.scans().select("scan", (F.col("gate") * 31.18).alias("range"), "qty")
    return R.regrid_nearest_range(cells, ["scan"], "range", ["qty"], 25.0, 25.0, 9, 10.0)


@query("time_resample", "A9", sql("series", GRID + f""",
a AS (SELECT key, t // {STEP} * {STEP} AS t, 10 * log10(avg(pow(10.0, v / 100))) AS db, avg(v) AS v, arg_min(v, t) AS f FROM series GROUP BY 1, 2)
SELECT grid.key, grid.t, round(db, 6) AS db, round(v, 6) AS mean, f AS first FROM grid LEFT JOIN a ON grid.key = a.key AND grid.t = a.t"""))
def _(t):
    s = t.series().select("key", "t", (F.col("v") / 10).alias("db"), F.col("v").alias("mean"), F.col("v").alias("first"))
    out = R.time_resample(s, ["key"], "t", STEP, ["db"], ["mean"], ["first"], time_grid(t))
    return out.select("key", "t", r6(F.col("db")).alias("db"), r6(F.col("mean")).alias("mean"), "first")


@query("bin_average", "A10", sql("series", f"""
SELECT key, (t + 300000000) // {STEP} * {STEP} AS t, round(avg(v), 6) AS v FROM series GROUP BY 1, 2"""))
def _(t):
    out = R.regrid_average_or_nearest(t.series(), ["key"], "t", ["v"], STEP, MINUTE, MINUTE)
    return out.select("key", "t", r6(F.col("v")).alias("v"))


@query("majority_vote", "A11", sql("series", f"""
, f AS (SELECT key, (t + {HOUR // 2}) // {HOUR} * {HOUR} AS g, t, CAST(floor(v) AS BIGINT) % 3 AS flag FROM series),
c AS (SELECT key, g, flag, count(*) AS n, min(abs(t - g)) AS d FROM f GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY key, g ORDER BY n DESC, flag) AS rn, min(d) OVER (PARTITION BY key, g) AS dm FROM c)
SELECT key, g AS t, CASE WHEN dm <= 600000000 THEN flag ELSE -1 END AS flag FROM r WHERE rn = 1"""))
def _(t):
    s = t.series().withColumn("flag", F.floor("v") % 3)
    return R.majority_vote(s, ["key"], "t", "flag", HOUR, 10 * MINUTE)


LINEAR = """
, n AS (SELECT key, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM {src} WINDOW w AS (PARTITION BY key ORDER BY t)),
g AS (SELECT DISTINCT key, unnest(generate_series(CAST(ceil(t / {st}.0) AS BIGINT), CAST(floor(t1 / {st}.0) AS BIGINT))) * {st} AS x FROM n)
SELECT g.key, g.x AS t, round(CASE WHEN x = n.t THEN v ELSE v + (v1 - v) * ((x - n.t) / CAST(t1 - n.t AS DOUBLE)) END, 6) AS v
FROM g ASOF JOIN n ON g.key = n.key AND g.x >= n.t"""


@query("linear_in_time", "R1 R4", sql("series", LINEAR.format(src="series", st=STEP)))
def _(t):
    return R.regrid_linear_time(t.series(), ["key"], "t", ["v"], STEP).select("key", "t", r6(F.col("v")).alias("v"))


@query("linear_in_time_with_missing", "R1", sql("steps", LINEAR.format(src="steps", st=240 * SECOND)))
def _(t):
    return R.regrid_linear_time(t.steps(), ["key"], "t", ["v"], 240 * SECOND).select("key", "t", r6(F.col("v")).alias("v"))


PROFILE_LINEAR = """
, x AS (SELECT scan, gate * 31.18::DOUBLE AS range, qty FROM scans),
n AS (SELECT *, lead(range) OVER w AS r1, lead(qty) OVER w AS q1 FROM x WINDOW w AS (PARTITION BY scan ORDER BY range))
SELECT scan, g AS range, round(qty + (q1 - qty) * ((g - range) / (r1 - range)), 6) AS qty
FROM n, (SELECT CAST(25 * unnest(generate_series(1, 9)) AS DOUBLE) AS g) WHERE g >= range AND g < r1"""


@query("linear_in_range", "R3", sql("scans", PROFILE_LINEAR))
def _(t):
    cells = t.scans().select("scan", (F.col("gate") * 31.18).alias("range"), "qty")
    return R.interp_profile(cells, ["scan"], "range", ["qty"], 25.0, 25.0).select("scan", "range", r6(F.col("qty")).alias("qty"))


@query("mixed_regridding", "R2", sql("cells", f"""
, c AS (SELECT radar, t, range, z, CAST(vel > 0 AS INT) AS flag FROM cells),
n AS (SELECT *, lead(t) OVER w AS t1, lead(z) OVER w AS z1 FROM c WINDOW w AS (PARTITION BY radar, range ORDER BY t)),
g AS (SELECT DISTINCT radar, range, unnest(generate_series(CAST(ceil(t / {8 * HOUR}.0) AS BIGINT), CAST(floor(t1 / {8 * HOUR}.0) AS BIGINT))) * {8 * HOUR} AS x FROM n),
a AS (SELECT g.radar, g.range, g.x AS t, CASE WHEN x = n.t THEN z ELSE z + (z1 - z) * ((x - n.t) / CAST(t1 - n.t AS DOUBLE)) END AS z
      FROM g ASOF JOIN n ON g.radar = n.radar AND g.range = n.range AND g.x >= n.t),
m AS (SELECT *, lead(range) OVER w AS r1, lead(z) OVER w AS z1 FROM a WINDOW w AS (PARTITION BY radar, t ORDER BY range)),
lin AS (SELECT radar, t, h AS range, CASE WHEN h = range THEN z ELSE z + (z1 - z) * ((h - range) / (r1 - range)) END AS z
        FROM m, (SELECT CAST(40 + 40 * unnest(generate_series(0, 13)) AS DOUBLE) AS h) WHERE h >= range AND (h < r1 OR h = range)),
v1 AS (SELECT radar, range, (t + {4 * HOUR}) // {8 * HOUR} * {8 * HOUR} AS g, flag, count(*) AS n, min(abs(t - (t + {4 * HOUR}) // {8 * HOUR} * {8 * HOUR})) AS d FROM c GROUP BY 1, 2, 3, 4),
v2 AS (SELECT *, row_number() OVER (PARTITION BY radar, range, g ORDER BY n DESC, flag) AS rn, min(d) OVER (PARTITION BY radar, range, g) AS dm FROM v1),
v3 AS (SELECT radar, g AS t, least(greatest(floor((range - 40 + 20) / 40), 0), 13) * 40 + 40 AS h, range, flag FROM v2 WHERE rn = 1 AND dm <= {3 * HOUR}),
v4 AS (SELECT radar, t, h, flag, count(*) AS n, min(abs(range - h)) AS d FROM v3 GROUP BY 1, 2, 3, 4),
v5 AS (SELECT *, row_number() OVER (PARTITION BY radar, t, h ORDER BY n DESC, flag) AS rn, min(d) OVER (PARTITION BY radar, t, h) AS dm FROM v4)
SELECT lin.radar, lin.t, lin.range, round(z, 6) AS z, CASE WHEN dm IS NOT NULL THEN dm <= 15 AND flag = 1 END AS flag
FROM lin LEFT JOIN v5 ON v5.rn = 1 AND v5.radar = lin.radar AND v5.t = lin.t AND v5.h = lin.range"""))
def _(t):
    cells = t.cells().select("radar", "t", "range", "z", (F.col("vel") > 0).cast("int").alias("flag"))
    out = R.regrid_mixed(cells, ["radar"], "t", "range", ["z"], ["flag"], 8 * HOUR, 40.0, 40.0, 14, 3 * HOUR, 15.0)
    return out.select("radar", "t", "range", r6(F.col("z")).alias("z"), "flag")


# a model field of daily means per gate, at every time that has a next one
FIELD = f"""
, pia AS (SELECT t // {DAY} * {DAY} AS t, CAST(gate * 60 AS DOUBLE) - {{station}} AS elev, (avg(z) + 60) / 40 * {{scale}} AS pia FROM cells GROUP BY 1, gate HAVING gate * 60 >= {{station}}),
tt AS (SELECT t, lead(t) OVER (ORDER BY t) AS t1 FROM (SELECT DISTINCT t FROM pia)),
seg AS (SELECT t AS t0, t1 FROM tt WHERE t1 IS NOT NULL),
s1 AS (SELECT p.radar, p.t, p.gate, p.range, p.z, s.t0, s.t1 FROM cells p ASOF LEFT JOIN seg s ON p.t >= s.t0),
s2 AS (SELECT radar, t, gate, range, z, coalesce(t0, (SELECT min(t0) FROM seg)) AS t0, coalesce(t1, (SELECT min(t1) FROM seg)) AS t1 FROM s1),
v AS (SELECT s2.*, a.elev, a.pia + (b.pia - a.pia) * ((s2.t - t0) / CAST(t1 - t0 AS DOUBLE)) AS v FROM s2 JOIN pia a ON a.t = t0 JOIN pia b ON b.t = t1 AND b.elev = a.elev),
w AS (SELECT *, lead(elev) OVER x AS e1, lead(v) OVER x AS v1, row_number() OVER x AS i FROM v WINDOW x AS (PARTITION BY radar, t, gate ORDER BY elev)),
k AS (SELECT *, count(*) FILTER (WHERE elev <= range) OVER q AS below, count(*) OVER q AS n FROM w WINDOW q AS (PARTITION BY radar, t, gate))
SELECT radar, t, gate, round(z + v + (v1 - v) * ((range - elev) / (e1 - elev)), 6) AS corrected FROM k WHERE i = least(greatest(below, 1), n - 1)"""


def model_field(cells):
    return (cells.groupBy((floor_div(F.col("t"), DAY) * DAY).alias("t"), (F.col("gate") * 60).cast("double").alias("elevation"))
            .agg(((F.avg("z") + 60) / 40).alias("p")))


@query("bilinear_attenuation", "R5 P12", sql("cells", FIELD.format(station=0, scale=1)))
def _(t):
    cells = t.cells()
    out = R.interp_at(model_field(cells), cells.select("radar", "t", "gate", "range", "z"), "t", "elevation", "p", "range", "pia")
    return out.filter(F.col("pia").isNotNull()).select("radar", "t", "gate", r6(F.col("z") + F.col("pia")).alias("corrected"))


@query("gas_attenuation", "P12", sql("cells", FIELD.format(station=150, scale=0.5)))
def _(t):
    cells = t.cells()
    bands = F.array(*[F.struct(F.lit(f).alias("frequency"), F.lit(k).alias("k")) for f, k in ((94.95, 1.0), (35.2, 0.5), (9.41, 0.1))])
    table = model_field(cells).withColumn("b", F.explode(bands)).select("t", "elevation", "b.frequency", (F.col("p") * F.col("b.k")).alias("pia"))
    out = R.gas_attenuation(cells.select("radar", "t", "gate", "range", "z"), table, "t", "range", "z", 35.5, 150.0)
    return out.filter(F.col("corrected").isNotNull()).select("radar", "t", "gate", r6(F.col("corrected")).alias("corrected"))


@query("needs_resampling", "R6", sql("steps", """
, g AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS i FROM steps)
SELECT key, count(*) >= 2 AND (count(*) <> 4319 OR max(abs(t - (1704067200000000 + i * 600000000))) > 60000000) AS resample FROM g GROUP BY 1"""))
def _(t):
    return R.needs_resampling(t.steps(), ["key"], "t", STEP, 1704067200000000, 4319, MINUTE)


@query("harmonised_mode", "R7", sql("scans", """
, x AS (SELECT scan, gate * 12.5::DOUBLE AS range, row_number() OVER (PARTITION BY scan ORDER BY gate) - 1 AS k, qty, disc, disc > 0.05 AS m FROM scans),
y AS (SELECT *, avg(pow(10.0, qty / 10)) OVER p AS ql, avg(disc) OVER p AS vl FROM x WINDOW p AS (PARTITION BY scan ORDER BY range ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
n AS (SELECT *, lead(range) OVER w AS r1, lead(ql) OVER w AS q1, lead(vl) OVER w AS v1 FROM y WINDOW w AS (PARTITION BY scan ORDER BY range)),
c AS (SELECT scan, k // 2 AS b, avg(range) AS r, bool_or(m) AS m FROM x GROUP BY 1, 2 HAVING count(*) = 2),
g AS (SELECT CAST(25 * unnest(generate_series(1, 4)) AS DOUBLE) AS h),
l AS (SELECT scan, h, CASE WHEN h = range THEN ql ELSE ql + (q1 - ql) * ((h - range) / (r1 - range)) END AS q,
             CASE WHEN h = range THEN vl ELSE vl + (v1 - vl) * ((h - range) / (r1 - range)) END AS v FROM n, g WHERE h >= range AND (h < r1 OR h = range)),
mm AS (SELECT scan, h, arg_min(m, {'d': abs(r - h), 'r': -r}) AS m, min(abs(r - h)) AS d FROM c, g GROUP BY 1, 2)
SELECT l.scan, l.h AS range, round(10 * log10(q), 6) AS qty, round(v, 6) AS disc, mm.m AS mask FROM l LEFT JOIN mm ON mm.scan = l.scan AND mm.h = l.h AND mm.d <= 13"""))
def _(t):
    cells = t.scans().select("scan", (F.col("gate") * 12.5).alias("range"), "qty", "disc", (F.col("disc") > 0.05).alias("mask"))
    out = R.harmonise_modes(cells, ["scan"], "range", 25.0, 25.0, 4, ["qty"], ["disc"], ["mask"], two_gate=True)
    return out.select("scan", "range", r6(F.col("qty")).alias("qty"), r6(F.col("disc")).alias("disc"), "mask")


@query("coarsened_blocks", "R8", sql("grid_cells", f"""
, b AS (SELECT *, (t - min(t) OVER (PARTITION BY radar)) // {4 * SLOT} AS bt, gate // 2 AS bg FROM grid_cells)
SELECT radar, min(t) AS t, min(gate) AS gate, round(avg(z) + 1e-9, 6) AS z, max(vel) AS vel FROM b GROUP BY radar, bt, bg HAVING count(*) = 8"""))
def _(t):
    out = R.coarsen(t.grid_cells(), ["radar"], "t", "gate", SLOT, 4, 2, ["z"], ["vel"])
    return out.select("radar", "t", "gate", r6(F.col("z") + 1e-9).alias("z"), "vel")


@query("rebinned_mask", "R9", sql("series", f"""
SELECT key, t // {HOUR} * {HOUR} AS t, avg(CAST(v > 25 AS INT)) >= 0.5 AS mask FROM series GROUP BY 1, 2"""))
def _(t):
    return R.rebin_mask(t.series().withColumn("mask", F.col("v") > 25), ["key"], "t", "mask", HOUR)


@query("axis_edges", "R10", sql("", """
WITH a AS (SELECT DISTINCT p_brand AS key, p_retailprice AS c FROM part),
n AS (SELECT key, c, lag(c) OVER w AS p, lead(c) OVER w AS n FROM a WINDOW w AS (PARTITION BY key ORDER BY c))
SELECT key, c, round(CASE WHEN p IS NULL THEN c - (n - c) / 2 ELSE (p + c) / 2 END, 6) AS lower,
       round(CASE WHEN n IS NULL THEN c + (c - p) / 2 ELSE (c + n) / 2 END, 6) AS upper FROM n"""))
def _(t):
    axis = t.part.select(F.col("p_brand").alias("key"), F.col("p_retailprice").alias("c")).distinct()
    return R.bin_edges(axis, ["key"], "c").select("key", "c", r6(F.col("lower")).alias("lower"), r6(F.col("upper")).alias("upper"))


@query("resized_spectrum", "R11", sql("spectra", """
SELECT vec_id, CAST(i AS INT) AS bin, round(power[lo + 1] + (power[lo + 2] - power[lo + 1]) * (x - lo), 6) AS power
FROM (SELECT vec_id, i, power, i * 63 / 127.0::DOUBLE AS x, CAST(least(floor(i * 63 / 127.0::DOUBLE), 62) AS BIGINT) AS lo FROM spectra, (SELECT unnest(generate_series(0, 127)) AS i))"""))
def _(t):
    out = t.spectra().select("vec_id", F.posexplode(R.resize_spectrum(F.col("power"), 128)).alias("bin", "power"))
    return out.select("vec_id", "bin", r6(F.col("power")).alias("power"))


@query("flattened_sweeps", "R12", sql("spectra", """
, s AS (SELECT label, list_max(power) AS mx, list_sum(power) / len(power) AS mean FROM spectra)
SELECT label, round(avg(mx), 6) AS mx, round(avg(mean), 6) AS mean FROM s GROUP BY 1"""))
def _(t):
    s = t.spectra().select("label", R.collapse_doppler(F.col("power"), "max").alias("mx"),
                           R.collapse_doppler(F.col("power"), "mean").alias("mean"))
    out = R.flatten_sweep(s, [], "label", ["mx", "mean"])
    return out.select("label", r6(F.col("mx")).alias("mx"), r6(F.col("mean")).alias("mean"))


@query("hourly_zenith_merge", "R13 S6", sql("series", GRID + f""",
src AS (SELECT key, t, v, t // {HOUR} AS file FROM series),
sp AS (SELECT key, file, min(t) AS s, max(t) AS e FROM src GROUP BY 1, 2),
b AS (SELECT g.key, g.t, s.t AS bt, s.v AS bv FROM grid g ASOF LEFT JOIN src s ON g.key = s.key AND g.t >= s.t),
f AS (SELECT b.*, s.t AS ft, s.v AS fv FROM b ASOF LEFT JOIN src s ON b.key = s.key AND b.t <= s.t),
n AS (SELECT key, t, CASE WHEN bt IS NULL OR ft - t <= t - bt THEN fv ELSE bv END AS v FROM f)
SELECT n.key, n.t, CASE WHEN n.t <= sp.e THEN n.v END AS v FROM n ASOF LEFT JOIN sp ON n.key = sp.key AND n.t >= sp.s"""))
def _(t):
    src = t.series().withColumn("file", floor_div(F.col("t"), HOUR))
    return R.zenith_merge(src, ["key"], "t", ["v"], "file", time_grid(t))
