"""Queries of calibration and multi-instrument composites."""

from pyspark.sql import functions as F

from skycolumn.operators import composite
from skycolumn.operators import calibration as C
from skycolumn.operators.ordered import DAY, HOUR, epoch_us
from skycolumn.plans.bindings import SLOT, r6, sql
from skycolumn.plans.q_regrid import model_field
from skycolumn.plans.registry import query
from skycolumn.session import cut_lineage

SEARCH = """
, v AS (SELECT month, a, b, a + b AS s FROM pairs WHERE b >= -a - 40),
e AS (SELECT month, quantile_cont(s, 0.025) AS i0, quantile_cont(s, 1 - 0.025) AS j0, count(*) AS total FROM v GROUP BY 1),
cj AS (SELECT e.*, k, j0 - 2.0 * k AS j FROM e, LATERAL (SELECT unnest(generate_series(0, CAST(greatest(ceil((j0 - i0) / 2.0 - 1), 0) AS BIGINT))) AS k)),
fj AS (SELECT month, k, i0 AS i, j, min(i0) AS i0, min(j0) AS j0, min(total) AS total, regr_slope(b, a) AS slope, regr_r2(b, a) AS r2,
       sqrt(greatest(regr_syy(b, a) - regr_sxy(b, a) * regr_sxy(b, a) / regr_sxx(b, a), 0) / count(*)) AS rmse, count(*) / CAST(min(total) AS DOUBLE) AS share
       FROM cj JOIN v USING (month) WHERE v.s BETWEEN i0 AND j GROUP BY month, k, i, j HAVING count(*) / CAST(min(total) AS DOUBLE) > 0.6),
gj AS (SELECT *, 0 AS phase, coalesce(slope BETWEEN 0.85 AND 1.15 AND r2 BETWEEN 0.8 AND 1.0, false) AS good FROM fj),
b AS (SELECT month, arg_min(k, {'r': rmse, 'k': k}) AS ka, arg_min(k, {'r': rmse, 'k': k}) FILTER (WHERE good) AS kg FROM gj GROUP BY 1),
t AS (SELECT e.*, j0 - 2.0 * greatest(coalesce(ka, 0), coalesce(kg, 0)) AS jb FROM e LEFT JOIN b USING (month)),
ci AS (SELECT t.*, k, i0 + 2.0 * k AS i FROM t, LATERAL (SELECT unnest(generate_series(0, CAST(greatest(ceil((jb - i0) / 2.0 - 2), 0) AS BIGINT))) AS k)),
fi AS (SELECT month, k, i, jb AS j, regr_slope(b, a) AS slope, regr_r2(b, a) AS r2,
       sqrt(greatest(regr_syy(b, a) - regr_sxy(b, a) * regr_sxy(b, a) / regr_sxx(b, a), 0) / count(*)) AS rmse, count(*) / CAST(min(total) AS DOUBLE) AS share
       FROM ci JOIN v USING (month) WHERE v.s BETWEEN i AND jb GROUP BY month, k, i, jb HAVING count(*) / CAST(min(total) AS DOUBLE) > 0.6),
al AS (SELECT month, i, j, slope, r2, rmse, share, phase, k, good FROM gj UNION ALL SELECT month, i, j, slope, r2, rmse, share, 1, k,
       coalesce(slope BETWEEN 0.85 AND 1.15 AND r2 BETWEEN 0.8 AND 1.0, false) FROM fi),
best AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY month ORDER BY CAST(good AS INT) DESC, CASE WHEN good THEN 0 ELSE -r2 END, round(rmse, 9), phase, k) = 1)"""


def pairs(t):
    return C.sensitivity_filter(t.pairs(), "a", "b", -40.0)


@query("calibration_band_search", "C2 C4", sql("pairs", SEARCH + """
SELECT month, round(i, 6) AS i, round(j, 6) AS j, round(slope, 6) AS slope, round(r2, 6) AS r_squared, round(rmse, 6) AS rmse, round(share, 6) AS share,
       CASE WHEN good THEN 1 ELSE -5 END AS solution_found FROM best""".replace("SELECT month", "SELECT epoch_us(CAST(month AS TIMESTAMP)) AS month")))
def _(t):
    out = C.range_limits(pairs(t), ["month"], "a", "b")
    names = ["slope", "r_squared", "rmse", "share"]
    return out.select(epoch_us(F.col("month")).alias("month"), r6(F.col("i")).alias("i"), r6(F.col("j")).alias("j"),
                      *[r6(F.col(c)).alias(c) for c in names], "solution_found")


DENSE = """
n AS (SELECT *, min(a) OVER m AS a0, max(a) OVER m AS a1, min(b) OVER m AS b0, max(b) OVER m AS b1 FROM {src} WINDOW m AS (PARTITION BY month)),
c AS (SELECT *, least(floor((a - a0) / ((a1 - a0) / 100)), 99) AS ia, least(floor((b - b0) / ((b1 - b0) / 100)), 99) AS ib FROM n),
d AS (SELECT *, count(*) OVER (PARTITION BY month, ia, ib) AS dens FROM c),
q AS (SELECT *, quantile_cont(CAST(dens AS DOUBLE), 0.025) OVER (PARTITION BY month) AS bound FROM d)"""


@query("density_filtered_pairs", "C5", sql("pairs", ", " + DENSE.format(src="pairs").strip() + """
SELECT epoch_us(CAST(month AS TIMESTAMP)) AS month, count(*) AS n, round(sum(a), 4) AS a, round(sum(b), 4) AS b FROM q WHERE dens > bound GROUP BY 1"""))
def _(t):
    kept = C.density_filter(t.pairs(), ["month"], "a", "b")
    return kept.groupBy(epoch_us(F.col("month")).alias("month")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("a"), 4).alias("a"), r6(F.sum("b"), 4).alias("b"))


@query("offset_fit", "C1 C3 C6", sql("pairs", """
SELECT epoch_us(CAST(month AS TIMESTAMP)) AS month, round(avg(b - a), 6) AS "offset", round(stddev_pop(b - a), 6) AS spread, round(corr(a, b), 6) AS correlation,
       count(*) AS n_used FROM pairs WHERE a + b BETWEEN -50 AND 20 GROUP BY 1"""))
def _(t):
    inside = C.range_selection(C.pairwise_valid(t.pairs(), "a", "b"), "a", "b", F.lit(-50.0), F.lit(20.0)).filter("inside")
    out = C.fit_offset(inside, ["month"], "a", "b")
    return out.select(epoch_us(F.col("month")).alias("month"), *[r6(F.col(c)).alias(c) for c in ("offset", "spread", "correlation")], "n_used")


@query("monthly_calibration", "C7", sql("pairs", SEARCH + """,
ins AS (SELECT v.*, total FROM v JOIN best USING (month) JOIN e USING (month) WHERE v.s BETWEEN best.i AND best.j),
""" + DENSE.format(src="ins").strip() + """,
o AS (SELECT month, avg(b - a) AS off, stddev_pop(b - a) AS spread, count(*) / CAST(min(total) AS DOUBLE) AS used FROM q WHERE dens > bound GROUP BY 1)
SELECT epoch_us(CAST(month AS TIMESTAMP)) AS month, round(off, 6) AS "offset", round(spread, 6) AS spread, round(used, 6) AS share_used,
       round(slope, 6) AS slope, round(rmse, 6) AS rmse FROM o JOIN best USING (month)"""))
def _(t):
    out = C.calibrate(t.pairs(), ["month"], "a", "b", -40.0)
    return out.select(epoch_us(F.col("month")).alias("month"), *[r6(F.col(c)).alias(c) for c in ("offset", "spread", "share_used", "slope", "rmse")])


ROWS = """WITH r AS (SELECT o_orderkey AS o, epoch_us(o_orderdate) AS d, o_totalprice / 1e5 AS cc, o_totalprice % 977 AS rmse,
  CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE -5 END AS sol, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + (o_custkey % 5 + 1) * 3600000000 AS e FROM orders),
sd AS (SELECT DISTINCT d FROM r WHERE sol = 1),
cand AS (SELECT * FROM r WHERE sol = 1 UNION ALL SELECT * FROM r WHERE sol = -5 AND d NOT IN (SELECT d FROM sd)),
used AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY d ORDER BY rmse, o) = 1),
ex AS (SELECT * FROM r WHERE sol = -5 AND d IN (SELECT d FROM sd) UNION ALL SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY d ORDER BY o) > 1)
"""


def results(t):
    day = epoch_us(F.col("o_orderdate"))
    return t.orders.select(
        F.col("o_orderkey").alias("o"), day.alias("d"), (F.col("o_totalprice") / 1e5).alias("cc"), (F.col("o_totalprice") % 977).alias("rmse"),
        F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(-5).alias("solution_found"), day.alias("s"),
        (day + (F.col("o_custkey") % 5 + 1) * HOUR).alias("e"))


@query("calibration_statistics", "A26", ROWS + """, f AS (SELECT d, count(*) FILTER (WHERE sol = -5) AS f FROM r GROUP BY 1)
SELECT round((SELECT avg(cc) FROM r WHERE sol = 1), 6) AS solution_mean, round((SELECT stddev_samp(cc) FROM r WHERE sol = 1), 6) AS solution_std,
 round((SELECT avg(cc) FROM r WHERE sol = -5), 6) AS no_solution_mean, round((SELECT stddev_samp(cc) FROM r WHERE sol = -5), 6) AS no_solution_std,
 round((SELECT avg(cc) FROM r), 6) AS all_mean, round((SELECT stddev_samp(cc) FROM r), 6) AS all_std, (SELECT count(*) FROM r) AS total_entries,
 round((SELECT avg(cc) FROM used), 6) AS included_mean, round((SELECT stddev_samp(cc) FROM used), 6) AS included_std, (SELECT count(*) FROM used) AS priority_entries,
 (SELECT count(*) FROM ex) AS excluded_entries, (SELECT count(*) FROM f WHERE f = 1) AS single_entries_no_solution,
 (SELECT CAST(coalesce(sum(f), 0) AS BIGINT) FROM f WHERE f > 1) AS multi_entries_no_solution""")
def _(t):
    out = C.calib_stats(results(t), "d", "o", "cc")
    return out.select(*[r6(F.col(c)).alias(c) if c.endswith(("mean", "std")) else F.col(c) for c in out.columns])


@query("calibration_timeline", "C12 J9", ROWS + """
SELECT true AS used, count(*) AS entries, CAST(sum(e - s) / 3600000000.0 AS DOUBLE) AS hours FROM used
UNION ALL SELECT false, count(*), CAST(sum(e - s) / 3600000000.0 AS DOUBLE) FROM ex""")
def _(t):
    return C.calibration_timeline(results(t), "d", "o", "s", "e", HOUR)


@query("layer_top_ratio", "C8", sql("grid_cells", """
, j AS (SELECT a.t, a.gate, ka, w FROM (SELECT t, gate, max(z) AS ka FROM grid_cells WHERE radar IN ('click', 'error', 'signup') GROUP BY 1, 2) a
        JOIN (SELECT t, gate, max(z) AS w FROM grid_cells WHERE radar IN ('view', 'purchase') GROUP BY 1, 2) b USING (t, gate)),
i AS (SELECT *, sum(CASE WHEN g = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY t ORDER BY gate) AS id FROM
      (SELECT *, gate - lag(gate) OVER (PARTITION BY t ORDER BY gate) AS g FROM j WHERE ka IS NOT NULL AND w IS NOT NULL)),
l AS (SELECT t, max(b) AS hi FROM (SELECT t, id, max(gate) AS b FROM i GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1),
tp AS (SELECT j.t, j.gate, j.t // 172800000000 * 172800000000 AS win, CASE WHEN gate BETWEEN hi - 3 AND hi THEN ka END AS ka,
       CASE WHEN gate BETWEEN hi - 3 AND hi THEN w END AS w, CASE WHEN gate BETWEEN hi - 3 AND hi THEN ka - w END AS dfr FROM j LEFT JOIN l USING (t)),
vr AS (SELECT a.win, a.t, a.gate, count(o.dfr) AS n, var_pop(o.dfr) AS vp FROM tp a JOIN tp o ON a.win = o.win AND o.gate BETWEEN a.gate - 1 AND a.gate + 1
       AND o.t BETWEEN a.t - 43200000000 AND a.t + 21600000000 GROUP BY 1, 2, 3),
s AS (SELECT tp.win, count(dfr) AS n, avg(dfr) AS m, corr(ka, w) AS c, count(*) FILTER (WHERE vr.n >= 4 AND vp > 100) AS hi, count(*) FILTER (WHERE vr.n >= 4) AS tot FROM tp JOIN vr USING (win, t, gate) GROUP BY 1)
SELECT win AS "window", n, round(m, 6) AS mean_dfr, round(c, 6) AS correlation, round(CASE WHEN tot > 0 THEN hi / CAST(tot AS DOUBLE) ELSE 0 END, 6) AS ratio FROM s WHERE n >= 10"""))
def _(t):
    c = t.grid_cells()
    view = lambda names: c.filter(F.col("radar").isin(*names)).groupBy("t", "gate").agg(F.max("z").alias("z"))
    out = C.cloudtop_dfr(view(["view", "purchase"]), view(["click", "error", "signup"]), "t", "gate", "z", 2 * DAY, SLOT, 5, 4, (4, 3, 4), 100.0)
    return out.select("window", "n", *[r6(F.col(c)).alias(c) for c in ("mean_dfr", "correlation", "ratio")])


@query("calibrated_ratio_series", "C11", sql("cells", """
, d AS (SELECT a.radar AS first, b.radar AS second, a.t, a.z - b.z + 3.35 AS d FROM cells a JOIN cells b ON a.t = b.t AND a.gate = b.gate AND a.radar < b.radar)
SELECT first, second, t // 86400000000 * 86400000000 AS day, round(avg(d) FILTER (WHERE d BETWEEN -5 AND 25), 6) AS mean, count(*) FILTER (WHERE d BETWEEN 0 AND 20) AS n
FROM d GROUP BY 1, 2, 3"""))
def _(t):
    from skycolumn.operators.joins import instrument_pairs
    d = instrument_pairs(t.cells(), "radar", ["t", "gate"], "z")
    wide, narrow = (C.calibrated_ratio(F.col("dfr"), 3.35, *lim) for lim in ((-5.0, 25.0), (0.0, 20.0)))
    return d.groupBy("first", "second", (F.floor(F.col("t") / DAY) * DAY).alias("day")).agg(r6(F.avg(wide)).alias("mean"), F.count(narrow).alias("n"))


@query("scan_guard", "C13", sql("scans", """
, s AS (SELECT scan, CAST(max(t) - min(t) AS DOUBLE) / 86400000000 AS duration, avg(CAST(disc > 0.06 AS INT)) AS flagged, count(*) AS rays FROM scans GROUP BY 1)
SELECT scan, duration, round(flagged, 6) AS flagged, rays, CASE WHEN duration > 1400 THEN 'too long' WHEN duration < 350 THEN 'too short' WHEN flagged >= 0.5 THEN 'flagged' END AS reason FROM s"""))
def _(t):
    out = C.scan_guard(t.scans(), "scan", "t", 700.0, flagged=F.col("disc") > 0.06, unit=DAY)
    return out.select("scan", "duration", r6(F.col("flagged")).alias("flagged"), "rays", "reason")


@query("scan_exclusions", "C13", sql("scans", """
, s AS (SELECT scan, min(t) AS at, CAST(max(t) - min(t) AS DOUBLE) / 86400000000 AS duration, count(*) AS rays FROM scans GROUP BY 1),
lost AS (SELECT epoch_us(o_orderdate) AS s, max(epoch_us(o_orderdate) + (o_custkey % 7) * 3600000000) AS e FROM orders WHERE o_custkey % 11 = 0 GROUP BY 1),
far AS (SELECT s, max(e) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS e FROM lost),
done AS (SELECT DISTINCT l_orderkey AS scan FROM lineitem WHERE l_returnflag = 'R')
SELECT x.scan, x.duration, x.rays, CASE WHEN coalesce(x.at <= far.e, false) THEN 'frequency lost' WHEN done.scan IS NOT NULL THEN 'already processed'
  WHEN duration > 1400 THEN 'too long' WHEN duration < 350 THEN 'too short' END AS reason
FROM s x ASOF LEFT JOIN far ON x.at >= far.s LEFT JOIN done ON done.scan = x.scan"""))
def _(t):
    start = epoch_us(F.col("o_orderdate"))
    lost = t.orders.filter("o_custkey % 11 = 0").select(start.alias("start"), (start + F.col("o_custkey") % 7 * HOUR).alias("end"))
    done = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scan"))
    judged = C.scan_guard(t.scans(), "scan", "t", 700.0, unit=DAY)
    return C.exclude_scans(judged, "scan", "start", lost, done).select("scan", "duration", "rays", "reason")


@query("zenith_day", "C10 C9 F4 J3 J5 P1 P3 P12 W1", sql("grid_cells corrections ring", f"""
, r1 AS (SELECT before AS radar, key AS w FROM ring), r2 AS (SELECT a.radar, a.w, b.w AS x FROM r1 a JOIN r1 b ON b.radar = a.w),
wide AS (SELECT a.radar, a.t, a.gate, a.range, CASE WHEN a.vel > -2 THEN a.z END AS z_ka, CASE WHEN b.vel > -2 THEN b.z END AS z_w, CASE WHEN c.vel > -2 THEN c.z END AS z_x
  FROM grid_cells a JOIN r2 USING (radar) LEFT JOIN cells b ON b.radar = r2.w AND b.t = a.t AND b.gate = a.gate LEFT JOIN cells c ON c.radar = r2.x AND c.t = a.t AND c.gate = a.gate),
pia AS (SELECT t // {DAY} * {DAY} AS t, CAST(gate * 60 AS DOUBLE) - 150 AS elev, (avg(z) + 60) / 40 AS pia FROM cells GROUP BY 1, gate HAVING gate * 60 >= 150),
tm AS (SELECT t, lead(t) OVER (ORDER BY t) AS t1 FROM (SELECT DISTINCT t FROM pia)), seg AS (SELECT t AS t0, t1 FROM tm WHERE t1 IS NOT NULL),
s1 AS (SELECT p.radar, p.t, p.gate, p.range, s.t0, s.t1 FROM wide p ASOF LEFT JOIN seg s ON p.t >= s.t0),
s2 AS (SELECT radar, t, gate, range, coalesce(t0, (SELECT min(t0) FROM seg)) AS t0, coalesce(t1, (SELECT min(t1) FROM seg)) AS t1 FROM s1),
v AS (SELECT s2.*, a.elev, a.pia + (b.pia - a.pia) * ((s2.t - t0) / CAST(t1 - t0 AS DOUBLE)) AS v FROM s2 JOIN pia a ON a.t = t0 JOIN pia b ON b.t = t1 AND b.elev = a.elev),
vw AS (SELECT *, lead(elev) OVER x AS e1, lead(v) OVER x AS v1, row_number() OVER x AS i FROM v WINDOW x AS (PARTITION BY radar, t, gate ORDER BY elev)),
vk AS (SELECT *, count(*) FILTER (WHERE elev <= range) OVER q AS below, count(*) OVER q AS n FROM vw WINDOW q AS (PARTITION BY radar, t, gate)),
att AS (SELECT radar, t, gate, v + (v1 - v) * ((range - elev) / (e1 - elev)) AS pia FROM vk WHERE i = least(greatest(below, 1), n - 1)),
st AS (SELECT t + 800000000000000 AS t, corr / 1e5 AS corr FROM corrections),
j AS (SELECT radar, t, gate, wide.range, z_ka, z_w + att.pia + st.corr + 3.35 AS z_w, z_x FROM wide LEFT JOIN att USING (radar, t, gate) ASOF LEFT JOIN st ON wide.t >= st.t),
vi AS (SELECT radar, t, gate, range, gate - lag(gate) OVER (PARTITION BY radar, t ORDER BY gate) - 1 AS gap FROM wide WHERE z_ka > -57),
h AS (SELECT radar, t, id, max(range) AS top FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY radar, t ORDER BY gate) AS id FROM vi) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
ct AS (SELECT radar, t, max(top) AS top FROM h GROUP BY 1, 2),
lo AS (SELECT radar, t, arg_min(a, a) AS a, arg_min(b, a) AS b, arg_min(top, a) AS top FROM (SELECT radar, t, id, min(gate) AS a, max(gate) AS b, max(range) AS top
  FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY radar, t ORDER BY gate) AS id FROM vi) GROUP BY 1, 2, 3) GROUP BY 1, 2),
tt AS (SELECT d.radar, d.t, CASE WHEN lo.a < 3 AND lo.b > 0 AND ct.top IS NOT NULL THEN least(ct.top, lo.top) END AS top
  FROM (SELECT DISTINCT radar, t FROM wide) d LEFT JOIN ct USING (radar, t) LEFT JOIN lo USING (radar, t)),
sm AS (SELECT radar, t, top, CASE WHEN count(top) OVER w5 >= 1 THEN avg(top) OVER w5 END AS smooth FROM tt WINDOW w5 AS (PARTITION BY radar ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT radar, t, j.range, round(z_ka, 6) AS z_ka, round(z_w, 6) AS z_w, round(z_x, 6) AS z_x, round(z_ka - z_w, 6) AS dfr_ka_w, round(z_ka - z_x, 6) AS dfr_ka_x,
  top AS cloudtop, round(smooth, 6) AS cloudtop_smooth FROM j JOIN sm USING (radar, t)"""))
def _(t):
    """Three instruments on one grid, each in turn as the reference: masks, attenuation, step corrections, constant, ratios, connected tops."""
    names = ["ka", "w", "x"]
    cells = t.cells().select("radar", "t", "gate", "z", F.col("vel").alias("snr"))
    ring = t.ring("radar").select(F.col("before").alias("radar"), F.col("radar").alias("after"))
    wide = composite.wide_frame(cells, t.grid_cells().select("radar", "gate", "t"), composite.role_table(ring, "radar", "after", names), "radar", "t", "gate", ["z", "snr"], SLOT, names, "ka")
    wide = cut_lineage(wide.withColumn("range", ((F.col("gate") + 1) * 25).cast("double")))
    steps = t.corrections().select((F.col("t") + 800_000_000_000_000).alias("t"), (F.col("corr") / 1e5).alias("corr"))
    field = model_field(t.cells()).select("t", "elevation", F.lit(94.95).alias("frequency"), F.col("p").alias("pia"))
    out = composite.composite(wide, ["radar"], "t", "gate", "range", "ka", "w", ["x"], -2.0, field, 94.95, 150.0, steps, 3.35, -57.0, SLOT)
    rounded = [r6(F.col(c)).alias(c) for c in ("z_ka", "z_w", "z_x", "dfr_ka_w", "dfr_ka_x")]
    return out.select("radar", "t", "range", *rounded, "cloudtop", r6(F.col("cloudtop_smooth")).alias("cloudtop_smooth"))
