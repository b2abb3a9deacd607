"""Queries of rolling, filtering and difference operators."""

from pyspark.sql import functions as F

from skycolumn.operators import windows as W
from skycolumn.operators.ordered import HOUR, MINUTE, epoch_us
from skycolumn.plans.bindings import SLOT, STEP, r6, sql
from skycolumn.plans.registry import query


@query("rolling_mean", "W1", sql("steps", """
SELECT key, t, round(CASE WHEN count(v) OVER w >= 4 THEN avg(v) OVER w END + 1e-9, 6) AS v_mean FROM steps
WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"""))
def _(t):
    return W.rolling_mean(t.steps(), ["key"], "t", "v", STEP, 20, 4).select("key", "t", r6(F.col("v_mean") + 1e-9).alias("v_mean"))


@query("dominant_flag", "W3", sql("steps", """
, f AS (SELECT key, t, coalesce(v > 60, false) AS f1, coalesce(v BETWEEN 20 AND 50, false) AS f2, coalesce(v > 10, false) AS p FROM steps),
s AS (SELECT *, CASE WHEN count(*) OVER w >= 6 THEN avg(CAST(f1 AS INT)) OVER w END AS a, CASE WHEN count(*) OVER w >= 6 THEN avg(CAST(f2 AS INT)) OVER w END AS b,
      CASE WHEN count(*) OVER w >= 6 THEN avg(CAST(p AS INT)) OVER w END AS c FROM f WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING))
SELECT key, t, f1 OR coalesce(c > 0.6 AND (a > 0 OR b > 0) AND a > b, false) AS f1,
       f2 OR coalesce(c > 0.6 AND (a > 0 OR b > 0) AND NOT a > b, false) AS f2, coalesce(c > 0.6, false) AS extended FROM s"""))
def _(t):
    v = F.col("v")
    on = lambda c: F.coalesce(c, F.lit(False))
    flags = t.steps().select("key", "t", on(v > 60).alias("f1"), on(v.between(20, 50)).alias("f2"), on(v > 10).alias("p"))
    return W.dominant_flag(flags, ["key"], "t", "f1", "f2", "p", STEP, 6, 0.6).select("key", "t", "f1", "f2", "extended")


@query("box_variance", "W4", sql("grid_cells", """
, b AS (SELECT a.radar, a.t, a.gate, count(o.z) AS n, avg(o.z) AS m, var_pop(o.z) AS s
        FROM grid_cells a JOIN grid_cells o ON a.radar = o.radar AND o.gate BETWEEN a.gate - 3 AND a.gate + 2
             AND o.t BETWEEN a.t - 2 * 21600000000 AND a.t + 21600000000 GROUP BY 1, 2, 3)
SELECT radar, t, gate, round(CASE WHEN n >= 8 THEN s END + 1e-7, 4) AS variance FROM b"""))
def _(t):
    out = W.rolling_var_2d(t.grid_cells(), ["radar"], "t", "gate", "z", SLOT, 4, 6, 8)
    return out.select("radar", "t", "gate", r6(F.col("variance") + 1e-7, 4).alias("variance"))


UNI = """
, f AS (SELECT key, t, coalesce(v, 0.0) AS v FROM steps),
e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i, count(*) OVER (PARTITION BY key) AS n,
      first(v) OVER (PARTITION BY key ORDER BY t) AS v0, last(v) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v1 FROM f),
u AS (SELECT *, sum(v) OVER w + greatest(0, 3 - i) * v0 + greatest(0, i + 2 - n) * v1 AS s,
      sum(v * v) OVER w + greatest(0, 3 - i) * v0 * v0 + greatest(0, i + 2 - n) * v1 * v1 AS q
      FROM e WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def _full(t):
    return t.steps().select("key", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


@query("uniform_filter", "W5", sql("steps", UNI + """
SELECT key, t, round(s / 5, 6) AS mean, round(sqrt(greatest(q / 5 - (s / 5) * (s / 5), 0)), 4) AS std FROM u"""))
def _(t):
    out = W.uniform_filter(_full(t), ["key"], "t", "v", STEP, 5)
    return out.select("key", "t", r6(F.col("mean")).alias("mean"), r6(F.col("std"), 4).alias("std"))


@query("autocovariance", "W6", sql("steps", """
, m AS (SELECT *, avg(v) OVER (PARTITION BY key) AS m, count(*) OVER (PARTITION BY key) AS n, lead(v, 2) OVER (PARTITION BY key ORDER BY t) AS y FROM steps)
SELECT key, round(sum((v - m) * (y - m)) / (min(n) - 1), 4) AS autocov FROM m GROUP BY 1"""))
def _(t):
    return W.autocovariance(t.steps(), ["key"], "t", "v", STEP, 2).select("key", r6(F.col("autocov"), 4).alias("autocov"))


NOISY = """
, g{i} AS (SELECT radar, t, gate, {x} AS x, lead({x}) OVER (PARTITION BY radar, gate ORDER BY t) AS y,
           avg({x}) OVER (PARTITION BY radar, gate) AS m, stddev_pop({x}) OVER (PARTITION BY radar, gate) AS sd FROM grid_cells),
a{i} AS (SELECT *, coalesce(sum((x - m) * (y - m)) OVER (PARTITION BY radar, gate), 0) AS ac FROM g{i}),
o{i} AS (SELECT radar, t FROM a{i} GROUP BY 1, 2 HAVING count(*) FILTER (WHERE sd > 0 AND ac <> 0 AND abs(x - m) / sd > 1.2) > floor(0.25 * 24))"""


@query("noisy_times", "W7", sql("grid_cells", NOISY.format(i=1, x="z") + "," + NOISY.format(i=2, x="vel").strip()[1:] + """
SELECT radar, t FROM o1 UNION SELECT radar, t FROM o2"""))
def _(t):
    return W.noisy_times(t.grid_cells(), ["radar"], "t", "gate", ["z", "vel"], SLOT, threshold=1.2, fraction=0.25)


ROLL = """
, w AS (SELECT key, t, {v} AS x FROM {src}),
p AS (SELECT *, x * lead(x) OVER (PARTITION BY key ORDER BY t) AS p, lag(x) OVER (PARTITION BY key ORDER BY t) AS xa, lead(x) OVER (PARTITION BY key ORDER BY t) AS xb FROM w),
c AS (SELECT key, t, ((xa - (xa + x + xb) / 3) * (x - (xa + x + xb) / 3) + (x - (xa + x + xb) / 3) * (xb - (xa + x + xb) / 3)) / 2 AS ac FROM p WHERE xa + x + xb IS NOT NULL),
z AS (SELECT *, avg(ac) OVER (PARTITION BY key) AS m, stddev_pop(ac) OVER (PARTITION BY key) AS sd FROM c)
SELECT key, t FROM z WHERE abs(ac - m) > 2.5 * sd"""


@query("autocovariance_outliers", "W8", sql("steps", ROLL.format(v="v", src="steps")))
def _(t):
    return W.autocov_outliers_rolling(t.steps(), ["key"], "t", "v", STEP, 3).select("key", "t")


@query("autocovariance_outliers_detrended", "W8", sql("steps", UNI.replace("3 - i", "2 - i").replace("i + 2 - n", "i + 1 - n")
       .replace("2 PRECEDING AND 2 FOLLOWING", "1 PRECEDING AND 1 FOLLOWING") + ROLL.format(v="v - s / 3", src="u")))
def _(t):
    return W.autocov_outliers_rolling(_full(t), ["key"], "t", "v", STEP, 3, detrend=True).select("key", "t")


@query("vertical_gradient", "W9", sql("cells", """
, g AS (SELECT *, lag(z) OVER w AS zp, lead(z) OVER w AS zn, range - lag(range) OVER w AS h1, lead(range) OVER w - range AS h2 FROM cells
        WINDOW w AS (PARTITION BY radar, t ORDER BY range))
SELECT radar, t, range, round(CASE WHEN h1 IS NULL THEN (zn - z) / h2 WHEN h2 IS NULL THEN (z - zp) / h1
       ELSE (h1 * h1 * zn + (h2 * h2 - h1 * h1) * z - h2 * h2 * zp) / (h1 * h2 * (h1 + h2)) END + 1e-9, 6) + 0.0 AS dz FROM g"""))
def _(t):
    return W.gradient_range(t.cells(), ["radar"], "t", "range", "z", "dz").select("radar", "t", "range", r6(F.col("dz") + 1e-9).alias("dz"))


@query("time_gradient", "W9", sql("series", """
, g AS (SELECT *, lag(v) OVER w AS zp, lead(v) OVER w AS zn, t / 6e7 - lag(t) OVER w / 6e7 AS h1, lead(t) OVER w / 6e7 - t / 6e7 AS h2 FROM series
        WINDOW w AS (PARTITION BY key ORDER BY t))
SELECT key, t, round(CASE WHEN h1 IS NULL THEN (zn - v) / h2 WHEN h2 IS NULL THEN (v - zp) / h1
       ELSE (h1 * h1 * zn + (h2 * h2 - h1 * h1) * v - h2 * h2 * zp) / (h1 * h2 * (h1 + h2)) END + 1e-4, 1) + 0.0 AS dv FROM g"""))
def _(t):
    return W.gradient_time(t.series(), ["key"], "t", "v", "dv", MINUTE).select("key", "t", r6(F.col("dv") + 1e-4, 1).alias("dv"))


@query("ring_gradient", "W10", sql("scans", """
, r AS (SELECT *, first(disc) OVER a AS d0, last(disc) OVER a AS d1, first(gate) OVER a AS g0, last(gate) OVER a AS g1,
        lead(disc) OVER w AS dn, lag(disc) OVER w AS dp, lead(gate) OVER w AS gn, lag(gate) OVER w AS gp FROM scans
        WINDOW w AS (PARTITION BY scan ORDER BY gate), a AS (PARTITION BY scan ORDER BY gate ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT scan, gate, round((coalesce(dn, d0) - coalesce(dp, d1)) / nullif(coalesce(gn, g0) - coalesce(gp, g1), 0), 6) + 0.0 AS grad FROM r"""))
def _(t):
    out = W.roll_gradient(t.scans(), ["scan"], "gate", "disc", "grad")
    return out.select("scan", "gate", r6(F.col("grad")).alias("grad"))


@query("path_attenuation", "W11", sql("scans", """
SELECT scan, gate, round(2 * sum(disc) OVER w - disc, 6) AS pia, round(2 * sum(disc + tax) OVER w, 6) AS pia_total FROM scans
WINDOW w AS (PARTITION BY scan ORDER BY gate)"""))
def _(t):
    one = W.cum_attenuation(t.scans(), ["scan"], "gate", F.col("disc"))
    two = W.cum_attenuation(one, ["scan"], "gate", F.col("disc") + F.col("tax"), "pia_total", half_gate=False)
    return two.select("scan", "gate", r6(F.col("pia")).alias("pia"), r6(F.col("pia_total")).alias("pia_total"))


@query("hypsometric_heights", "W12", sql("scans", """
, p AS (SELECT scan, gate, 220 + qty AS temp, gate * 100.0 + disc * 900 AS p FROM scans),
d AS (SELECT *, coalesce(287.05 * temp * ln(lead(p) OVER (PARTITION BY scan ORDER BY gate) / p), 0) AS part FROM p)
SELECT scan, gate, round(sum(part) OVER (PARTITION BY scan ORDER BY gate DESC) / 9.80665, 4) AS height FROM d"""))
def _(t):
    p = t.scans().select("scan", "gate", (220 + F.col("qty")).alias("temp"), (F.col("gate") * 100.0 + F.col("disc") * 900).alias("p"))
    out = W.hypsometric(p, ["scan"], "gate", "temp", "p", 287.05, 9.80665)
    return out.select("scan", "gate", r6(F.col("height"), 4).alias("height"))


@query("hybrid_heights", "W12 J1", sql("scans corrections", """
, l AS (SELECT scan, gate, max(t) OVER (PARTITION BY scan) AS t, 220 + qty AS temp FROM scans),
k AS (SELECT gate, avg(gate) * 3.0 AS a, avg(gate) / 8.0 AS b FROM scans GROUP BY 1),
x AS (SELECT DISTINCT t FROM l),
y AS (SELECT x.t, c.t AS bt, c.corr AS bc FROM x ASOF LEFT JOIN corrections c ON x.t >= c.t),
n AS (SELECT y.*, c.t AS ft, c.corr AS fc FROM y ASOF LEFT JOIN corrections c ON y.t <= c.t),
s AS (SELECT t, CASE WHEN bt IS NULL OR (ft IS NOT NULL AND ft - t < t - bt) THEN fc ELSE bc END / 997.3 + 700 AS ps FROM n),
p AS (SELECT scan, gate, temp, a * 10.0 + b * ps AS p FROM l JOIN k USING (gate) JOIN s USING (t)),
d AS (SELECT *, coalesce(287.05 * temp * ln(lead(p) OVER (PARTITION BY scan ORDER BY gate) / p), 0) AS part FROM p)
SELECT scan, gate, round(p, 4) AS p, round(sum(part) OVER (PARTITION BY scan ORDER BY gate DESC) / 9.80665, 4) AS height FROM d"""))
def _(t):
    """Levels of each scan, coefficients per level, surface pressure from the nearest order day."""
    s = t.scans()
    last = s.groupBy("scan").agg(F.max("t").alias("t"))
    levels = s.select("scan", "gate", (220 + F.col("qty")).alias("temp")).join(last, "scan")
    coefficients = s.groupBy("gate").agg((F.avg("gate") * 3.0).alias("a"), (F.avg("gate") / 8.0).alias("b"))
    surface = t.corrections().select("t", (F.col("corr") / 997.3 + 700).alias("ps"))
    placed = W.hybrid_pressure(levels, coefficients, surface, "t", "gate", 10.0)
    out = W.hypsometric(placed, ["scan"], "gate", "temp", "p", 287.05, 9.80665)
    return out.select("scan", "gate", r6(F.col("p"), 4).alias("p"), r6(F.col("height"), 4).alias("height"))


@query("count_within_window", "W13", sql("series", """
SELECT key, t, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 1800000000 PRECEDING AND 1800000000 FOLLOWING) AS n_hour,
       count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING) AS n_day FROM series"""))
def _(t):
    return W.count_within(t.series(), ["key"], "t", {"n_hour": HOUR, "n_day": 24 * HOUR}).select("key", "t", "n_hour", "n_day")


@query("gap_markers", "W14", sql("series", """
, n AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t) - t AS d FROM series)
SELECT key, t, v FROM series UNION ALL SELECT key, t + 900000000, NULL FROM n WHERE d > 1800000000"""))
def _(t):
    return W.gap_marker(t.series(), ["key"], "t", "v", 30 * MINUTE)


@query("jump_filter", "W15 P10", sql("cells", """
, h AS (SELECT radar AS key, t, max(range) FILTER (WHERE vel > 0 AND range < 550) AS v FROM cells GROUP BY 1, 2)
SELECT key, t, CASE WHEN NOT (coalesce(abs(v - lag(v) OVER w) > 100, false) OR coalesce(abs(v - lead(v) OVER w) > 100, false)) THEN v END AS v
FROM h WINDOW w AS (PARTITION BY key ORDER BY t)"""))
def _(t):
    from skycolumn.operators.profiles import pbl_height
    tops = pbl_height(t.cells().withColumnRenamed("radar", "key"), ["key"], "t", "range", F.col("vel") > 0, 550.0, "v")
    return W.jump_filter(tops, ["key"], "t", "v", 100.0)


@query("first_per_time", "W16", sql("", """
SELECT l_returnflag AS key, epoch_us(l_shipdate) AS t, arg_min(l_extendedprice, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS price
FROM lineitem GROUP BY 1, 2"""))
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("key"), epoch_us(F.col("l_shipdate")).alias("t"),
                             F.col("l_extendedprice").alias("price"),
                             (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("o"))
    return W.dedup_time(rows, ["key"], "t", "o").select("key", "t", "price")


def _smooth_sql() -> str:
    h = W.savgol_weights(11, 3)
    lagged = lambda c, k: f"lead({c}, {k}) OVER w" if k >= 0 else f"lag({c}, {-k}) OVER w"
    num = " + ".join(f"coalesce({lagged('v', k)}, 0) * {1.0 / (abs(k) + 1)!r}::DOUBLE" for k in range(-5, 5))
    den = " + ".join(f"(CASE WHEN {lagged('v', k)} IS NOT NULL THEN {1.0 / (abs(k) + 1)!r}::DOUBLE ELSE 0 END)" for k in range(-5, 5))
    dot = lambda i: " + ".join(f"{lagged('f', j - i)} * ({float(h[i, j])!r}::DOUBLE)" for j in range(11))
    cases = " ".join(f"WHEN i = {i + 1} THEN {dot(i)} WHEN i = n - {i} THEN {dot(10 - i)}" for i in range(5))
    return sql("steps", f"""
, a AS (SELECT key, t, coalesce(v, ({num}) / nullif({den}, 0)) AS f, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS n
        FROM steps WINDOW w AS (PARTITION BY key ORDER BY t))
SELECT key, t, round(CASE {cases} ELSE {dot(5)} END, 6) AS smooth FROM a WINDOW w AS (PARTITION BY key ORDER BY t)""")


@query("gap_fill_and_smooth", "W17", _smooth_sql())
def _(t):
    return W.gap_interp_smooth(t.steps(), ["key"], "t", "v", STEP).select("key", "t", r6(F.col("smooth")).alias("smooth"))


@query("forward_backward_fill", "W18", sql("steps", """
SELECT key, t, last_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY t) AS ffill,
       last_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY t DESC) AS bfill FROM steps"""))
def _(t):
    return W.fill_gaps(t.steps(), ["key"], "t", "v").select("key", "t", "ffill", "bfill")


@query("lowest_error_per_day", "W19", """
SELECT epoch_us(d) AS day, o_orderkey, rmse FROM (SELECT o_orderdate AS d, o_orderkey, o_totalprice AS rmse,
       row_number() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(t):
    rows = t.orders.select(epoch_us(F.col("o_orderdate")).alias("day"), "o_orderkey", F.col("o_totalprice").alias("rmse"))
    return W.best_per_group(rows, ["day"], F.struct("rmse", "o_orderkey"))
