"""Queries of lookups and joins."""

from pyspark.sql import functions as F

from skycolumn.operators import asof as A
from skycolumn.operators import intervals as I
from skycolumn.operators import joins as J
from skycolumn.operators.ordered import DAY, HOUR, MINUTE, epoch_us
from skycolumn.plans.bindings import SLOT, STEP, r6, sql
from skycolumn.plans.registry import query

# every instrument's samples looked up among those of the next instrument
NEAREST = """
, r AS (SELECT before AS key, t, v FROM series JOIN ring USING (key)),
b AS (SELECT l.key, l.t, r.t AS bt, r.v AS bv FROM series l ASOF LEFT JOIN r ON l.key = r.key AND l.t >= r.t),
f AS (SELECT b.*, r.t AS ft, r.v AS fv FROM b ASOF LEFT JOIN r ON b.key = r.key AND b.t <= r.t),
n AS (SELECT key, t, CASE WHEN bt IS NULL OR ft - t < t - bt THEN ft ELSE bt END AS matched_t,
             CASE WHEN bt IS NULL OR ft - t < t - bt THEN fv ELSE bv END AS v FROM f)"""


def _two(t):
    s = t.series()
    return s.select("key", "t"), t.under_previous(s, "key").select("key", "t", "v")


@query("asof_nearest", "J1", sql("series ring", NEAREST + """
SELECT key, t, CASE WHEN abs(matched_t - t) <= 600000000 THEN matched_t END AS matched_t,
       CASE WHEN abs(matched_t - t) <= 600000000 THEN v END AS v FROM n"""))
def _(t):
    left, right = _two(t)
    return A.asof_nearest(left, right, "t", ["key"], ["v"], 10 * MINUTE)


@query("asof_step_function", "J2 C9", sql("corrections", """
SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity + c.corr / 1000 AS corrected
FROM lineitem l ASOF LEFT JOIN corrections c ON epoch_us(l.l_shipdate) >= c.t"""))
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                              F.col("l_partkey").alias("part"), "l_quantity", epoch_us(F.col("l_shipdate")).alias("t"))
    steps = t.corrections().withColumn("corr", F.col("corr") / 1000)
    return A.add_corrected(lines, steps, "t", [], "l_quantity", "corr", "corrected").select("id", "line", "part", "corrected")


@query("correction_nearest", "C14", sql("corrections", """
, l AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity AS q, epoch_us(l_shipdate) + 3600000000 AS t FROM lineitem),
b AS (SELECT l.*, c.t AS bt, c.corr AS bv FROM l ASOF LEFT JOIN corrections c ON l.t >= c.t),
f AS (SELECT b.*, c.t AS ft, c.corr AS fv FROM b ASOF LEFT JOIN corrections c ON b.t <= c.t),
n AS (SELECT *, CASE WHEN bt IS NULL OR ft - t < t - bt THEN ft ELSE bt END AS m,
                CASE WHEN bt IS NULL OR ft - t < t - bt THEN fv ELSE bv END AS v FROM f)
SELECT id, line, part, q + CASE WHEN abs(m - t) <= 86400000000 THEN v END AS zdr FROM n"""))
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                              F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q"),
                              (epoch_us(F.col("l_shipdate")) + HOUR).alias("t"))
    return (A.add_corrected(lines, t.corrections(), "t", [], "q", "corr", "zdr", "nearest", DAY)
            .select("id", "line", "part", "zdr"))


BANDS = {"Ka": "click", "W": "view", "X": "error", "C": "purchase", "S": "signup"}
PAIRS = [(a, b) for i, a in enumerate(BANDS) for b in list(BANDS)[i + 1:]]


@query("dual_frequency_ratio", "J5 S14", sql("cells", f"""
SELECT a.t, a.range, {', '.join(f"{b}.z AS z_{b}" for b in list(BANDS)[1:])}, {', '.join(f"{a if a != 'Ka' else 'a'}.z - {b}.z AS dfr_{a}_{b}" for a, b in PAIRS)}
FROM cells a {' '.join(f"LEFT JOIN cells {b} ON {b}.radar = '{BANDS[b]}' AND a.t = {b}.t AND a.range = {b}.range" for b in list(BANDS)[1:])} WHERE a.radar = 'click'"""))
def _(t):
    cells = t.cells()
    pick = lambda r: cells.filter(F.col("radar") == r).select("t", "range", F.col("z").alias("Z"))
    both = J.combine_radars({b: pick(r) for b, r in BANDS.items()}, "Ka", ["t", "range"])
    out = J.dual_frequency_ratio(both, "Z", PAIRS)
    return out.select("t", "range", *[F.col(f"Z_{b}").alias(f"z_{b}") for b in list(BANDS)[1:]], *[F.col(f"DFR_{a}{b}").alias(f"dfr_{a}_{b}") for a, b in PAIRS])


@query("shared_cell_difference", "J5 C1", sql("cells ring", """
SELECT a.radar, a.t, a.range, a.z - b.z AS dfr FROM cells a JOIN ring ON ring.before = a.radar JOIN cells b ON b.radar = ring.key AND a.t = b.t AND a.range = b.range"""))
def _(t):
    c = t.cells()
    return J.grid_equi_join(c, t.under_previous(c, "radar"), ["radar", "t", "range"], "z").select("radar", "t", "range", "dfr")


@query("near_event_flag", "J7", sql("series ring", NEAREST + """
SELECT key, t, coalesce(abs(matched_t - t) <= 300000000, false) AS near FROM n"""))
def _(t):
    left, right = _two(t)
    return A.near_event_flag(left, right, "t", ["key"], 10 * MINUTE)


@query("near_next_event_flag", "J7", sql("series ring", NEAREST + """
SELECT key, t, coalesce(ft - t <= 300000000, false) AS near FROM f"""))
def _(t):
    left, right = _two(t)
    return A.near_event_flag(left, right, "t", ["key"], 10 * MINUTE, side="next")


@query("temperature_band", "J8", sql("cells ring", """
, iso AS (SELECT before AS radar, t, min(range) + 50 AS lo, max(range) - 100 AS hi FROM cells JOIN ring ON ring.key = cells.radar GROUP BY 1, 2)
SELECT c.radar, c.t, c.range, c.z FROM cells c JOIN iso ON c.t = iso.t AND c.radar = iso.radar
WHERE c.range BETWEEN least(lo, hi) AND greatest(lo, hi)"""))
def _(t):
    c = t.cells()
    iso = t.under_previous(c, "radar").groupBy("radar", "t").agg((F.min("range") + 50).alias("lo"), (F.max("range") - 100).alias("hi"))
    return A.temperature_band(c, iso, "t", ["radar"], "range", "lo", "hi", 0).select("radar", "t", "range", "z")


@query("excluded_days", "J9", """
WITH ex AS (SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
d AS (SELECT l_shipdate AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT epoch_us(d) AS t, n, false AS excluded FROM d WHERE d NOT IN (SELECT d FROM ex)
UNION ALL SELECT epoch_us(d), n, true FROM d WHERE d IN (SELECT d FROM ex)""")
def _(t):
    ex = (t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
          .select(epoch_us(F.col("o_orderdate")).alias("t")).distinct())
    days = t.lineitem.groupBy(epoch_us(F.col("l_shipdate")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    kept, dropped = J.split_excluded(days, ex, ["t"])
    return kept.withColumn("excluded", F.lit(False)).union(dropped.withColumn("excluded", F.lit(True)))


@query("detection_sensitivity", "J10 A29", sql("grid_cells", """
, p AS (SELECT * FROM (VALUES (0.2, 2), (0.2, 4), (1.0, 2), (1.0, 4)) x(vel_limit, gates)),
w AS (SELECT radar AS key, t, CAST(vel_limit AS DOUBLE) AS vel_limit, gates, count(*) FILTER (WHERE vel < vel_limit) >= gates AS flag
      FROM grid_cells, p WHERE gate < 12 GROUP BY 1, 2, 3, 4),
c AS (SELECT *, CASE WHEN lag(flag) OVER w2 IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS ch FROM w
      WINDOW w2 AS (PARTITION BY key, vel_limit, gates ORDER BY t)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY key, vel_limit, gates ORDER BY t) AS id FROM c),
e AS (SELECT key, vel_limit, gates, min(t) AS s, max(t) AS e FROM g WHERE flag GROUP BY key, vel_limit, gates, id HAVING max(t) > min(t))
SELECT key, vel_limit, gates, count(*) AS events, round(avg((e - s) / 3600000000.0), 6) AS mean_hours,
       round(sum((e - s) / 3600000000.0), 6) AS total_hours FROM e GROUP BY 1, 2, 3"""))
def _(t):
    cells = t.grid_cells().filter("gate < 12").select(F.col("radar").alias("key"), "t", "vel")
    tried = J.with_params(cells, J.param_grid(vel_limit=[0.2, 1.0], gates=[2, 4]))
    keys = ["key", "vel_limit", "gates"]
    times = tried.groupBy(*keys, "t").agg((F.count_if(F.col("vel") < F.col("vel_limit")) >= F.col("gates")).alias("on"))
    events = I.mask_to_intervals(times, keys, "t", "on").filter(F.col("end") > F.col("start"))
    hours = (F.col("end") - F.col("start")) / 3600000000.0
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), r6(F.avg(hours)).alias("mean_hours"),
                                     r6(F.sum(hours)).alias("total_hours"))


@query("terrain_transect", "J11", """
WITH r AS (SELECT CAST(p_size AS BIGINT) AS rw, p_partkey % 40 AS cl, max(p_retailprice) AS elevation FROM part GROUP BY 1, 2),
p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CAST(floor(l_quantity * 1.2 - 3) AS BIGINT) AS rw,
             CAST(floor(l_tax * 500 + 0.5) AS BIGINT) AS cl FROM lineitem)
SELECT id, line, part, CASE WHEN p.rw BETWEEN 0 AND 50 AND p.cl BETWEEN 0 AND 39
       THEN CASE WHEN r.elevation IS NULL OR r.elevation = 900 THEN 0.0::DOUBLE ELSE r.elevation END END AS elevation
FROM p LEFT JOIN r ON p.rw = r.rw AND p.cl = r.cl""")
def _(t):
    raster = (t.part.groupBy(F.col("p_size").cast("long").alias("row"), (F.col("p_partkey") % 40).alias("col"))
              .agg(F.max("p_retailprice").alias("elevation")))
    line = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                             F.col("l_partkey").alias("part"), "l_quantity", "l_tax")
    out = J.dem_lookup(line, raster, F.col("l_quantity") * 1.2 - 3, F.col("l_tax") * 500 + 0.5, 51, 40, "elevation", 900.0)
    return out.select("id", "line", "part", "elevation")


@query("lagged_pairs", "J12", sql("series", """
SELECT a.key, count(*) AS pairs, CAST(sum(b.t - a.t) AS BIGINT) AS lag_sum, round(avg(abs(b.v - a.v)), 6) AS mean_step
FROM series a JOIN series b ON a.key = b.key AND b.t > a.t AND b.t <= a.t + 3600000000 GROUP BY 1"""))
def _(t):
    pairs = J.band_self_join(t.series(), ["key"], "t", HOUR, ["v"])
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("t2") - F.col("t")).alias("lag_sum"),
                                    r6(F.avg(F.abs(F.col("v2") - F.col("v")))).alias("mean_step"))


@query("set_operations", "2.13", """
WITH a AS (SELECT l_partkey AS id, l_linenumber AS n FROM lineitem), b AS (SELECT ps.l_partkey AS id, ps.l_linenumber + 1 AS n FROM lineitem ps WHERE l_linenumber < 5)
SELECT 'both' AS kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'first only', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'either', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def _(t):
    a = t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("n"))
    b = t.lineitem.filter("l_linenumber < 5").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") + 1).alias("n"))
    out = None
    for kind, how in (("both", "intersect"), ("first only", "except"), ("either", "union")):
        part = J.set_operation(how, a, b).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("strongest_samples", "2.13", sql("series", """
SELECT key, t, round(v, 6) AS v FROM series ORDER BY v DESC, key, t LIMIT 25"""))
def _(t):
    return J.top_n(t.series(), 25, F.desc("v"), F.asc("key"), F.asc("t")).select("key", "t", r6(F.col("v")).alias("v"))
