"""Queries of the scan-bias job, spectra and classification."""

from pyspark.sql import functions as F

from skycolumn.functions import spectra as G
from skycolumn.operators import classify as K
from skycolumn.operators import zdr as B
from skycolumn.operators.ordered import HOUR
from skycolumn.plans.bindings import STEP, r6, sql
from skycolumn.plans.registry import query

POINTS = """WITH pts AS (SELECT l_suppkey * 600 AS t, CAST((l_partkey % 40) * 75 AS DOUBLE) AS r, CAST((l_orderkey % 6) * 60 AS DOUBLE) AS az,
  l_discount * 10 - 0.5 AS zdr, l_quantity AS zh, 0.92 + l_tax AS rhohv, l_quantity - 2 AS snr_h, l_extendedprice / 5000 AS snrv FROM lineitem)"""


def points(t):
    c = F.col
    return t.lineitem.select(
        (c("l_suppkey") * 600).alias("t"), ((c("l_partkey") % 40) * 75).cast("double").alias("r"),
        ((c("l_orderkey") % 6) * 60).cast("double").alias("az"), (c("l_discount") * 10 - 0.5).alias("zdr"),
        c("l_quantity").alias("zh"), (0.92 + c("l_tax")).alias("rhohv"), (c("l_quantity") - 2).alias("snr_h"),
        (c("l_extendedprice") / 5000).alias("snrv"))


RAYS = """WITH rays AS (SELECT l_suppkey % 400 AS scan, l_suppkey % 400 * 1000 + l_orderkey % 20 AS t, l_partkey % 10 AS gate,
  CAST(min(l_orderkey % 20) * 18 AS DOUBLE) AS az, min(l_discount) AS zdr, max(l_quantity) AS zh, CASE WHEN min(l_tax) > 0.07 THEN 999.0 ELSE 0.9 + min(l_tax) END AS rhohv,
  max(l_quantity) - 2 AS snr_h, max(l_extendedprice) / 5000 AS snrv FROM lineitem GROUP BY 1, 2, 3)"""


def rays(t):
    c = F.col
    scan = c("l_suppkey") % 400
    return t.lineitem.groupBy(scan.alias("scan"), (scan * 1000 + c("l_orderkey") % 20).alias("t"), (c("l_partkey") % 10).alias("gate")).agg(
        (F.min(c("l_orderkey") % 20) * 18).cast("double").alias("az"), F.min("l_discount").alias("zdr"), F.max("l_quantity").alias("zh"),
        F.when(F.min("l_tax") > 0.07, 999.0).otherwise(0.9 + F.min("l_tax")).alias("rhohv"),
        (F.max("l_quantity") - 2).alias("snr_h"), (F.max("l_extendedprice") / 5000).alias("snrv"))


@query("bias_points", "B1 A21 F9 S13", RAYS + """,
pr AS (SELECT DISTINCT scan, t, az FROM rays),
st AS (SELECT *, coalesce(lead(az) OVER w - az, az - lag(az) OVER w) AS s, count(*) OVER (PARTITION BY scan) AS n FROM pr WINDOW w AS (PARTITION BY scan ORDER BY t)),
mv AS (SELECT scan, t FROM st WHERE abs(s - 360 * CAST(s > 300 AS INT)) > 0.25 * 360.0 / n),
c AS (SELECT scan, t, gate, az, -zdr + 0.5 AS zdr, zh, CASE WHEN abs(rhohv) > 998 THEN NULL ELSE rhohv END AS rhohv, snr_h, snrv FROM rays SEMI JOIN mv USING (scan, t)),
q AS (SELECT scan, gate FROM c JOIN (SELECT scan, count(DISTINCT t) AS rays FROM c GROUP BY 1) USING (scan) GROUP BY scan, gate, rays
      HAVING count(zdr) >= 0.5 * rays AND count(zh) >= 0.5 * rays AND count(rhohv) >= 0.5 * rays AND count(snr_h) >= 0.5 * rays AND count(snrv) >= 0.5 * rays),
k AS (SELECT * FROM c SEMI JOIN q USING (scan, gate)), i AS (SELECT scan, row_number() OVER (ORDER BY min(t), scan) AS idx FROM k GROUP BY 1)
SELECT idx, t, gate, az, round(zdr, 6) AS zdr, zh, round(rhohv, 6) AS rhohv FROM k JOIN i USING (scan)""")
def _(t):
    out = B.build_points(rays(t), "scan", "gate", 0.5, share=0.5)
    return out.select("idx", "t", "gate", "az", r6(F.col("zdr")).alias("zdr"), "zh", r6(F.col("rhohv")).alias("rhohv"))


@query("complete_scan_gates", "A21", RAYS + """,
n AS (SELECT scan, count(DISTINCT t) AS rays FROM rays GROUP BY 1)
SELECT scan, gate FROM rays JOIN n USING (scan) GROUP BY scan, gate, rays HAVING count(zdr) >= 0.3 * rays AND count(zh) >= 0.3 * rays AND count(rhohv) >= 0.3 * rays
   AND count(snr_h) >= 0.3 * rays AND count(snrv) >= 0.3 * rays""")
def _(t):
    return B.scan_quality(rays(t), "scan", "gate", share=0.3)


MLF = """,
u AS (SELECT t, count(DISTINCT az) AS num_unique_az FROM pts GROUP BY 1),
f AS (SELECT pts.*, num_unique_az FROM pts JOIN u USING (t) WHERE snr_h > 5 AND snrv > 5 AND rhohv > 0.95
      AND (least(greatest(zh, 10.0), 60.0) - 10.0) / 50.0 * (1 - (least(greatest(rhohv, 0.65), 1.0) - 0.65) / (1.0 - 0.65)) < 0.05)"""


@query("rain_points", "B2 F16", POINTS + MLF + """ SELECT t, r, az, round(zdr, 6) AS zdr, num_unique_az, count(*) AS n FROM f GROUP BY t, r, az, zdr, num_unique_az""")
def _(t):
    out = B.ml_filter(points(t), 0.05)
    return out.groupBy("t", "r", "az", "zdr", "num_unique_az").agg(F.count(F.lit(1)).alias("n")).select("t", "r", "az", r6(F.col("zdr")).alias("zdr"), "num_unique_az", "n")


@query("complete_gates", "B3", POINTS + MLF + """,
g AS (SELECT t, r FROM f GROUP BY 1, 2 HAVING count(*) = max(num_unique_az))
SELECT t, r, count(*) AS n, round(sum(zdr), 4) AS zdr FROM f SEMI JOIN g USING (t, r) GROUP BY 1, 2""")
def _(t):
    kept = B.gate_complete_filter(B.ml_filter(points(t), 0.05))
    return kept.groupBy("t", "r").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("zdr"), 4).alias("zdr"))


RANGE = """,
h AS (SELECT max(r) - (max(r) - min(r)) / 2 AS half FROM pts), m AS (SELECT quantile_cont(zdr, 0.5) AS med FROM pts, h WHERE r >= half),
g AS (SELECT r, count(*) AS n, quantile_cont(zdr, 0.5) AS med, quantile_cont(zdr, 0.75) - quantile_cont(zdr, 0.25) AS iqr, quantile_cont(zdr, 0.05) AS q05,
      quantile_cont(zdr, 0.95) AS q95, min(zdr) AS lo, max(zdr) AS hi FROM pts WHERE rhohv > 0.95 AND snr_h > 5 GROUP BY 1)"""


@query("bias_by_range", "A22 W10", POINTS + RANGE + """
SELECT r, n, round(g.med, 6) AS med, round(iqr, 6) AS iqr, round(q05 - m.med, 6) AS bias_q05, round(q95 - m.med, 6) AS bias_q95, round(lo - m.med, 6) AS bias_min,
       round(hi - m.med, 6) AS bias_max FROM g, m""")
def _(t):
    out = B.zdr_range_stats(points(t))
    return out.select("r", "n", *[r6(F.col(c)).alias(c) for c in ("med", "iqr", "bias_q05", "bias_q95", "bias_min", "bias_max")])


@query("bias_region", "B4 I13", POINTS + RANGE + """,
a AS (SELECT *, g.med - m.med AS bm, g.med AS gm FROM g, m),
b AS (SELECT *, (coalesce(lead(bm) OVER w, first(bm) OVER al) - coalesce(lag(bm) OVER w, last(bm) OVER al)) / nullif(coalesce(lead(r) OVER w, first(r) OVER al) - coalesce(lag(r) OVER w, last(r) OVER al), 0) AS grad
      FROM a WINDOW w AS (ORDER BY r), al AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, coalesce(n > 100 AND abs(grad) < 0.0012 AND r > 300, false) AS ok FROM b),
c2 AS (SELECT *, sum(ch) OVER (ORDER BY r) AS id FROM (SELECT *, CASE WHEN lag(ok) OVER (ORDER BY r) IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END AS ch FROM c)),
c3 AS (SELECT id FROM c2 WHERE ok GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 1),
d AS (SELECT * FROM c2 SEMI JOIN c3 USING (id)),
e AS (SELECT max(r) AS top, max(r) - (max(r) - min(r)) / 2 AS half FROM d),
u AS (SELECT quantile_cont(iqr, 0.5) AS usual FROM d, e WHERE r >= CASE WHEN top - half < 1000 THEN top - 1000 ELSE half END),
k AS (SELECT r, n, gm, iqr, abs(iqr - usual) <= 0.6 AS ok FROM d, u),
k2 AS (SELECT *, sum(ch) OVER (ORDER BY r) AS id FROM (SELECT *, CASE WHEN lag(ok) OVER (ORDER BY r) IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END AS ch FROM k)),
k3 AS (SELECT id FROM k2 WHERE ok GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 1)
SELECT r, n, round(gm, 6) AS med, round(iqr, 6) AS iqr FROM k2 SEMI JOIN k3 USING (id)""")
def _(t):
    out = B.region_select(B.zdr_range_stats(points(t)), [], 100, 0.0012, 300.0, 0.6)
    return out.select("r", "n", r6(F.col("med")).alias("med"), r6(F.col("iqr")).alias("iqr"))


TIME = """,
s AS (SELECT t, count(*) AS n, quantile_cont(zdr, 0.05) AS q05, quantile_cont(zdr, 0.5) AS median, quantile_cont(zdr, 0.95) AS q95 FROM pts GROUP BY 1)"""


@query("bias_by_scan", "A23", POINTS + TIME + """ SELECT t, n, round(q05, 6) AS q05, round(median, 6) AS median, round(q95, 6) AS q95 FROM s""")
def _(t):
    out = B.zdr_time_stats(points(t))
    return out.select("t", "n", *[r6(F.col(c)).alias(c) for c in ("q05", "median", "q95")])


@query("bias_scan_selection", "B5 W13", POINTS + TIME + """,
w AS (SELECT *, count(*) OVER (ORDER BY t RANGE BETWEEN 1800 PRECEDING AND 1800 FOLLOWING) AS n_hour, count(*) OVER (ORDER BY t RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS n_day FROM s)
SELECT t, n, n_hour, n_day FROM w WHERE n_hour >= 5 AND n_day >= 80 AND n > 100""")
def _(t):
    stats = points(t).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return B.time_select(stats, 3600, per_hour=5, per_day=80).select("t", "n", "n_hour", "n_day")


@query("variogram_models", "B7", """
SELECT event_id, round(0.1 + CASE WHEN value > 60 THEN 2.0 ELSE 2.0 * (1.5 * value / 60 - 0.5 * pow(value / 60, 3)) END, 6) AS spherical,
 round(0.1 + CASE WHEN value > 20 THEN 1.0 ELSE 1.0 * (1.5 * value / 20 - 0.5 * pow(value / 20, 3)) END + CASE WHEN value > 90 THEN 2.0 ELSE 2.0 * (1.5 * value / 90 - 0.5 * pow(value / 90, 3)) END, 6) AS double_spherical,
 round(0.2 + 3.0 * (1 - exp(-pow(value / (50 / 1.7), 2))) + 1.5 * (1 - exp(-value / (30 / 3.0))), 6) AS mixed FROM events""")
def _(t):
    x = F.col("value")
    return t.events.select("event_id", r6(B.variogram_model(["spherical"], [60, 2, 0.1], x)).alias("spherical"),
                           r6(B.variogram_model(["spherical", "spherical"], [20, 1, 90, 2, 0.1], x)).alias("double_spherical"),
                           r6(B.variogram_model(["gaussian", "exponential"], [50, 3, 30, 1.5, 0.2], x)).alias("mixed"))


@query("kriged_corrections", "B8")
def _(t):
    obs = t.series()
    targets = t.steps().select("t")
    out = B.krige_scans(obs, targets, "t", "v", ["spherical"], [120.0, 400.0, 900.0], 2 * HOUR, STEP, 60e6)
    return out.select("t", r6(F.col("correction")).alias("correction"), r6(F.col("std")).alias("std"))


HS = """
, x AS (SELECT vec_id, unnest(power) AS p FROM spectra),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p) AS k FROM x),
r AS (SELECT *, sum(p) OVER w / k AS m, sum(p * p) OVER w / k AS q FROM o WINDOW w AS (PARTITION BY vec_id ORDER BY p, k ROWS UNBOUNDED PRECEDING)),
v AS (SELECT vec_id, k, m, q - m * m AS var, (q - m * m) / (m * m + 1e-12) < 1 / 4.0 AS quiet FROM r),
hs AS (SELECT vec_id, coalesce(arg_max(m, k) FILTER (WHERE quiet), arg_max(m, k)) AS level, sqrt(greatest(coalesce(arg_max(var, k) FILTER (WHERE quiet), arg_max(var, k)), 0)) AS spread FROM v GROUP BY 1)"""


@query("spectral_noise", "G1", sql("spectra", HS + " SELECT vec_id, round(level, 6) AS level, round(spread, 6) AS spread FROM hs"))
def _(t):
    out = t.spectra().select("vec_id", G.hs_noise(F.col("power"), 4.0).alias("n"))
    return out.select("vec_id", r6(F.col("n.level")).alias("level"), r6(F.col("n.spread")).alias("spread"))


@query("noise_filtered_spectra", "G2", sql("spectra", HS + """
SELECT vec_id, count(*) FILTER (WHERE p > level + 2 * spread) AS bins, round(sum(p - level) FILTER (WHERE p > level + 2 * spread), 6) AS power
FROM x JOIN hs USING (vec_id) GROUP BY 1"""))
def _(t):
    out = t.spectra().withColumn("n", G.hs_noise(F.col("power"), 4.0))
    kept = F.filter(G.noise_filter(F.col("power"), F.col("n"), 2.0, subtract=True), lambda v: v.isNotNull())
    total = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v))
    return out.select("vec_id", F.size(kept).cast("long").alias("bins"), r6(total).alias("power"))


@query("quantile_filtered_spectra", "G3", sql("spectra", """
, x AS (SELECT vec_id, unnest(power) AS p FROM spectra), q AS (SELECT vec_id, quantile_cont(p, 0.1) AS lim FROM x GROUP BY 1)
SELECT vec_id, round(min(lim), 6) AS lim, count(*) FILTER (WHERE p > lim) AS bins FROM x JOIN q USING (vec_id) GROUP BY 1"""))
def _(t):
    kept = F.filter(G.quantile_filter(F.col("power"), F.col("power")), lambda v: v.isNotNull())
    return t.spectra().select("vec_id", r6(G.array_quantile(F.col("power"), 0.1)).alias("lim"), F.size(kept).cast("long").alias("bins"))


@query("ordered_spectra", "G4", sql("spectra", """
, x AS (SELECT vec_id, power, list_reverse(power) AS f FROM spectra)
SELECT vec_id, round(f[1], 6) AS first, round(f[64], 6) AS last, round(power[33], 6) AS lowest, round(power[32], 6) AS highest FROM x"""))
def _(t):
    # velocities run 0..31, -32..-1: the order in which a transform delivers them
    v = F.concat(F.sequence(F.lit(0), F.lit(31)), F.sequence(F.lit(-32), F.lit(-1)))
    s = t.spectra().select("vec_id", G.flip_doppler(F.col("power")).alias("f"), G.sort_doppler(v, F.col("power")).alias("s"))
    at = lambda c, i, n: r6(F.element_at(c, i)).alias(n)
    return s.select("vec_id", at("f", 1, "first"), at("f", -1, "last"), at("s", 1, "lowest"), at("s", -1, "highest"))


@query("nearest_spectrum", "G5", sql("spectra", """
SELECT vec_id, label, round(list_sum(power), 6) AS total FROM spectra ORDER BY abs(vec_id - 123), vec_id, abs(label - 4), label LIMIT 1"""))
def _(t):
    out = G.spectrum_pick(t.spectra(), "vec_id", "label", 123, 4.0)
    return out.select("vec_id", "label", r6(F.aggregate("power", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("signal_flags", "G6", sql("spectra", """
SELECT vec_id, len(list_filter(power, lambda x: 10 * log10(x) > -8)) / 64.0 >= 0.2 AS signal FROM spectra"""))
def _(t):
    from skycolumn.functions.scalar import to_db
    return t.spectra().select("vec_id", G.has_signal(F.transform("power", to_db), -8.0, 0.2).alias("signal"))


@query("primary_peaks", "G7", sql("scans", """
SELECT scan, max(qty) FILTER (WHERE gate = 1) AS "primary", max(qty) FILTER (WHERE gate <> 1) AS others FROM scans GROUP BY 1"""))
def _(t):
    nodes = t.scans().withColumn("node", F.col("gate") - 1)
    return G.primary_node(nodes, "node", ["scan"], "qty")


@query("recomputed_snr", "G8 A10", sql("series", f"""
, a AS (SELECT key, (t + 300000000) // {STEP} * {STEP} AS t, avg(v - 40) AS s FROM series GROUP BY 1, 2),
b AS (SELECT key, t, CASE WHEN s > 0 THEN 10 * log10(s) END AS snr FROM a)
SELECT key, t, round(CASE WHEN snr BETWEEN -40 AND 70 THEN snr END, 6) + 0.0 AS snr FROM b"""))
def _(t):
    s = t.series().select("key", "t", (F.col("v") - 40).alias("snr"))
    out = G.recompute_snr(s, ["key"], "t", "snr", STEP, STEP // 10, STEP // 2)
    return out.select("key", "t", r6(F.col("snr")).alias("snr"))


@query("spectral_reflectivity", "F15", sql("spectra", """
SELECT vec_id, CAST(i AS INT) AS bin, round((power[i] - 0.01) * ((label + 1) * 3.0 * pow((vec_id % 100 + 1) * 30 / 5000.0, 2) * 1.1 / 64), 9) AS ka,
       round(10 * log10(power[i] * ((vec_id % 100 + 1) * 30.0) * ((vec_id % 100 + 1) * 30.0)), 6) AS x, round(power[i] / power[65 - i], 6) AS ldr
FROM spectra, (SELECT unnest(generate_series(1, 64)) AS i)"""))
def _(t):
    rng = (F.col("vec_id") % 100 + 1) * 30.0
    ka = G.spectral_z_ka(F.col("power"), F.lit(0.01), (F.col("label") + 1) * 3.0, rng, F.lit(1.1), F.lit(64))
    s = t.spectra().select("vec_id", ka.alias("ka"), G.spectral_z_x(F.col("power"), rng).alias("x"),
                           G.spectral_ldr(F.col("power"), F.reverse("power")).alias("ldr"))
    rows = s.select("vec_id", F.posexplode(F.arrays_zip("ka", "x", "ldr")).alias("pos", "v"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("bin"), r6(F.col("v.ka"), 9).alias("ka"), r6(F.col("v.x")).alias("x"), r6(F.col("v.ldr")).alias("ldr"))


CLASSES = [("c1", (5.0, 0.00, 20000.0)), ("c2", (12.0, 0.02, 30000.0)), ("c3", (18.0, 0.04, 40000.0)), ("c4", (22.0, 0.05, 50000.0)),
           ("c5", (28.0, 0.06, 60000.0)), ("c6", (33.0, 0.03, 70000.0)), ("c7", (38.0, 0.08, 45000.0)), ("c8", (44.0, 0.10, 80000.0)), ("c9", (48.0, 0.01, 90000.0))]
_D = [f"sqrt(pow((qty - {a}) / 10.0, 2) + pow((disc - {b}) / 0.03, 2) + pow((price - {c}) / 20011.0, 2))" for _, (a, b, c) in CLASSES]


@query("gate_classes", "K1", sql("scans", f"""
, u AS (SELECT * FROM scans WHERE qty >= 3 AND 0.9 - tax >= 0.85), d AS (SELECT scan, gate, [{', '.join(_D)}] AS d FROM u),
w AS (SELECT *, list_transform(d, lambda x: 1.0::DOUBLE / greatest(x * x, 1e-12)) AS w FROM d),
s AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p FROM w)
SELECT scan, gate, 'c' || CAST(list_position(d, list_min(d)) AS VARCHAR) AS hydro_class, round(list_min(d), 6) AS distance, round(list_max(p), 6) AS share,
       round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(9), 6) AS entropy FROM s"""))
def _(t):
    cells = t.scans().withColumns({"snr": F.col("qty") - 13, "rhohv": 0.9 - F.col("tax")}).filter(F.col("rhohv") >= 0.85)
    out = K.hydro_classify(K.usable_gates(cells, "snr", "rhohv"), ["qty", "disc", "price"], CLASSES, [10.0, 0.03, 20011.0])
    return out.select("scan", "gate", "hydro_class", r6(F.col("distance")).alias("distance"), r6(F.array_max("shares")).alias("share"), r6(F.col("entropy")).alias("entropy"))


@query("valid_profiles", "K2", sql("grid_cells", """
SELECT radar, t, bool_or(coalesce(z > -50, false)) AS any_valid, bool_and(coalesce(z > -50, false)) AS all_valid FROM grid_cells GROUP BY 1, 2"""))
def _(t):
    return K.profile_flags(t.grid_cells(), ["radar", "t"], F.col("z") > -50)
