"""Logical tables (series, cells, scans, spectra, steps) bound to the given parquet tables.

Every binding exists twice: as a DataFrame and as the SQL of the same name in ``CTE``. Values are
built from integer sums of cents, so both engines start from identical doubles; the odd divisors keep
results away from decimal rounding ties.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycolumn.operators.ordered import HOUR, epoch_us, floor_div
from skycolumn.operators.regrid import make_time_grid

SLOT = 6 * HOUR          # time step of the bound cells
GATES = 24               # gates of the bound cells, 25 m apart
STEP = 10 * 60 * 1_000_000

CTE = {
    # one irregular series per event type
    "series": """series AS (
        SELECT event_type AS key, epoch_us(ts) AS t, arg_min(value, event_id) AS v
        FROM events GROUP BY 1, 2)""",
    # sparse time x range cells per instrument
    "cells": f"""cells AS (
        SELECT radar, slot * {SLOT} AS t, gate, CAST((gate + 1) * 25 AS DOUBLE) AS range,
               CAST(cents AS DOUBLE) / n / 397.3 - 60.0 AS z,
               CAST(cents % 1000 AS DOUBLE) / 197.3 - 2.5 AS vel,
               CAST((slot % 40) * 10 - gate * 16 AS DOUBLE) / 9.7 - 10.0 AS temp
        FROM (SELECT event_type AS radar, epoch_us(ts) // {SLOT} AS slot, user_id % {GATES} AS gate,
                     CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n
              FROM events GROUP BY 1, 2, 3))""",
    # the same cells on the complete grid, missing cells are NULL
    "grid_cells": f"""grid_cells AS (
        SELECT s.radar, s.t, r.gate, CAST((r.gate + 1) * 25 AS DOUBLE) AS range, c.z, c.vel, c.temp
        FROM (SELECT radar, unnest(generate_series(min(t), max(t), {SLOT})) AS t FROM cells GROUP BY 1) s
             CROSS JOIN (SELECT unnest(generate_series(0, {GATES} - 1)) AS gate) r
             LEFT JOIN cells c ON c.radar = s.radar AND c.t = s.t AND c.gate = r.gate)""",
    # regular 10-minute series: mean of the samples of each step, empty steps are NULL
    "steps": f"""steps AS (
        SELECT g.key, g.t, CAST(s.cents AS DOUBLE) / s.n / 100.0 AS v
        FROM (SELECT key, unnest(generate_series(lo, hi, {STEP})) AS t
              FROM (SELECT event_type AS key, min(epoch_us(ts)) // {STEP} * {STEP} AS lo,
                           max(epoch_us(ts)) // {STEP} * {STEP} AS hi FROM events GROUP BY 1)) g
        LEFT JOIN (SELECT event_type AS key, epoch_us(ts) // {STEP} * {STEP} AS t,
                          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n
                   FROM events GROUP BY 1, 2) s ON s.key = g.key AND s.t = g.t)""",
    # each instrument and the one before it in a ring, so that every instrument meets the next one
    "ring": """ring AS (
        SELECT key, coalesce(lag(key) OVER (ORDER BY key), max(key) OVER ()) AS before FROM (SELECT DISTINCT event_type AS key FROM events))""",
    # step function of corrections: one per order day, smallest order id of the day
    "corrections": """corrections AS (
        SELECT epoch_us(o_orderdate) AS t, arg_min(o_totalprice, o_orderkey) AS corr
        FROM orders GROUP BY 1)""",
    # scan rows: one per (scan, gate), the cheapest line of duplicates
    "scans": """scans AS (
        SELECT l_orderkey AS scan, l_linenumber AS gate,
               arg_min(l_quantity, l_extendedprice) AS qty, min(l_extendedprice) AS price,
               arg_min(l_discount, l_extendedprice) AS disc, arg_min(l_tax, l_extendedprice) AS tax,
               arg_min(epoch_us(l_shipdate), l_extendedprice) AS t
        FROM lineitem GROUP BY 1, 2)""",
    # spectra: positive power per bin
    "spectra": """spectra AS (
        SELECT vec_id, label, list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)) + 1e-3) AS power
        FROM embeddings)""",
    # two instruments observing the same target
    "pairs": """pairs AS (
        SELECT l_orderkey AS id, l_linenumber AS line, date_trunc('month', l_shipdate) AS month,
               l_quantity - 35.0 AS a,
               l_quantity - 35.0 + l_discount * 40.0 - 2.0 + CAST(l_partkey % 7 AS DOUBLE) / 4.0 AS b
        FROM lineitem)""",
}
_NEEDS = {"grid_cells": ("cells",)}


def sql(names: str, body: str) -> str:
    """``body`` with the named bindings in front, dependencies first."""
    ordered: list[str] = []
    for name in names.split():
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    ctes = [CTE[n] for n in ordered]
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, text[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + text


def r6(col: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def cents(value: str) -> Column:
    return F.sum(F.round(F.col(value) * 100).cast("long"))


class Tables:
    """The parquet tables of one folder and the logical tables bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def path(self, name: str) -> str:
        return os.path.join(self.dir, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def series(self) -> DataFrame:
        return (self.events.select(F.col("event_type").alias("key"), epoch_us(F.col("ts")).alias("t"),
                                   "event_id", "value")
                .groupBy("key", "t").agg(F.min_by("value", "event_id").alias("v")))

    def cells(self) -> DataFrame:
        gate = F.pmod("user_id", F.lit(GATES))
        sums = (self.events.groupBy(F.col("event_type").alias("radar"),
                                    floor_div(epoch_us(F.col("ts")), SLOT).alias("slot"), gate.alias("gate"))
                .agg(cents("value").alias("cents"), F.count(F.lit(1)).alias("n")))
        total = F.col("cents").cast("double")
        return sums.select(
            "radar", (F.col("slot") * SLOT).alias("t"), "gate",
            ((F.col("gate") + 1) * 25).cast("double").alias("range"),
            (total / F.col("n") / 397.3 - 60.0).alias("z"),
            ((F.col("cents") % 1000).cast("double") / 197.3 - 2.5).alias("vel"),
            (((F.col("slot") % 40) * 10 - F.col("gate") * 16).cast("double") / 9.7 - 10.0).alias("temp"))

    def grid_cells(self) -> DataFrame:
        cells = self.cells()
        bounds = cells.groupBy("radar").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        grid = (make_time_grid(bounds, "t", "lo", "hi", SLOT)
                .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GATES - 1).cast("long"))).alias("gate"))
                .withColumn("range", ((F.col("gate") + 1) * 25).cast("double")))
        return grid.join(cells.drop("range"), ["radar", "t", "gate"], "left")

    def steps(self) -> DataFrame:
        slot = (floor_div(epoch_us(F.col("ts")), STEP) * STEP).alias("t")
        means = (self.events.groupBy(F.col("event_type").alias("key"), slot)
                 .agg(cents("value").alias("c"), F.count(F.lit(1)).alias("n"))
                 .select("key", "t", (F.col("c").cast("double") / F.col("n") / 100.0).alias("v")))
        bounds = means.groupBy("key").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        grid = make_time_grid(bounds, "t", "lo", "hi", STEP)
        return grid.join(means, ["key", "t"], "left")

    def ring(self, key: str) -> DataFrame:
        """(instrument, before): a ring of all instruments, a handful of rows."""
        names = self.events.select(F.col("event_type").alias(key)).distinct()
        ordered, every = Window.orderBy(key), Window.partitionBy()
        return names.select(key, F.coalesce(F.lag(key).over(ordered), F.max(key).over(every)).alias("before"))

    def under_previous(self, df: DataFrame, key: str) -> DataFrame:
        """Every row under the instrument before its own, so that each instrument meets the next one."""
        return df.join(self.ring(key), key).drop(key).withColumnRenamed("before", key)

    def corrections(self) -> DataFrame:
        return (self.orders.groupBy(epoch_us(F.col("o_orderdate")).alias("t"))
                .agg(F.min_by("o_totalprice", "o_orderkey").alias("corr")))

    def scans(self) -> DataFrame:
        line = F.struct(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"),
                        F.col("l_tax").alias("tax"), epoch_us(F.col("l_shipdate")).alias("t"))
        return (self.lineitem.groupBy(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("gate"))
                .agg(F.min_by(line, F.col("l_extendedprice")).alias("_l")).select("scan", "gate", "_l.*"))

    def spectra(self) -> DataFrame:
        power = F.transform("embedding", lambda e: F.abs(e.cast("double")) + 1e-3)
        return self.embeddings.select("vec_id", "label", power.alias("power"))

    def pairs(self) -> DataFrame:
        a = F.col("l_quantity") - 35.0
        return self.lineitem.select(
            F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
            F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), a.alias("a"),
            (a + F.col("l_discount") * 40.0 - 2.0
             + (F.col("l_partkey") % 7).cast("double") / 4.0).alias("b"))
