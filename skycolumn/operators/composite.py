"""Composite of several instruments on one grid: aligned once, then masked, corrected and compared as columns of one wide frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycolumn.functions.scalar import snr_mask
from skycolumn.operators.asof import add_corrected
from skycolumn.operators.profiles import cloudtop_generic
from skycolumn.operators.regrid import align_to_grid, gas_attenuation
from skycolumn.operators.windows import rolling_mean


def wide_frame(cells: DataFrame, grid: DataFrame, roles: DataFrame, instrument: str, t: str, gate: str, values: Sequence[str], step: int,
               names: Sequence[str], reference: str) -> DataFrame:
    """One row per grid cell of a target with ``<value>_<role>`` columns.

    ``roles`` (instrument, role, target) says for which target an instrument plays which role; it is a small table. All instruments are
    aligned in one step and meet in one aggregation, so a cell crosses the shuffle once per role and no instrument is joined with another.
    Only cells on the grid of the ``reference`` role stay.
    """
    aligned = align_to_grid(cells, grid, [instrument, gate], t, values, step)
    placed = aligned.join(roles, instrument)
    of = lambda name, value: F.max(F.when(F.col("role") == name, F.col(value)))
    wide = placed.groupBy("target", t, gate).agg(F.bool_or(F.col("role") == reference).alias("_there"),
                                                 *[of(name, v).alias(f"{v}_{name}") for name in names for v in values])
    return wide.filter("_there").drop("_there").withColumnRenamed("target", instrument)


def composite(wide: DataFrame, keys: Sequence[str], t: str, gate: str, height: str, reference: str, corrected: str, others: Sequence[str], snr_limit: float,
              field: DataFrame, frequency: float, station: float, steps: DataFrame, constant: float, top_limit: float, step: int,
              runs: int = 3, gap_gates: int = 3, smooth: int = 5) -> DataFrame:
    """Masked values, the ``corrected`` instrument with path attenuation, step corrections and its constant, the ratios of ``reference`` to all
    others, and the connected layer top of the reference with its running mean.

    ``wide`` has ``z_<role>`` and ``snr_<role>``; it is read several times and should be a stored table.
    """
    names = [reference, corrected, *others]
    rows = wide
    for name in names:
        rows = snr_mask(rows, [f"snr_{name}"], snr_limit, [f"z_{name}"])
    z, out = f"z_{corrected}", rows.drop(*[f"snr_{name}" for name in names])
    out = gas_attenuation(out, field, t, height, z, frequency, station, name="_z").drop(z).withColumnRenamed("_z", z)
    out = add_corrected(out, steps, t, [], z, "corr", "_z", constant=constant).drop(z, "corr").withColumnRenamed("_z", z)
    out = out.withColumns({f"dfr_{reference}_{name}": F.col(f"z_{reference}") - F.col(f"z_{name}") for name in (corrected, *others)})
    tops = cloudtop_generic(rows, [*keys, t], gate, height, F.col(f"z_{reference}") > top_limit, runs, gap_gates)
    tops = rolling_mean(tops, keys, t, "cloudtop", step, smooth, 1, name="cloudtop_smooth")
    return out.join(tops, [*keys, t])


def role_table(ring: DataFrame, instrument: str, following: str, names: Sequence[str]) -> DataFrame:
    """Roles around a ring of instruments: each is the first role's target, the one after it plays the second role, and so on."""
    here = ring.select(F.col(instrument).alias("target"), F.col(instrument).alias("_at"))
    out = None
    for name in names:
        rows = here.select(F.col("_at").alias(instrument), F.lit(name).alias("role"), "target")
        out = rows if out is None else out.unionByName(rows)
        here = here.join(ring.select(F.col(instrument).alias("_at"), F.col(following).alias("_next")), "_at").select("target", F.col("_next").alias("_at"))
    return out
