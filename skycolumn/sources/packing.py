"""Quantised storage: integer width, scale, offset and fill per variable."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.specs import VariableSpec

# unsigned width -> (largest code, Spark type that holds it)
_WIDTHS = ((8, 255, "short"), (16, 65535, "int"), (32, 4294967295, "long"))


@dataclass(frozen=True)
class Packing:
    scale: float
    offset: float
    fill: int
    bits: int
    spark_type: str
    vmin: float
    vmax: float


def packing_spec(specs: Iterable[VariableSpec]) -> dict[str, Packing]:
    """Smallest width that holds every level; the largest code is the fill value."""
    out = {}
    for s in specs:
        if s.flag or s.precision is None:
            continue
        levels = math.ceil((s.vmax - s.vmin) / s.precision) + 1
        bits, fill, kind = next(w for w in _WIDTHS if levels <= w[1] + 1)
        out[s.name] = Packing(s.precision, s.vmin, fill, bits, kind, s.vmin, s.vmax)
    return out


def pack_column(x: Column, p: Packing) -> Column:
    clipped = F.least(F.greatest(x, F.lit(p.vmin)), F.lit(p.vmax))
    code = F.bround((clipped - p.offset) / p.scale)
    bounded = F.least(F.greatest(code, F.lit(0.0)), F.lit(float(p.fill - 1)))
    return F.when(x.isNull() | F.isnan(x), p.fill).otherwise(bounded).cast(p.spark_type)


def unpack_column(code: Column, p: Packing) -> Column:
    """The fill code is missing; it is tested before scaling."""
    return F.when(code != p.fill, code * p.scale + p.offset)


def pack(df: DataFrame, spec: Mapping[str, Packing]) -> DataFrame:
    """Packed variables; missing flags become False."""
    out = {c: pack_column(F.col(c), spec[c]) for c in df.columns if c in spec}
    out |= {f.name: F.coalesce(F.col(f.name), F.lit(False)) for f in df.schema if f.dataType.typeName() == "boolean"}
    return df.withColumns(out)


def unpack(df: DataFrame, spec: Mapping[str, Packing]) -> DataFrame:
    return df.withColumns({c: unpack_column(F.col(c), spec[c]) for c in df.columns if c in spec})
