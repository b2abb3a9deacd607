"""Column functions: conversions, masks, geometry, labels. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycolumn.specs import EARTH_RADIUS_M, GRAVITY, ISO0_ZONES, OROGRAPHIC_TOP_M


# ---- levels and ranges -------------------------------------------------------------------------
def to_db(x: Column) -> Column:
    """10 log10(x); NULL where x is not positive (NaN included)."""
    return F.when((x > 0) & ~F.isnan(x), 10 * F.log10(x))


def to_linear(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def valid_range(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.between(lo, hi), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Saturate; NULL stays NULL (``least``/``greatest`` alone would return the bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def normalise(x: Column, lo: float, hi: float) -> Column:
    if lo == hi:
        raise ValueError("normalise needs lo != hi")
    return (valid_range(x, lo, hi) - lo) / (hi - lo)


def missing_to_null(x: Column, limit: float = 998.0, sentinels: Sequence[float] = ()) -> Column:
    """NaN, |x| > limit and the listed sentinels become NULL."""
    bad = F.isnan(x) | (F.abs(x) > limit)
    if sentinels:
        bad = bad | x.isin(*sentinels)
    return F.when(~bad, x)


def is_within(x: Column, limits: Sequence[float]) -> Column:
    return x.between(limits[0], limits[1])


# ---- masks -------------------------------------------------------------------------------------
def snr_mask(df: DataFrame, snr: Sequence[str], threshold: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep values where every SNR column exceeds the threshold; ``*_full`` and keys are untouched."""
    keep = None
    for name in snr:
        test = F.col(name) > threshold
        keep = test if keep is None else keep & test
    names = columns if columns is not None else [
        f.name for f in df.schema if f.dataType.typeName() == "double" and not f.name.endswith("_full")]
    return df.select(*[F.when(keep, F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


_TESTS = {
    "below": lambda x, v: x < v,
    "above": lambda x, v: x > v,
    "equal": lambda x, v: x == v,
    "inside": lambda x, v: (x > v[0]) & (x < v[1]),
    "outside": lambda x, v: (x < v[0]) | (x > v[1]),
}


def gate_filter(rules: Mapping[str, tuple[str, float | tuple[float, float]]]) -> Column:
    """True where any rule excludes the gate; missing values exclude nothing."""
    out = F.lit(False)
    for field, (method, value) in rules.items():
        out = out | F.coalesce(_TESTS[method](F.col(field), value), F.lit(False))
    return out


def mask_remove(df: DataFrame, excluded: Column, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~excluded, F.col(c)) for c in columns})


def mask_addvars(df: DataFrame, excluded: Column, columns: Sequence[str]) -> DataFrame:
    """Keep the raw values as ``<c>_full`` and null the masked ones in ``<c>``."""
    raw = df.withColumns({f"{c}_full": F.col(c) for c in columns})
    return raw.withColumns({c: F.when(~excluded, F.col(f"{c}_full")) for c in columns})


def zenith_only(df: DataFrame, elevation: str) -> DataFrame:
    return df.filter(F.col(elevation).isin(90.0, -1000.0))


# ---- angles and geometry -----------------------------------------------------------------------
def elevation_correction(elevation: Column, offset: float) -> Column:
    """Add the offset, then turn positive results by -180 degrees and the others by +180."""
    moved = elevation + offset
    return F.when(moved > 0, moved - 180).otherwise(moved + 180)


def azimuth_correction(azimuth: Column, offset: float) -> Column:
    moved = azimuth + offset
    return F.when(moved > 360, moved - 360).otherwise(moved)


def geopotential_to_alt(h: Column) -> Column:
    up = h / GRAVITY
    return EARTH_RADIUS_M * up / (EARTH_RADIUS_M - up)


def earth_radius(latitude_deg: Column) -> Column:
    """Radius (m) of the reference ellipsoid at a latitude."""
    a, b = 6378137.0, 6356752.3
    c, s = F.cos(F.radians(latitude_deg)), F.sin(F.radians(latitude_deg))
    top = F.pow(a * a * c, 2.0) + F.pow(b * b * s, 2.0)
    return F.sqrt(top / (F.pow(a * c, 2.0) + F.pow(b * s, 2.0)))


def gate_height(range_m: Column, elevation_deg: Column, radius_m: Column) -> Column:
    """Beam height over the antenna with the 4/3 effective earth radius."""
    effective = radius_m * (4.0 / 3.0)
    squared = range_m * range_m + effective * effective + 2.0 * range_m * effective * F.sin(F.radians(elevation_deg))
    return F.sqrt(squared) - effective


# ---- heights, types, temperature ---------------------------------------------------------------
def height_over_iso0(height: Column, iso0: Column) -> Column:
    return height - iso0


def temperature_approx(height_over_zero: Column) -> Column:
    """Standard lapse of 6.5 degrees per kilometre from the zero level."""
    return -(height_over_zero / 1000.0) * 6.5


def iso0_zone(height_over_zero: Column) -> Column:
    """Zone number 1..3, NULL outside: the lowest zone is closed, the upper ones open below."""
    out = None
    for i, (lo, hi) in enumerate(ISO0_ZONES, start=1):
        test = (height_over_zero >= lo if i == 1 else height_over_zero > lo) & (height_over_zero <= hi)
        out = F.when(test, i) if out is None else out.when(test, i)
    return out


def cloud_type(cloudtop: Column, threshold: float = OROGRAPHIC_TOP_M) -> Column:
    """A missing top counts as frontal."""
    return F.when(cloudtop < threshold, "orographic").otherwise("frontal")


def lapse_iso0(t_first: Column, r_first: Column, lapse: float) -> tuple[Column, Column]:
    """(surface temperature, zero-degree height) by extrapolating the first gate."""
    surface = t_first - r_first * lapse
    return surface, surface / -lapse


def ml_index(zh: Column, rhohv: Column) -> Column:
    """Melting-layer index from clipped reflectivity and correlation."""
    high = normalise(clip(zh, 10.0, 60.0), 10.0, 60.0)
    low = normalise(clip(rhohv, 0.65, 1.0), 0.65, 1.0)
    return high * (1 - low)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def geopotential_height(z: Column) -> Column:
    return z / 9.81


def vorticity_scaled(vo: Column) -> Column:
    return vo * 1e5


def thickness(levels: DataFrame, keys: Sequence[str], level: str, z: str, upper: float = 500,
              lower: float = 1000) -> DataFrame:
    """(z_upper - z_lower) / 9.81 per point, one conditional aggregation."""
    pick = lambda lev: F.max(F.when(F.col(level) == lev, F.col(z)))
    return (levels.filter(F.col(level).isin(upper, lower)).groupBy(*keys)
            .agg(((pick(upper) - pick(lower)) / 9.81).alias("thickness")))


# ---- rows of one scan (bounded by the number of gates or rays) -------------------------------
def angle_step(df: DataFrame, scan: Sequence[str], order: str, azimuth: str, nominal: float | None = None) -> DataFrame:
    """Successive azimuth step, wrapped; the last ray repeats the step before it."""
    w = Window.partitionBy(*scan).orderBy(order)
    ahead = F.lead(azimuth).over(w) - F.col(azimuth)
    here = F.coalesce(ahead, F.col(azimuth) - F.lag(azimuth).over(w))
    out = df.withColumn("step", F.abs(here - 360 * (here > 300).cast("int")))
    return out.filter(F.col("step") > 0.25 * nominal) if nominal is not None else out


def find_nearest(df: DataFrame, keys: Sequence[str], value: str, target: float, index: str) -> DataFrame:
    """First index with the smallest absolute difference, per key."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(value), F.col(index)),
                 F.struct(F.abs(F.col(value) - target), F.col(index))).alias("hit")
    ).select(*keys, F.col(f"hit.{value}").alias("nearest"), F.col(f"hit.{index}").alias("nearest_index"))


# ---- text, lists, dates --------------------------------------------------------------------
def format_elapsed(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` from the largest unit that is not zero; below a minute two decimals."""
    whole = F.floor(seconds)
    d, h = F.floor(whole / 86400), F.floor((whole % 86400) / 3600)
    m, s = F.floor((whole % 3600) / 60), whole % 60
    return (F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, s))
            .when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
            .when(m > 0, F.format_string("%dm %ds", m, s))
            .otherwise(F.format_string("%.2fs", seconds.cast("double"))))


def format_list(values: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``; empty text for an empty list."""
    n = F.size(values)
    text = values.cast("array<string>")
    head = F.array_join(F.slice(text, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (F.when(n == 0, "").when(n == 1, F.get(text, F.lit(0)))
            .otherwise(F.concat(head, F.lit(" and "), F.get(text, n - 1))))


def parse_list(text: Column) -> Column:
    """ARRAY<DOUBLE> of text such as ``[1.0 2.5]``; blanks and commas separate."""
    bare = F.trim(F.regexp_replace(text, r"[\[\],\s]+", " "))
    parts = F.filter(F.split(bare, " "), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("double"))


def list_min_max_avg(values: Column) -> tuple[Column, Column, Column]:
    kept = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.array_min(kept), F.array_max(kept), F.when(F.size(kept) > 0, total / F.size(kept))


def clean_strings(df: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Trim text, turn empty text into NULL, cast the listed columns to DOUBLE."""
    out = {}
    for f in df.schema:
        if f.dataType.typeName() == "string":
            text = F.nullif(F.trim(F.col(f.name)), F.lit(""))
            out[f.name] = text.try_cast("double") if f.name in numeric else text
    return df.withColumns(out)


def date_sequence(first: Column, last: Column) -> Column:
    """Inclusive list of days."""
    return F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))
