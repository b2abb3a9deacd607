"""Doppler spectra as ARRAY<DOUBLE>: everything is row-local and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycolumn.functions.scalar import to_db, valid_range
from skycolumn.operators.regrid import regrid_average_or_nearest


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def hs_noise(power: Column, n_fft: float = 1.0) -> Column:
    """STRUCT(level, spread): objective noise of a spectrum.

    Bins are taken in ascending order; the last prefix whose variance over squared mean is below
    1/n_fft gives mean and standard deviation. Without one the whole spectrum counts.
    """
    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"),
                     F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("v"),
                     F.lit(0.0).alias("am"), F.lit(0.0).alias("av"))

    def step(acc: Column, x: Column) -> Column:
        k, s, q = acc["k"] + 1, acc["s"] + x, acc["q"] + x * x
        mean = s / k
        var = q / k - mean * mean
        quiet = var / (mean * mean + 1e-12) < 1.0 / n_fft
        return F.struct(k.alias("k"), s.alias("s"), q.alias("q"), F.when(quiet, mean).otherwise(acc["m"]).alias("m"),
                        F.when(quiet, var).otherwise(acc["v"]).alias("v"), mean.alias("am"), var.alias("av"))

    def finish(acc: Column) -> Column:
        return F.struct(F.coalesce(acc["m"], acc["am"]).alias("level"),
                        F.sqrt(F.greatest(F.coalesce(acc["v"], acc["av"]), F.lit(0.0))).alias("spread"))

    return F.aggregate(F.array_sort(power), start, step, finish)


def noise_filter(power: Column, noise: Column, sigmas: float, subtract: bool) -> Column:
    """Keep bins above level + sigmas * spread, optionally with the level taken off; NULL elsewhere."""
    def kept(n: Column) -> Column:
        limit = n["level"] + sigmas * n["spread"]
        return F.transform(power, lambda x: F.when(x > limit, x - n["level"] if subtract else x))

    return _bound(noise, kept)


def array_quantile(values: Column, p: float) -> Column:
    """Linear quantile of the non-missing elements."""
    def at_rank(kept: Column) -> Column:
        at = (F.size(kept) - 1) * F.lit(p)
        lo = F.floor(at).cast("int")
        a, b = F.get(kept, lo), F.get(kept, F.ceil(at).cast("int"))
        return a + (b - a) * (at - lo)

    return _bound(F.array_sort(F.filter(values, lambda x: x.isNotNull())), at_rank)


def quantile_filter(power: Column, reference: Column, p: float = 0.1) -> Column:
    """Keep bins above the quantile of a reference spectrum (the co-channel's for both channels)."""
    return _bound(array_quantile(reference, p), lambda q: F.transform(power, lambda x: F.when(x > q, x)))


def flip_doppler(power: Column) -> Column:
    return F.reverse(power)


def sort_doppler(doppler: Column, power: Column) -> Column:
    """Power in order of ascending velocity."""
    pairs = F.array_sort(F.zip_with(doppler, power, lambda d, p: F.struct(d.alias("d"), p.alias("p"))))
    return F.transform(pairs, lambda x: x["p"])


def spectral_z_ka(power: Column, noise: Column, radar_const: Column, range_m: Column, snr_cor: Column, npw: Column) -> Column:
    factor = radar_const * F.pow(range_m / 5000, 2.0) * snr_cor / npw
    return F.transform(power, lambda x: (x - noise) * factor)


def spectral_z_x(power: Column, range_m: Column) -> Column:
    return F.transform(power, lambda x: to_db(x * range_m * range_m))


def spectral_ldr(cross: Column, co: Column) -> Column:
    return F.zip_with(cross, co, lambda x, y: F.when(y != 0, x / y))


def has_signal(power_db: Column, threshold: float = -35.0, share: float = 0.05) -> Column:
    """True if at least ``share`` of the bins lie above the threshold."""
    return F.size(F.filter(power_db, lambda x: x > threshold)) / F.size(power_db) >= share


def spectrum_pick(spectra: DataFrame, t: str, axis: str, at_t: int, at_range: float) -> DataFrame:
    """The spectrum nearest in time, then in range: two one-row aggregates pushed to the scan."""
    order = F.struct(F.abs(F.col(t) - at_t), F.col(t), F.abs(F.col(axis) - at_range), F.col(axis))
    rest = spectra.columns
    return spectra.agg(F.min_by(F.struct(*rest), order).alias("_s")).select("_s.*")


def peak_class(peaks: Column, two_sided: bool) -> Column:
    return F.ceil(peaks / 2) if two_sided else peaks.cast("long")


def primary_node(df: DataFrame, node: str, keys, value: str) -> DataFrame:
    """Primary peak (node 0) and the largest value over the other nodes, per key."""
    return df.groupBy(*keys).agg(F.max(F.when(F.col(node) == 0, F.col(value))).alias("primary"),
                                 F.max(F.when(F.col(node) != 0, F.col(value))).alias("others"))


def recompute_snr(df: DataFrame, keys, coord: str, snr: str, step, source_step, tolerance, origin=0) -> DataFrame:
    """Linear, unmasked SNR onto a grid; negatives count in the mean, only the result must be positive."""
    out = regrid_average_or_nearest(df, keys, coord, [snr], step, source_step, tolerance, origin)
    return out.withColumn(snr, valid_range(to_db(F.col(snr)), -40.0, 70.0))
