"""Variable specifications, grids and physical constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class VariableSpec:
    """How one variable is named, bounded and stored."""

    name: str
    vmin: float | None = None
    vmax: float | None = None
    precision: float | None = None
    dims: tuple[str, ...] = ("time", "range")
    flag: bool = False


# Bounds and storage precision of the published store.
STORE_SPECS = (
    VariableSpec("reflectivity", -60.0, 45.0, 0.1),
    VariableSpec("velocity", -10.0, 10.0, 0.1),
    VariableSpec("skewness", -2.5, 2.5, 0.001),
    VariableSpec("spectrumwidth", 0.0, 6.0, 0.001),
    VariableSpec("LDR", -35.0, 5.0, 0.1),
    VariableSpec("rhohv", 0.0, 1.0, 0.01),
    VariableSpec("snrh", -30.0, 70.0, 0.1),
    VariableSpec("snrv", -30.0, 70.0, 0.1),
    VariableSpec("numpeaks", 1.0, 10.0, 1.0),
    VariableSpec("cloudtop", 0.0, 15000.0, 1.0, ("time",)),
    VariableSpec("zdi", 0.0, 15000.0, 1.0, ("time",)),
)

# What each instrument stores, where it differs from or adds to the shared specifications.
_SHARED = ("reflectivity", "velocity", "snrh", "snrv", "zdi")
_RATIO = lambda name: VariableSpec(name, 0.0, 15.0, 0.1)
_SPECTRA = (VariableSpec("sZh", -45.0, 15.0, 0.01, ("time", "range", "doppler")), VariableSpec("sZv", -45.0, 15.0, 0.01, ("time", "range", "doppler")))
_PRECIP = VariableSpec("is_precip", dims=("time",), flag=True)


def _like(name: str, other: str) -> VariableSpec:
    spec = next(s for s in STORE_SPECS if s.name == other)
    return VariableSpec(name, spec.vmin, spec.vmax, spec.precision, spec.dims)


def _of(*names: str) -> tuple[VariableSpec, ...]:
    return tuple(s for s in STORE_SPECS if s.name in names)


INSTRUMENT_SPECS = {
    "X": (*_of(*_SHARED, "rhohv"), _like("reflectivity_raw", "reflectivity"), _like("snrh_raw", "snrh"), _like("snrv_raw", "snrv"),
          VariableSpec("spectrumwidth", 0.0, 3.0, 0.01), VariableSpec("zdr", 0.0, 5.0, 0.01), _RATIO("DFR_XKa"), _RATIO("DFR_XW"), _PRECIP, *_SPECTRA),
    "Ka": (*_of(*_SHARED, "skewness", "spectrumwidth", "LDR", "numpeaks", "cloudtop"), _RATIO("DFR_XKa"), _RATIO("DFR_KaW"), _PRECIP, *_SPECTRA,
           VariableSpec("sLDR", -35.0, 5.0, 0.01, ("time", "range", "doppler"))),
    "W": (*_of("reflectivity", "velocity", "cloudtop", "zdi"), *[_like(n, "reflectivity") for n in ("reflectivity_raw", "z_30s", "z_120s")],
          *[_like(n, "velocity") for n in ("vel_30s", "vel_120s")], _RATIO("DFR_KaW"), _RATIO("DFR_XW"), _PRECIP),
    "peaks": (*_of("reflectivity", "velocity", "LDR", "numpeaks", "cloudtop", "zdi"), VariableSpec("skewness", -2.5, 2.5, 0.01),
              VariableSpec("spectrumwidth", 0.0, 3.0, 0.01), _PRECIP),
}

# Native time steps (s) and range tolerances (m) of the instruments.
TIME_STEP_S = {"X": 1, "Ka": 5, "W": 3}
RANGE_TOLERANCE_M = {"X": 15.0, "Ka": 16.0, "W": 12.5}
# Calibration offset and spread (dB), Ka offset (dB).
CALIBRATION_DB = {"X": (1.66, 0.69), "W": (3.35, 0.91)}
KA_OFFSET_DB = 0.89
# Layer-top detection.
CLOUDTOP_DEPTH_M = 500.0
CLOUDTOP_GAP_M = 200.0
# Site and earth.
SITE_ALTITUDE_M = 1690.0
GRAVITY = 9.80665
EARTH_RADIUS_M = 6_378_000.0
DRY_AIR_RD = 287.05
# Height zones over the zero-degree level (m), lowest one closed on both sides.
ISO0_ZONES = ((460.0, 1230.0), (1230.0, 2300.0), (2300.0, 3850.0))
OROGRAPHIC_TOP_M = 3000.0

# The canonical name of each source column, per instrument (fixed values).
CANONICAL = {
    "X": {"Zh": "reflectivity", "RVel": "velocity", "Sw": "spectrumwidth", "SNRh": "snrh",
          "SNRv": "snrv", "Rhohv": "rhohv"},
    "Ka": {"Zg": "reflectivity", "VELg": "velocity", "RMSg": "spectrumwidth", "LDRg": "LDR",
           "SNRg": "snrh", "SKWg": "skewness", "NPKg": "numpeaks"},
    "W": {"reflectivity": "reflectivity", "velocity": "velocity", "background_mask": "mask"},
}


def store_schema(specs=STORE_SPECS) -> T.StructType:
    """Schema of an unpacked store table for the given variables."""
    fields = [T.StructField("radar", T.StringType()), T.StructField("time", T.TimestampNTZType()),
              T.StructField("range", T.DoubleType())]
    fields += [T.StructField(s.name, T.BooleanType() if s.flag else T.DoubleType()) for s in specs]
    return T.StructType(fields)
