"""Imports every family of queries, which fills the registry."""

from skycolumn.plans import q_calibration, q_intervals, q_joins, q_profiles, q_regrid, q_scalar, q_sources, q_stats, q_windows, q_zdr  # noqa: F401
from skycolumn.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
