"""Executed plans: an ordered operator reads its source once."""

import os
import re

import pytest

from skycolumn.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, scans", [("true_runs", 1), ("linear_in_time", 1), ("merge_close_intervals", 1), ("forward_backward_fill", 2)])
def test_reads_its_table_once(spark, name, scans):
    """``forward_backward_fill`` runs on the regular series, which takes its bounds and its samples from the table."""
    df = catalogue.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("Scan parquet", plan)) == scans


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, scans", [("range_statistics", 4), ("campaign_statistics", 4), ("bias_by_range", 6), ("bias_points", 4)])
def test_reads_few_times(spark, name, scans):
    """Exact quantiles read their rows once per pass; the passes before the last one have run when the plan is made."""
    df = catalogue.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("Scan parquet", plan)) <= scans


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_combinations_share_one_sweep(spark):
    """Both sets and the spans are read once for all four combinations, and the spans once more for their keys."""
    df = catalogue.QUERIES["interval_algebra"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("Scan parquet", plan)) <= 4
