"""Every registered query runs, and agrees with its SQL in DuckDB on the small tables."""

import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from check_oracle import canonical  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(os.path.join(SF, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, tables, name):
    got = canonical(entry_module.queries()[name](spark, SF).toArrow())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got[2]
        return
    want = canonical(tables.sql(sql).to_arrow_table())
    assert got[:2] == want[:2]
    assert got[2] == want[2]


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
