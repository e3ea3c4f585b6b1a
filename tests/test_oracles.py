"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import rows_of
from corpusgauge.plans.views import TABLES

SF_DIR = "/root/testdata/sf0.001"
KEYS = sorted(contract.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = contract.queries()[key](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sum(got.values()) > 0
    if key in contract.oracle_sql():
        cursor = con.execute(contract.oracle_sql()[key])
        want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        assert names == want_names
        assert got == want


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
