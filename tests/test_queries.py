"""Every registered query against its DuckDB twin, on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from parity import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con: duckdb.DuckDBPyConnection, name: str):
    if name in ORACLES:
        problem = compare(spark, con, SF, QUERIES[name], ORACLES[name])
        assert problem is None, problem
    else:
        df = QUERIES[name](spark, SF)
        assert df.columns and df.count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
