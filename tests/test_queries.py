"""Every registered query against its SQL on DuckDB, and rows alone where there is no SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import both

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in SQL))
def test_same_rows_as_sql(spark, name):
    got, names, want, wanted = both(spark, name, QUERIES[name], SQL[name], SF)
    assert names == wanted
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in SQL))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
