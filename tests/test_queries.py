"""Every registered query against DuckDB."""

import os

import pytest

import __spark_entry__ as contract
from compare import connect, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as con:
        yield con


def test_every_query_has_its_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(contract._QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    want_columns, want = duck_rows(duck, SQL[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert rows == want
    assert rows or name.startswith("orphan") or SF_DIR.endswith("0.001")


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns[-3:] == ["pct", "band", "pct_label"]
    assert df.count() > 0
