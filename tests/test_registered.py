"""Every registered query against its DuckDB equivalent, over whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from jobtide.plans import oracles
from jobtide.plans import queries as registered

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{TESTDATA}/{table}.parquet')")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_an_oracle():
    assert set(registered.queries()) == set(oracles.oracle_sql())
    assert set(registered.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_oracle(spark, oracle, name):
    result = contract.queries()[name](spark, TESTDATA)
    columns = sorted(result.columns)
    expected = oracle.execute(contract.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = ordered(tuple(row[i] for i in places) for row in expected.fetchall())
    seen = ordered(tuple(row[c] for c in columns) for row in result.collect())
    assert seen == wanted
    assert seen


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
