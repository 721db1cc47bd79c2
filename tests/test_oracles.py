"""Every registered query: equal to its SQL on DuckDB, or non-empty where SQL cannot express it."""

import pytest

import __spark_entry__ as entry
from checking import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, duck, name):
    assert compare(QUERIES[name](spark, data), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert not QUERIES[name](spark, data).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
