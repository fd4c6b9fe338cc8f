import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES = {n: f for n, f in entry.queries().items() if ".llm." not in f.__module__}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, small, con):
    assert compare(spark, con, QUERIES[name], SQL[name], small) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
