import pytest

from tests.oracle import compare, connect
from tidewrack.llm import queries as Q


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(name, spark, small, con):
    assert compare(spark, con, Q.queries()[name], Q.oracle_sql()[name], small) is None


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(name, spark, small):
    assert Q.queries()[name](spark, small).count() > 0
