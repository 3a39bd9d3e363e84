import pytest

from factweave.plans import registry
from tests.oracle import DATA, connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, DATA), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_every_query_says_what_it_is():
    assert not [k for k, f in QUERIES.items() if not f.__doc__]


def test_entry(spark):
    assert registry.flagship(spark, DATA).count() > 0
