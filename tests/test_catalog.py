import oracle
import pytest

from graphloom import catalog


@pytest.fixture(scope="module")
def con(data):
    return oracle.connection(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, data, con, name):
    assert name in catalog.SQL
    oracle.same(catalog.QUERIES[name](spark, data), con, catalog.SQL[name])
