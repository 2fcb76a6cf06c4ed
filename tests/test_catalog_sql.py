import pytest

from tests.compare import SF, connection, rows
from wayfind import catalog


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
    else:
        assert rows(got) == rows(con.sql(sql).df())
