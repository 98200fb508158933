import pytest

from lumora import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
