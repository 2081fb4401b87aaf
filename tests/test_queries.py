import pytest

from folioflow.plans.queries import ORACLE_SQL, QUERIES

from .duck import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
