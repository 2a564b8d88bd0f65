import pytest

from kinfolk.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, data, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLES[name], data)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "component_id", "face_count"]
