import pytest

from pitchloom.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, same, name):
    same(spark, sf, catalog.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - ORACLES.keys()))
def test_query_without_oracle_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0
