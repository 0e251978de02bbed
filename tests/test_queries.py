"""Every registered query with SQL gives the same rows and types; the others run and keep their schema."""

import pytest
from oracle import difference, type_difference

from textquarry import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert not type_difference(df, plans.ORACLES[name], SF)
    assert not difference(df, plans.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
