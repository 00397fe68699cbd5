"""Every registered raster query runs, and gives the rows of its SQL twin."""

import pytest

from tessera.plans import registry
from tests.compare import same, views


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
