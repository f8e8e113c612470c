"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from obsflow.plans import registry
from tests.compare import database, of_spark, of_sql

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert of_spark(registry.QUERIES[name](spark, DIR)) == of_sql(con, registry.ORACLES[name])
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() >= 0
    spark.catalog.clearCache()
