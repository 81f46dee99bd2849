"""Every query of the mobility engine against its SQL twin."""

import os

import pytest

from tests.compare import assert_same, connect
from tramline.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    return connect(D)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, db, name):
    assert_same(catalog.QUERIES[name](spark, D).toPandas(), db.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
