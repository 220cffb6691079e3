"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from lexiscore.catalog.oracle import ORACLES
from lexiscore.catalog.queries import QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= contract.queries().keys() and set(ORACLES) <= contract.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, name, SF_DIR) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
