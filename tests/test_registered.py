import pytest

import __spark_entry__ as entry
from siren.plans.catalog import QUERIES
from siren.plans.oracles import ORACLES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    assert compare(spark, connection, SF, QUERIES[name], ORACLES.get(name)) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 20
