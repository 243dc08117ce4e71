"""Every registered query against its SQL on the driver's tables."""

import pytest

import __spark_entry__ as driver
from compare import SF, connect, difference
from topicwell.catalog import batch, oracle, stream

QUERIES = {**batch.QUERIES, **stream.QUERIES}
ORACLE = oracle.ORACLE

@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= driver.queries().items() and ORACLE.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    assert difference(QUERIES[name](spark, SF), tables, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(batch.QUERIES))
def test_query_with_small_limits(spark, tables, name, small_limits):
    assert difference(QUERIES[name](spark, SF), tables, ORACLE[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 277
