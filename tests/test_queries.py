"""Every registered query against SQL on another engine."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from runledger.plans import oracle
from runledger.plans.queries import registered

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registered(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problems = compare(spark, con, SF, QUERIES[name], ORACLE[name])
    assert not problems
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
