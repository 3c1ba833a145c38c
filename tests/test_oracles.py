"""Every registered query against its SQL oracle on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from oracles import all_queries
from registry import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = all_queries()
CON = connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_oracle(spark, key):
    ok, n, message = compare(QUERIES[key](spark, SF), CON, ORACLES[key])
    assert ok, message
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
