"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registered.queries import QUERIES
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_its_sql():
    assert QUERIES.keys() <= queries().keys() and QUERIES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert compare(queries()[name](spark, SF), duck, oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {
        "fingerprint", "count", "sources", "level", "first_seen", "last_seen", "sample", "context"
    }
