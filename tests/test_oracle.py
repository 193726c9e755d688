"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

SMALL = "/root/testdata/sf0.001"
QUERIES, STATEMENTS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], STATEMENTS[name], SMALL)
    assert ok, message


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() == 15
