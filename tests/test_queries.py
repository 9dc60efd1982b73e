"""Every named query gives what its SQL counterpart gives."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, sql_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return sql_session(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sql, name):
    assert difference(entry.queries()[name](spark, SF_DIR), sql, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
