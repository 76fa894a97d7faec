"""Every registered query against its SQL at the small scale."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

DIRECTORY = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


def test_every_query_has_an_oracle():
    assert set(entry.LIBRARY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DIRECTORY)
    assert differences(df, con, entry.oracle_sql()[name]) == []


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
