"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, message, _ = check(spark, con, ROOT, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 1
