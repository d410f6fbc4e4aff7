"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# At this scale no row falls into these results; they are compared at larger scales.
MAY_BE_EMPTY = "no rows on either side"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    result = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert result.columns and result.count() >= 0
    else:
        assert compare(result, con, sql) in (None, MAY_BE_EMPTY)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() > 0 and "verdict" in result.columns
