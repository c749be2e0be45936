"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from oracle import connect, difference

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# the queries of the operators on training data have tests of their own
NAMES = sorted(set(entry.queries()) - set(entry.LLM_QUERIES))


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["page_id", "n_links", "n_unresolved"]
    assert found.count() > 0
