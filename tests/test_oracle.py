"""Every query with reference SQL next to it on the smallest tables."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = list(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    problems, _, _, _ = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert not problems


def test_every_query_has_a_name_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_typed(spark):
    result = entry.entry(spark)
    assert result.columns == ["id", "query_id", "score", "rank", "content"]
    assert result.head() is not None
