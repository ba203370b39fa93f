import pytest

import __spark_entry__ as entry
from parity import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    query = entry.queries()[name]
    if name in entry.TEXT_QUERIES:
        pytest.skip("tested with its subpackage")
    if name in entry.oracle_sql():
        assert compare(spark, con, SF, query, entry.oracle_sql()[name]) == ""
    else:
        assert query(spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) - set(entry.TEXT_QUERIES) == set()
