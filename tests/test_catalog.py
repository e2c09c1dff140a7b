"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, con, sf, name):
    same, mine, theirs, drift, _, _ = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert same and not drift, (mine[0], theirs[0], drift)
    assert mine[0] > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "context", "prompt"] and out.count() > 0
