"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__ as entry
import oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf, con):
    df = QUERIES[key](spark, sf)
    if key in SQL:
        problem, _ = oracle.compare(df, con, SQL[key])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"rank", "id", "score", "total"}
    assert df.count() == 10
