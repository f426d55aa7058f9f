"""Every query of the core against its SQL, and those without SQL for a result."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidewrack.plans import registry

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    cols, got = rows_of(Q[name](spark, sf))
    want_cols, want = rows_of_sql(con, SQL[name])
    assert cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_no_sql_without_query():
    assert set(SQL) <= set(Q)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())
