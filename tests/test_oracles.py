"""Every query that has SQL gives the same rows as DuckDB; the others give rows."""

import os

import pytest

from attesta.plans import registry
from tests.oracle import connection, rows_of, rows_of_sql

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df, sql = registry.queries()[name](spark, DATA), registry.oracles().get(name)
    if sql is None:
        assert df.count() > 0
        return
    cols, expected = rows_of_sql(con, sql)
    assert sorted(df.columns) == cols
    assert rows_of(df) == expected
