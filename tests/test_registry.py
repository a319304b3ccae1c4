"""The registered queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from compare import plain, rows_of
from lorekeep.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.execute(f"create view {p[:-8]} as select * from '{SF}/{p}'")
    return c


NAMES = sorted(registry.SQL)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, name):
    from collections import Counter

    df = registry.QUERIES[name](spark, SF)
    con.execute(registry.SQL[name])
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert rows_of(df) == Counter(tuple(plain(r[i]) for i in order) for r in con.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry_works():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
