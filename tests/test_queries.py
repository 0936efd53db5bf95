"""Every registered query against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from talweg.plans import registry

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(WHERE):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{WHERE}/{f}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_query(spark, tables, name):
    query, sql = registry.ALL[name]
    got = query(spark, WHERE)
    columns = sorted(got.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    assert rows
    if sql:
        oracle = tables.sql(sql)
        assert sorted(oracle.columns) == columns
        order = [oracle.columns.index(c) for c in columns]
        assert rows == sorted([plain(r[k]) for k in order] for r in oracle.fetchall())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.ALL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
