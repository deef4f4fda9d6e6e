"""Every core query runs on the smallest tables, and agrees with its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def views(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, views, name):
    df = QUERIES[name](spark, folder)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in ORACLES:
        sql = views.sql(ORACLES[name])
        assert sorted(sql.columns) == sorted(df.columns)
        at = [sql.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
