"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "business_id", "verdict", "matched_rule"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 175


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        assert got
        return
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())
