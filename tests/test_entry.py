"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from regulith.plans import extra_oracle, more_oracle, oracle

QUERIES, SQL = entry.QUERIES, oracle.sql() | more_oracle.sql() | extra_oracle.sql()

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = tables.sql(SQL[name])
    assert sorted(found.columns) == columns
    want = tables.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
