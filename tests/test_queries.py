"""Every registered query that has SQL against DuckDB on the small tables; the entry point."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def rows(table):
    return sorted(repr(tuple(r[k] for k in sorted(r))) for r in table.to_pylist())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in SQL and n.startswith("chat_")])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(SQL[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    got = entry.queries()[name](spark, sf_dir).toArrow()
    assert sorted(got.schema.names) == sorted(want.schema.names) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
