"""Every query that has SQL gives DuckDB's rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(map(repr, (r[names.index(c)] for c in df.columns))) for r in found.fetchall())
    assert sorted(tuple(map(repr, r)) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["target", "source"]
