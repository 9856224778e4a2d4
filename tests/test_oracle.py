"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from basalt.plans import queries as plans
from basalt.streaming import queries as streams

DATA = "/root/testdata/sf0.001"
SPARK = plans.spark_queries() | streams.QUERIES
DUCK = plans.duck_queries() | streams.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SPARK))
def test_same_rows(spark, duck, name):
    got = SPARK[name](spark, DATA).toArrow()
    want = duck.sql(DUCK[name])
    columns = sorted(got.column_names)
    assert columns == sorted(want.columns)
    mine = sorted(zip(*[got.column(c).to_pylist() for c in columns], strict=True), key=repr)
    theirs = sorted([tuple(r[list(want.columns).index(c)] for c in columns) for r in want.fetchall()], key=repr)
    assert mine == theirs
