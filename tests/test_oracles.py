"""Every engine query equals its SQL in DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

from nucleoframe.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, df.select(*[f"`{c}`" for c in columns]).collect())) == sorted(map(key, want.project(quoted).fetchall()))


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
