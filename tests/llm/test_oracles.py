"""The operators' queries against their SQL, over whole tables."""

import glob
import os

import duckdb
import pytest

from quire.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_return_whole_tables(spark, name):
    df = QUERIES[name](spark, DIR)
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
