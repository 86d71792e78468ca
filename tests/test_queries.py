import glob
import os

import duckdb
import pytest

from quire.plans import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(rows):
    return sorted((tuple(str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    assert got
    if name in Q.ORACLE_SQL:
        want = duck.sql(Q.ORACLE_SQL[name])
        assert sorted(want.columns) == cols
        assert got == plain(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def long_text(tmp_path, spark):
    words = [f"Word{i}" for i in range(300)]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [w.lower() for w in words]


def test_slugs_take_whole_texts(spark, tmp_path):
    words = long_text(tmp_path, spark)
    assert Q.slugs(spark, str(tmp_path)).first().slug == "-".join(words)


def test_topics_take_whole_texts(spark, tmp_path):
    words = long_text(tmp_path, spark)
    assert Q.topic_names(spark, str(tmp_path)).first().topics == ",".join(words)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
