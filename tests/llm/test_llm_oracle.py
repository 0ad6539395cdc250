"""Registered training-data queries against their SQL, and recall of the others against planted rules, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from corvane.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    assert rows(queries.QUERIES[name](spark, DIR).toPandas()) == rows(c.sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).toPandas().shape[1] > 0
