"""Registered queries against their SQL at the smallest scale."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from corvane.operators import queries as core

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 5)
    return x.item() if isinstance(x, np.generic) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, sql = core.QUERIES[name](spark, DIR).toPandas(), duck.sql(core.SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert rows(ours) == rows(sql)


@needs_data
@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs(spark, name):
    df = core.QUERIES[name](spark, DIR)
    assert df.columns
    df.count()


@needs_data
def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
