import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.plans.grouped import sorted_group_map
from corvane.plans.ranking import rank_in_group


@pytest.mark.parametrize("partitions", [1, 3])
def test_rank_equals_row_number(spark, partitions):
    rows = [("a" if i % 3 else None if i % 7 == 0 else "b", i * 7919 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    got = {r["id"]: r["idx"] for r in rank_in_group(df, "g", ["x", "id"], partitions=partitions).collect()}
    p = pd.DataFrame(rows, columns=["g", "x", "id"]).sort_values(["x", "id"])
    want = dict(zip(p["id"], p.groupby("g", dropna=False).cumcount()))
    assert got == want


@pytest.mark.parametrize("group", ["g", None])
def test_running_totals(spark, group):
    rows = [("a" if i % 3 else "b", i * 31 % 97, i, None if i % 11 == 0 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x long, id long, w double")
    got = {r["id"]: r["running"] for r in rank_in_group(df, group, ["x", "id"], partitions=4, total="w").collect()}
    p = pd.DataFrame(rows, columns=["g", "x", "id", "w"]).fillna({"w": 0.0}).sort_values(["x", "id"])
    want = dict(zip(p["id"], p.groupby("g")["w"].cumsum() if group else p["w"].cumsum()))
    assert got == want


def test_rank_of_nothing(spark):
    assert rank_in_group(spark.createDataFrame([], "g string, x long"), "g", ["x"]).count() == 0


def test_groups_arrive_whole(spark):
    df = spark.range(5000).select((F.col("id") % 137).alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        def fn(g):
            return g.groupby("k", as_index=False).agg(n=("id", "size"), first=("id", "first"))

        out = sorted_group_map(df, ["k"], ["id"], fn, "k long, n long, first long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(out) == 137 and sum(r["n"] for r in out) == 5000 and all(r["first"] == r["k"] for r in out)
