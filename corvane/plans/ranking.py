"""Row numbers within groups that no single task has to hold.

A window with ``row_number`` sends a whole group to one task. Here rows are range-partitioned
by (group, order), numbered inside their partition and shifted by the sizes of the same group's
parts in the partitions before; those sizes are a table of (partitions + groups) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.plans.materialize import materialize


def rank_in_group(
    df: DataFrame, group: str | None, order: list[str | Column], out: str = "idx", partitions: int | None = None, total: str | None = None, running: str = "running"
) -> DataFrame:
    """``df`` with ``out``: 0-based position of the row within ``group`` by ``order``.

    ``group`` None ranks all rows together. ``total`` names a numeric column (null counts as 0) whose running
    sum up to and with the row is added as ``running``. ``order`` must be a total order within the group for a
    defined result. Rows with a null group form one group. The sorted rows are written once, since range
    boundaries are sampled.
    """
    spark = df.sparkSession
    key = group or "__all"
    base = df if group else df.withColumn("__all", F.lit(0))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = base.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("__pid", F.spark_partition_id())
    if total:
        placed = placed.withColumn("__add", F.coalesce(F.col(total), F.lit(0)).cast("double"))
    schema = T.StructType([*placed.schema.fields, T.StructField("__at", T.LongType())] + ([T.StructField("__sum", T.DoubleType())] if total else []))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen, spent = None, 0, 0.0
        for b in batches:
            if not len(b):
                continue
            g = b[key].astype(object).where(b[key].notna(), None).to_numpy()
            new = np.r_[True, g[1:] != g[:-1]]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, len(b)])
            at = np.arange(len(b)) - np.repeat(start, size)
            head = start[1] if len(start) > 1 else len(b)
            goes_on = last is not None and last[0] == g[0]
            if goes_on:
                at[:head] += seen
            seen = int(at[-1]) + 1
            extra = {}
            if total:
                c = np.cumsum(b["__add"].to_numpy(float))
                run = c - np.repeat(np.r_[0.0, c][start], size)
                if goes_on:
                    run[:head] += spent
                spent = float(run[-1])
                extra = {"__sum": run}
            last = (g[-1],)
            yield b.assign(__at=at, **extra)

    placed = materialize(placed.mapInPandas(number, schema), "ranked")
    sums = [F.sum("__add").alias("__t")] if total else []
    parts = placed.groupBy(key, "__pid").agg(F.count(F.lit(1)).alias("__n"), *sums)
    w = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    shift = parts.select(F.col(key).alias("__g"), F.col("__pid").alias("__p"), before("__n").alias("__shift"), *([before("__t").alias("__paid")] if total else []))
    # only groups cut by a partition boundary have a shift; the others join to nothing
    shift = shift.where("__shift > 0")
    joined = placed.join(shift, placed[key].eqNullSafe(shift["__g"]) & (placed["__pid"] == shift["__p"]), "left")
    result = joined.withColumn(out, F.col("__at") + F.coalesce("__shift", F.lit(0)))
    if total:
        result = result.withColumn(running, F.col("__sum") + F.coalesce("__paid", F.lit(0.0)))
    return result.drop("__pid", "__at", "__g", "__p", "__shift", "__add", "__sum", "__paid", "__all")
