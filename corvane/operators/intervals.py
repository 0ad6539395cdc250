"""Interval operators: union, intersection, stabbing and unique-match joins.

Range conditions become equi-joins on time buckets: an interval is repeated once per bucket it
covers, so no pair of sides is ever compared outside a common bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def union(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, start, end): overlapping or touching intervals merged; empty and reversed ones left out."""
    x = df.where(F.col(end) > F.col(start))
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col(start) > before, F.lit(True))).cast("int")).over(w)
    return x.withColumn("_i", island).groupBy(group, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def intersection(a: DataFrame, b: DataFrame, group: str, start: str, end: str, width: float) -> DataFrame:
    """Common parts of two interval sets; each pair meets in the bucket where its common part begins."""
    x = a.select(group, F.col(start).alias("a0"), F.col(end).alias("a1")).withColumn("_b", _buckets(F.col("a0"), F.col("a1"), width))
    y = b.select(group, F.col(start).alias("b0"), F.col(end).alias("b1")).withColumn("_b", _buckets(F.col("b0"), F.col("b1"), width))
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    return x.join(y, [group, "_b"]).where((hi > lo) & (F.floor(lo / width) == F.col("_b"))).select(group, lo.alias(start), hi.alias(end))


def stab(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, label: str, width: float, default: str = "none") -> DataFrame:
    """``points`` with ``label`` of the shortest span that contains them."""
    s = spans.select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(label).alias("_l")).withColumn("_b", _buckets(F.col("_s"), F.col("_e"), width))
    p = points.withColumn("_pb", F.floor(F.col(at) / width))
    hit = p.join(s, (p[group] == s["_g"]) & (p["_pb"] == s["_b"]) & (s["_s"] <= p[at]) & (p[at] <= s["_e"]), "left")
    keep = [c for c in points.columns]
    best = F.min_by("_l", F.struct(F.col("_e") - F.col("_s"), F.col("_l")))
    return hit.groupBy(*keep).agg(F.coalesce(best, F.lit(default)).alias(label))


def unique_match(spans: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, value: str, margin: float) -> DataFrame:
    """(key, value, ambiguous): the value of the only point within the widened span; null if none or several.

    A missing or early end counts as the start; a span without start matches nothing.
    """
    lo = F.col(start) - margin
    hi = F.greatest(F.coalesce(end, start), F.col(start)) + margin
    width = max(2 * margin, 1.0)
    s = spans.select(key, lo.alias("_lo"), hi.alias("_hi")).withColumn("_b", _buckets(F.col("_lo"), F.col("_hi"), width))
    p = points.where(F.col(at).isNotNull()).select(F.col(at).alias("_at"), F.col(value).alias("_v")).withColumn("_b", F.floor(F.col("_at") / width))
    hit = s.join(p, "_b").where((F.col("_lo") <= F.col("_at")) & (F.col("_at") <= F.col("_hi")))
    one = hit.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("_v").alias("_v"))
    return spans.select(key).join(one, key, "left").select(key, F.when(F.col("_n") == 1, F.col("_v")).alias(value), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("ambiguous"))
