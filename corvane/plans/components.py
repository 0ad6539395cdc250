"""Connected components without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.materialize import is_empty, materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, comp): least node of each connected component.

    Rounds of least-neighbour propagation with pointer jumping; each round is written, so no
    lineage grows, and nothing but one flag a round reaches the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "cc")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").select(F.col("a").alias("node"), "c")
        low = near.groupBy("node").agg(F.min("c").alias("c"))
        step = label.join(low, "node").select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = step.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "old")
        new = materialize(new, "cc")
        label = new.select("node", "comp")
        if is_empty(new.where("comp <> old")):
            return label
