"""Deduplicating new batches against all accepted history.

The index is a folder that outlives session and object: minwise band keys of accepted records with their
nodes, and the nodes' texts, both in subfolders by hash (``PARTS``). A new batch is signed alone. Its keys
name the subfolders to read, everything else of the history stays on disk; the nodes that share a bucket
name the subfolders of texts to read for verification on the full shingle sets. Keys and texts of accepted
records are appended. Nothing of the history is signed, shuffled or compared again.

Order: batches by number, records within a batch by id. A record is rejected if it is similar (see
``neardup``) to one accepted before it; rejected records reject nothing. All of the first batch is
accepted. Several waiting batches are admitted in one pass: history is probed once for all of them, they
are compared with each other once, and the greedy rule runs over the pairs in their order.

Hot buckets: identical word sequences are one node. Of each append, the least node of a bucket leads it. A
batch is probed against the leads first; only records no lead settles meet the other members, so records of
a large group of near copies cost a few comparisons each, and none is left out.

Defined cases: as in ``neardup``; a record without a batch number is no member of any batch and is neither
accepted nor rejected; a record without words is accepted; one with fewer words than a shingle is rejected
only for the identical word sequence; nodes already held may be appended again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import neardup
from corvane.plans.materialize import drop_path, is_empty, materialize, new_path

#: Subfolders of the index, fixed when it is made.
PARTS = 64


def _keyed(sig: DataFrame) -> DataFrame:
    """(key, node) of records with words; those without shingles have the node itself as their only key."""
    once = sig.where("node <> 0").groupBy("node").agg(F.any_value("keys").alias("keys"))
    return neardup.buckets(once.withColumn("keys", F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array("node"))))


class HistoryIndex:
    """Band keys and texts of accepted records under ``path``; a new object on the same path goes on with them."""

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = neardup.THRESHOLD, shingle: int = neardup.SHINGLE, parts: int = PARTS) -> None:
        self.spark, self.threshold, self.shingle, self.parts = spark, threshold, shingle, parts
        self.path = path or new_path(spark, "history")

    def _part(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def _held(self, kind: str, schema: str, wanted: DataFrame) -> DataFrame:
        """Rows of the subfolders that ``wanted`` (part) names, at most ``parts`` numbers."""
        path = f"{self.path}/{kind}"
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], f"{schema}, part int")
        numbers = [r[0] for r in wanted.select("part").distinct().collect()]
        return self.spark.read.schema(f"{schema}, part int").parquet(path).where(F.col("part").isin(numbers))

    def append(self, accepted: DataFrame, docs: DataFrame) -> None:
        """Add accepted records (id, node, keys) whose texts are in ``docs`` (id, text); texts come first, so no key lacks its text."""
        rows = _keyed(accepted)
        texts = neardup.node_texts(docs, accepted, accepted.where("node <> 0").select("node").distinct())
        # of each bucket the least node leads
        least = rows.groupBy("key").agg(F.min("node").alias("least"))
        keys = rows.join(least, "key").select("key", "node", (F.col("node") == F.col("least")).alias("lead"))
        for kind, df, by, order in (("texts", texts, "node", ["node"]), ("keys", keys, "key", ["lead", "key"])):
            spread = df.withColumn("part", self._part(by)).hint("rebalance", "part")
            spread.sortWithinPartitions("part", *order).write.partitionBy("part").option("compression", "zstd").mode("append").parquet(f"{self.path}/{kind}")

    def drop(self) -> None:
        drop_path(self.spark, self.path)

    def _similar(self, hits: DataFrame, sig: DataFrame, docs: DataFrame) -> DataFrame:
        """(new): nodes of pairs (new, old) that are similar; equal nodes are."""
        hits = materialize(hits, "candidates")
        old = hits.where("new <> old").select(F.col("old").alias("node")).distinct().withColumn("part", self._part("node"))
        held = self._held("texts", "node long, text string", old).join(old.select("node"), "node", "left_semi").dropDuplicates(["node"])
        mine = neardup.node_texts(docs, sig, hits.where("new <> old").select(F.col("new").alias("node")).distinct())
        both = hits.where("new <> old").join(mine.select(F.col("node").alias("new"), F.col("text").alias("tn")), "new").join(held.select(F.col("node").alias("old"), F.col("text").alias("to")), "old")
        near = both.where(neardup.similarity("tn", "to", self.shingle) >= self.threshold).select("new")
        return near.union(hits.where("new = old").select("new")).distinct()

    def probe(self, batch: DataFrame, docs: DataFrame) -> DataFrame:
        """(node): nodes of ``batch`` (id, node, keys) similar to an accepted record; its texts are in ``docs`` (id, text)."""
        rows = materialize(_keyed(batch).select("key", F.col("node").alias("new")).withColumn("part", self._part("key")), "probe")
        held = self._held("keys", "key long, node long, lead boolean", rows).withColumnRenamed("node", "old")

        def hits(new: DataFrame, lead: bool) -> DataFrame:
            return held.where(F.col("lead") == lead).join(new, ["part", "key"]).select("new", "old").distinct()

        first = materialize(self._similar(hits(rows, True), batch, docs), "settled")
        second = self._similar(hits(rows.join(first, "new", "left_anti"), False), batch, docs)
        return first.union(second).distinct().withColumnRenamed("new", "node")


def _greedy(edges: DataFrame) -> DataFrame:
    """(node) rejected by greedy acceptance over (node, before) edges, ``before`` standing before ``node``.

    A node is rejected once an accepted neighbour stands before it, accepted once all its neighbours
    before it are rejected; each round settles at least the first open node of every component.
    """
    rejected = None
    edges = materialize(edges, "open")
    empty = edges.select("node").limit(0)
    while not is_empty(edges):
        waiting = edges.select("node").distinct()
        accepted = edges.select(F.col("before").alias("b")).distinct().join(waiting, F.col("b") == F.col("node"), "left_anti")
        out = materialize(edges.join(accepted, F.col("before") == F.col("b"), "left_semi").select("node").distinct(), "rejected")
        rejected = out if rejected is None else rejected.union(out)
        left = edges.join(out, "node", "left_anti")
        edges = materialize(left.join(out.withColumnRenamed("node", "before"), "before", "left_anti").select("node", "before"), "open")
    return rejected if rejected is not None else empty


def admit(index: HistoryIndex, waiting: DataFrame, docs: DataFrame, append: bool = True) -> DataFrame:
    """(id) rejected of the waiting records (id, node, keys[, batch_no]); the others join the index.

    Without ``batch_no`` they are one batch. The first record of a node decides for the node: later ones
    are its exact copies and are rejected in either case.
    """
    at = F.struct(F.col("batch_no") if "batch_no" in waiting.columns else F.lit(0), F.col("id"))
    known = materialize(index.probe(waiting, docs), "known")
    fresh = materialize(waiting.join(known, "node", "left_anti"), "fresh")
    first = materialize(fresh.where("node <> 0").groupBy("node").agg(F.min(at).alias("at")), "first")
    near = neardup.similar_nodes(fresh, docs, index.threshold, index.shingle)
    a, b = (first.select(F.col("node").alias(f"node_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab")
    later = F.col("at_a") > F.col("at_b")
    placed = near.join(a, "node_a").join(b, "node_b")
    edges = placed.select(F.when(later, F.col("node_a")).otherwise(F.col("node_b")).alias("node"), F.when(later, F.col("node_b")).otherwise(F.col("node_a")).alias("before"))
    gone = _greedy(edges)
    old = waiting.join(known, "node", "left_semi").select("id")
    similar = fresh.join(gone, "node", "left_semi").select("id")
    copies = fresh.join(first, "node").where(at > F.col("at")).select("id")
    out = materialize(old.union(similar).union(copies).distinct(), "out")
    if append:
        index.append(waiting.join(out, "id", "left_anti"), docs)
    return out


def rejected(episodes: DataFrame, turns: DataFrame) -> DataFrame:
    """(episode_id) of the rejected records over all batches of ``episodes``, first batch accepted."""
    spark = episodes.sparkSession
    batch_of = episodes.where("id IS NOT NULL AND batch_no IS NOT NULL").groupBy("id").agg(F.min("batch_no").cast("int").alias("batch_no"))
    first, last = batch_of.agg(F.min("batch_no"), F.max("batch_no")).first()
    if first == last:
        return spark.createDataFrame([], "episode_id string")
    docs = materialize(neardup.episode_texts(turns).join(batch_of, "id"), "records")
    sig = neardup.signed(docs, batch="batch_no")
    index = HistoryIndex(spark)
    index.append(sig.where(F.col("batch_no") == first), docs.where(F.col("batch_no") == first))
    new = F.col("batch_no") > first
    out = admit(index, sig.where(new), docs.where(new), append=False)
    index.drop()
    return out.withColumnRenamed("id", "episode_id")
