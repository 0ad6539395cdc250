"""Near-duplicate records: minwise bands, star edges, exact verification.

Texts are reduced to *nodes*, one per distinct word sequence, so any number of exact copies costs one
signature. Nodes that share a band key are linked to the least node of the bucket, the hub (a star, so a
bucket of n nodes gives n - 1 edges, never n^2), and the edges are verified on the full shingle sets.

With t the threshold, a node of similarity t to the hub is in its core, one of 2t - 1 in its halo. By the
triangle inequality of the Jaccard distance everything similar to a core node that shares the bucket is
in the halo, so core nodes are compared with the hub's halo and leave the bucket; the others form a new
star. After ``ROUNDS`` stars what is left of a bucket is compared in full. Nothing is joined through
chains of hubs: a group is what stands around one hub, cut into blocks of bounded size.

Texts are read again for nodes that share a bucket; only ids, nodes and keys are written for all.

Defined cases: null or blank texts and texts with fewer words than a shingle have no shingles; they
are similar only to records with the identical non-empty word sequence. Repeated rows (same
``turn_id``) count once. Columns other than those named are ignored. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.minwise import Signer, jaccard, shingle_set, shingles, word_hashes, words
from corvane.plans.components import components
from corvane.plans.grouped import sorted_group_map
from corvane.plans.materialize import is_empty, materialize

#: Parameters of the operator. Chance to miss a pair of similarity 0.6 in all bands: (1 - 0.6^4)^40.
SHINGLE, THRESHOLD, BANDS, ROWS, BLOCK, ROUNDS = 3, 0.6, 40, 4, 128, 6


def episode_texts(turns: DataFrame) -> DataFrame:
    """(id, text): contents of an episode's turns by turn_no, joined with a blank, each turn once."""
    turn = F.struct(F.col("turn_no"), F.col("turn_id"), F.coalesce("content", F.lit("")).alias("content"))
    return (
        turns.where("episode_id IS NOT NULL")
        .groupBy(F.col("episode_id").alias("id"))
        .agg(F.array_sort(F.collect_set(turn)).alias("t"))
        .select("id", F.array_join(F.col("t.content"), " ").alias("text"))
    )


def signed(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, batch: str | None = None) -> DataFrame:
    """(id, text) -> (id, node, keys ARRAY<BIGINT>); written once, since several jobs read it.

    ``batch`` names an INT column to keep. Texts without words have node 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(bands, rows)
        for b in batches:
            nodes, sets = np.zeros(len(b), np.int64), []
            for i, t in enumerate(b["text"]):
                h = word_hashes(words(t))
                nodes[i] = np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)) if len(h) else 0
                sets.append(shingles(h, shingle))
            out = pd.DataFrame({"id": b["id"], "node": nodes, "keys": signer.keys(sets)})
            yield out.assign(**{batch: b[batch]}) if batch else out

    schema = "id string, node long, keys array<long>" + (f", {batch} int" if batch else "")
    return materialize(docs.select("id", "text", *([batch] if batch else [])).mapInPandas(run, schema), "signed")


def buckets(nodes: DataFrame) -> DataFrame:
    """(node, keys) -> one row (key, node) per band; nodes without keys give none."""
    return nodes.select("node", F.explode("keys").alias("key"))


def distinct_nodes(sig: DataFrame) -> DataFrame:
    return sig.where("size(keys) > 0").groupBy("node").agg(F.any_value("keys").alias("keys"))


def _star(rows: DataFrame) -> DataFrame:
    """Bucket rows (key, node) with the bucket's least node as ``hub``; hubs themselves and lone nodes leave."""
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("__last")).where("hub <> __last").drop("__last")
    return rows.join(hubs, "key").where("hub <> node")


def node_texts(docs: DataFrame, sig: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) for the given nodes: the text of one record each, read from ``docs`` (id, text)."""
    of = sig.select("id", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    wanted = docs.join(of.select("id"), "id", "left_semi").select("id", "text")
    return wanted.join(of, "id").select("node", "text")


def similarity(x: str, y: str, shingle: int = SHINGLE):
    """Column: exact Jaccard similarity of the shingle sets of two text columns."""

    @F.pandas_udf("double")
    def sim(x: pd.Series, y: pd.Series) -> pd.Series:
        seen: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            if t not in seen:
                seen[t] = shingle_set(t, shingle)
            return seen[t]

        return pd.Series([jaccard(of(p), of(q)) for p, q in zip(x, y)], dtype="float64")

    return sim(x, y)


def with_similarity(edges: DataFrame, texts: DataFrame, a: str, b: str, shingle: int = SHINGLE) -> DataFrame:
    """``edges`` with ``sim``, the exact Jaccard similarity of the shingle sets of nodes ``a``, ``b``."""
    left = texts.select(F.col("node").alias(a), F.col("text").alias("__ta"))
    right = texts.select(F.col("node").alias(b), F.col("text").alias("__tb"))
    return edges.join(left, a).join(right, b).withColumn("sim", similarity("__ta", "__tb", shingle)).drop("__ta", "__tb")


def _around(members: DataFrame, texts: DataFrame, threshold: float, shingle: int, block: int, core_pairs: bool) -> DataFrame:
    """Similar pairs (node_a, node_b, sim) of a core node with any other of its group (grp, node, core), in blocks."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("cores"))
    sizes = sizes.where((F.col("cores") > 0) & (F.col("n") > (F.lit(1) if core_pairs else F.col("cores"))))
    last = F.ceil(F.col("n") / block).cast("int") - 1
    # a block meets every other block of its group once: keys (low block, high block)
    place = members.join(sizes.select("grp", last.alias("last")), "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    spread = place.select("grp", "node", "core", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")).select(
        "grp", "node", "core", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        sets: dict[int, np.ndarray] = {}
        for (_, lo, hi), part in g.groupby(["grp", "lo", "hi"], sort=False):
            items = []
            for n, b, c, t in sorted(zip(part["node"], part["block"], part["core"], part["text"])):
                if n not in sets:
                    sets[n] = shingle_set(t, shingle)
                items.append((n, b, c, sets[n]))
            for x, (na, ba, ca, sa) in enumerate(items):
                for nb, bb, cb, sb in items[x + 1 :]:
                    if not (ca or cb) or not core_pairs and ca and cb or lo != hi and ba == bb or min(len(sa), len(sb)) < threshold * max(len(sa), len(sb)):
                        continue
                    if (s := jaccard(sa, sb)) >= threshold:
                        out[0].append(na), out[1].append(nb), out[2].append(s)
        return pd.DataFrame({"node_a": np.array(out[0], np.int64), "node_b": np.array(out[1], np.int64), "sim": np.array(out[2], np.float64)})

    return sorted_group_map(spread.join(texts, "node"), ["grp", "lo", "hi"], ["node"], compare, "node_a long, node_b long, sim double")


def similar_nodes(
    sig: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK, core_pairs: bool = True, rounds: int = ROUNDS
) -> DataFrame:
    """(node_a, node_b, sim), node_a < node_b: the pairs of nodes found with similarity >= threshold, each once.

    Without ``core_pairs`` those of two core nodes of a hub are left out: the hub connects them.
    """
    rows = materialize(_star(buckets(distinct_nodes(sig))), "stars")
    if is_empty(rows):
        return sig.sparkSession.createDataFrame([], "node_a long, node_b long, sim double")
    texts = materialize(node_texts(docs, sig, rows.select(F.explode(F.array("hub", "node")).alias("node")).distinct()), "texts")
    edges = []
    for _ in range(rounds):
        sim = materialize(with_similarity(rows.select("hub", "node").distinct(), texts, "hub", "node", shingle).select("hub", "node", "sim"), "edges")
        edges.append(sim.where(F.col("sim") >= 2 * threshold - 1))
        rest = rows.join(sim.where(F.col("sim") < threshold), ["hub", "node"], "left_semi").select("key", "node")
        rows = materialize(_star(rest), "stars")
        if is_empty(rows):
            break
    near = reduce(DataFrame.union, edges).groupBy("hub", "node").agg(F.max("sim").alias("sim"))
    near = materialize(near, "near")
    members = near.select(F.col("hub").alias("grp"), "node", (F.col("sim") >= threshold).alias("core"))
    found = _around(members, texts, threshold, shingle, block, core_pairs)
    if not is_empty(rows):
        left = rows.select(F.col("key").alias("grp"), F.explode(F.array("hub", "node")).alias("node")).distinct()
        found = found.union(_around(left.withColumn("core", F.lit(True)), texts, threshold, shingle, block, True))
    star = near.where(F.col("sim") >= threshold).select(F.col("hub").alias("node_a"), F.col("node").alias("node_b"), "sim")
    return star.union(found).groupBy("node_a", "node_b").agg(F.max("sim").alias("sim"))


def similar_pairs(sig: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records with similarity >= threshold, copies included."""
    member = sig.select("id", "node").where("node <> 0")
    a = member.select(F.col("id").alias("ia"), F.col("node").alias("node_a"))
    b = member.select(F.col("id").alias("ib"), F.col("node").alias("node_b"))
    near = materialize(similar_nodes(sig, docs, threshold, shingle), "pairs")
    across = near.join(a, "node_a").join(b, "node_b").select("ia", "ib")
    copies = a.join(b, (F.col("node_a") == F.col("node_b")) & (F.col("ia") < F.col("ib"))).select("ia", "ib")
    return across.union(copies).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def groups(sig: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(id, group_id): one row a record; records linked by similar pairs share the least id as group."""
    near = similar_nodes(sig, docs, threshold, shingle, core_pairs=False)
    comp = components(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    rep = sig.select("id", "node").join(comp, "node", "left").withColumn(
        "g", F.when(F.col("node") == 0, F.xxhash64("id")).otherwise(F.coalesce("comp", "node"))
    )
    least = rep.groupBy("g").agg(F.min("id").alias("group_id"))
    return rep.join(least, "g").select("id", "group_id")
