"""Exact and near deduplication with defined survivors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.plans.materialize import is_empty, materialize

#: Modulus of the affine hash family and its seeds' multiplier (fixed values).
PRIME, STRIDE = (1 << 31) - 1, 48271


def exact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, copies): the least key of each normal form."""
    fp = F.sha2(tx.normal(F.col(text)), 256).alias("fp")
    return df.where(F.col(text).isNotNull()).groupBy(fp).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).select(key, "fp", "copies")


def pooled(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Survivors over a joint pool: the least key tuple of each normal form."""
    return df.groupBy(F.sha2(tx.normal(F.col(text)), 256).alias("fp")).agg(F.min(F.struct(*keys)).alias("k")).select("k.*")


def lines(df: DataFrame, key: str, text: str, source: Column, first: str = "skill", least: int = 40) -> DataFrame:
    """(src, lines, repeated): lines of at least ``least`` characters that a record of higher priority holds already."""
    rows = df.select(source.alias("src"), F.col(key).alias("k"), F.explode(F.split(text, "\n")).alias("line")).withColumn("line", F.trim("line")).where(F.length("line") >= least)
    rank = F.struct(F.when(F.col("src") == first, 0).otherwise(1).alias("r"), F.col("k"))
    best = rows.groupBy("line").agg(F.min(rank).alias("best"))
    return rows.join(best, "line").groupBy("src").agg(F.count(F.lit(1)).alias("lines"), F.count_if(rank != F.col("best")).alias("repeated"))


def merge_candidates(known: DataFrame, new: DataFrame, fp: str) -> DataFrame:
    """(added, skipped): distinct new fingerprints by whether they are known."""
    k = known.select(fp).distinct().withColumn("_known", F.lit(1))
    return new.select(fp).distinct().join(k, fp, "left").agg(F.count_if(F.col("_known").isNull()).alias("added"), F.count("_known").alias("skipped"))


def signature(grams: Column, hashes: int) -> Column:
    """Least value of each of ``hashes`` affine hashes over an array of strings, each hashed once to 31 bits."""

    @F.pandas_udf("array<long>")
    def least(s: pd.Series) -> pd.Series:
        k = np.arange(hashes)
        a = np.array([pow(STRIDE, int(i) + 1, PRIME) for i in k], np.int64)[:, None]
        b = np.array([pow(STRIDE, 2 * int(i) + 3, PRIME) for i in k], np.int64)[:, None]
        return pd.Series([((a * np.asarray(h, np.int64) + b) % PRIME).min(axis=1) if len(h) else np.empty(0, np.int64) for h in s])

    return least(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(PRIME))))


def estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def near_pairs(df: DataFrame, key: str, text: str, shingle: int = 5, bands: int = 16, rows: int = 4, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of representatives of exact forms, a < b, whose shingle sets are alike >= threshold.

    Records that share a band are linked to the least key of the bucket, the hub. Those below the threshold form
    a new star, those above are compared with all that are at least 2 threshold - 1 alike the hub: by the triangle
    inequality of the Jaccard distance no similar pair of a bucket is lost.
    """
    words = exact(df, key, text).select(key).join(df, key).select(key, tx.words(F.col(text)).alias("w"))
    reps = materialize(words.select(F.col(key).alias("k"), F.array_distinct(tx.ngrams(F.col("w"), shingle)).alias("g")), "grams").where(F.size("g") > 0)
    signed = materialize(reps.select("k", signature(F.col("g"), bands * rows).alias("s")), "signatures")
    band = F.array(*[F.xxhash64(F.lit(i), *[F.col("s")[i * rows + j] for j in range(rows)]) for i in range(bands)])

    def star(x: DataFrame) -> DataFrame:
        hub = x.groupBy("band", "bucket").agg(F.min("k").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return materialize(x.join(hub, ["band", "bucket"]).where("k > hub"), "stars")

    def alike(pairs: DataFrame) -> DataFrame:
        common = F.size(F.array_intersect("ga", "gb"))
        both = pairs.join(reps.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(reps.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b")
        return both.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity"))

    open_rows, links = star(signed.select("k", F.posexplode(band).alias("band", "bucket"))), None
    while not is_empty(open_rows):
        sim = materialize(alike(open_rows.select(F.col("hub").alias("a"), F.col("k").alias("b")).distinct()), "edges")
        near = sim.where(F.col("similarity") >= 2 * threshold - 1)
        links = near if links is None else links.union(near)
        rest = sim.where(F.col("similarity") < threshold).select(F.col("a").alias("hub"), F.col("b").alias("k"))
        open_rows = star(open_rows.join(rest, ["hub", "k"], "left_semi").select("k", "band", "bucket"))
    if links is None:
        return reps.select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("similarity")).limit(0)
    links = materialize(links.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")
    # what is similar to a record that is similar to the hub is at least 2 threshold - 1 alike the hub
    core = links.where(F.col("similarity") >= threshold).select(F.col("a").alias("hub"), F.col("b").alias("x"))
    around = core.join(links.select(F.col("a").alias("hub"), F.col("b").alias("y")), "hub").where("x <> y")
    more = around.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(links, ["a", "b"], "left_anti")
    return links.union(alike(more)).where(F.col("similarity") >= threshold)


def near_prior(df: DataFrame, prior: DataFrame, key: str, text: str, shingle: int = 5, bands: int = 16, rows: int = 4, threshold: float = 0.8, first: int = 50_000) -> DataFrame:
    """(key) of candidates alike >= threshold one of the ``first`` prior records by key; candidates never join the index.

    The bound on the prior records is the operator's own: they are the beginning of a stream that is read once.
    """

    def grams(d: DataFrame, k: str) -> DataFrame:
        w = d.select(F.col(key).alias(k), tx.words(F.col(text)).alias("w"))
        # written before the filter, which would else be evaluated with the words inlined
        g = materialize(w.select(k, F.array_distinct(tx.ngrams(F.col("w"), shingle)).alias(f"g_{k}")), "grams")
        return g.where(F.size(f"g_{k}") > 0)

    mine, held = grams(df, "k"), grams(prior.orderBy(key).limit(first), "p")

    def keyed(d: DataFrame, k: str) -> DataFrame:
        signed = materialize(d.select(k, signature(F.col(f"g_{k}"), bands * rows).alias("s")), "signatures")
        return signed.select(k, F.posexplode(F.array(*[F.xxhash64(F.lit(i), *[F.col("s")[i * rows + j] for j in range(rows)]) for i in range(bands)])).alias("band", "bucket"))

    hit = keyed(mine, "k").join(keyed(held, "p"), ["band", "bucket"]).select("k", "p").distinct()
    common = F.size(F.array_intersect("g_k", "g_p"))
    both = hit.join(mine, "k").join(held, "p")
    return both.where(common / (F.size("g_k") + F.size("g_p") - common) >= threshold).select(F.col("k").alias(key)).distinct()


def near_rate(df: DataFrame, key: str, text: str) -> DataFrame:
    """(n_records, n_exact, n_near, rate): records dropped as exact copies, and as near copies of a lesser key."""
    base = exact(df, key, text).agg(F.sum("copies").alias("n_records"), F.count(F.lit(1)).alias("kept"))
    near = near_pairs(df, key, text).agg(F.countDistinct("b").alias("n_near"))
    return base.crossJoin(F.broadcast(near)).select("n_records", (F.col("n_records") - F.col("kept")).alias("n_exact"), "n_near", F.round((F.col("n_records") - F.col("kept") + F.col("n_near")) / F.col("n_records"), 6).alias("rate"))
