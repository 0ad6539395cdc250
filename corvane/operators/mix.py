"""Sampling, mixing, capping, packing and schema fingerprints; all deterministic by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.plans.ranking import rank_in_group


def _hashed(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def holdout(df: DataFrame, key: str, share: float, least: int, seed: int) -> DataFrame:
    """max(least, ceil(share n)) keys, at most n, in hash order."""
    n = df.count()
    size = min(n, max(least, -int(-share * n // 1)))
    return df.select(key).orderBy(_hashed(seed, key), key).limit(size)


def fingerprint(df: DataFrame, json: str) -> DataFrame:
    """(fields, fingerprint): digest of the sorted ``key:type`` lines of a JSON column."""
    v = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("k", "v"))
    kind = (
        F.when(F.col("v").isNull(), "null").when(F.col("v").rlike(r"^-?\d+$"), "int").when(F.col("v").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "float")
        .when(F.col("v").isin("true", "false"), "bool").otherwise("str")
    )
    by = v.groupBy("k").agg(F.when(F.countDistinct(kind) > 1, "mixed").otherwise(F.min(kind)).alias("t"))
    rows = F.array_sort(F.collect_list(F.concat_ws(":", "k", "t")))
    return by.agg(F.count(F.lit(1)).alias("fields"), F.sha2(F.array_join(rows, "\n"), 256).alias("fingerprint"))


def oversample(df: DataFrame, times: Column) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def cap_shares(df: DataFrame, source: str, key: str, size: str, caps: dict[str, float]) -> DataFrame:
    """Records of capped sources in key order while their running size stays within the share of the total."""
    total = df.agg(F.sum(size).alias("_total"))
    free = df.where(~F.col(source).isin(*caps))
    limit = F.lit(None).cast("double")
    for s, share in caps.items():
        limit = F.when(F.col(source) == s, F.lit(share)).otherwise(limit)
    ranked = rank_in_group(df.where(F.col(source).isin(*caps)), source, [key], "_i", total=size, running="_run").drop("_i")
    bound = ranked.crossJoin(F.broadcast(total)).where(F.col("_run") <= limit * F.col("_total")).drop("_run", "_total")
    return free.unionByName(bound)


def two_way(df: DataFrame, source: str, key: str, size: str, minor: str, share: float) -> DataFrame:
    """(src, records, tokens) of the largest mix in which ``minor`` has ``share`` of the expected tokens."""
    x = df.withColumn("tk", F.floor(F.col(size) / 4).cast("long"))
    want = F.when(F.col(source) == minor, F.lit(share)).otherwise(F.lit(1 - share))
    total = x.groupBy(source).agg(F.sum("tk").alias("have")).agg(F.min(F.col("have") / want).alias("total"))
    return rank_in_group(x, source, [key], "_i", total="tk", running="run").crossJoin(F.broadcast(total)).where(F.col("run") <= F.col("total") * want).groupBy(F.col(source).alias("src")).agg(F.count(F.lit(1)).alias("records"), F.sum("tk").alias("tokens"))


def phase(steps: DataFrame, t: str, n: int) -> DataFrame:
    """Stream of each step while the second stream's rate rises from 0 to 1 over ``n`` steps."""
    upto = F.floor((F.col(t) + 1) * (F.col(t) + 2) / F.lit(2 * n))
    before = F.floor(F.col(t) * (F.col(t) + 1) / F.lit(2 * n))
    return steps.select(t, F.when(upto > before, "Q").otherwise("W").alias("stream"))


def context_lengths(df: DataFrame, key: str, size: str, short: int = 8192, long: int = 65536, turn: float = 0.9) -> DataFrame:
    """Context length by the share of the corpus consumed before each record."""
    total = df.agg(F.sum(size).alias("_total"))
    run = rank_in_group(df, None, [key], "_i", total=size, running="_run")
    return run.crossJoin(F.broadcast(total)).select(key, F.when(F.col("_run") - F.coalesce(F.col(size), F.lit(0)) < turn * F.col("_total"), short).otherwise(long).alias("context"))


def pack(df: DataFrame, ids: str, length: int, bos: int = 1, eos: int = 2, pad: int = 0) -> DataFrame:
    """``inputs`` and ``labels`` of length - 1: opening, ids cut to length - 2, end, padding; labels are one ahead."""
    seq = F.concat(F.array(F.lit(bos)), F.slice(F.col(ids), 1, length - 2), F.array(F.lit(eos)))
    full = F.slice(F.concat(seq, F.array_repeat(F.lit(pad), length)), 1, length)
    return df.withColumn("_full", full).withColumn("inputs", F.slice("_full", 1, length - 1)).withColumn("labels", F.slice("_full", 2, length - 1)).drop("_full")


def length_batches(df: DataFrame, key: str, size: str, batch: int) -> DataFrame:
    """(key, batch, padding): batches of records alike in size, with the padding of each."""
    n = rank_in_group(df, None, [size, key], "_n").withColumn("batch", F.floor(F.col("_n") / batch).cast("long"))
    longest = n.groupBy("batch").agg(F.max(size).alias("_top"))
    return n.join(longest, "batch").select(key, "batch", (F.col("_top") - F.col(size)).alias("padding"))


def corridor_sample(df: DataFrame, key: str, rate: str, n: int, seed: int) -> DataFrame:
    """``n`` keys with weight 1 - rate, without replacement; rates 0 and 1 are out."""
    inside = df.where((F.col(rate) > 0) & (F.col(rate) < 1))
    return inside.orderBy(F.desc(F.ln(tx.coin(seed, F.col(key))) / (1 - F.col(rate))), key).limit(n).select(key)


def windowed_shuffle(df: DataFrame, key: str, window: int, seed: int) -> DataFrame:
    """(key, pos): key order shuffled by hash inside windows of ``window`` records."""
    w = rank_in_group(df.select(key), None, [key], "_i").select(key, F.floor(F.col("_i") / window).alias("_w"), _hashed(seed, key).alias("_h"))
    return rank_in_group(w, "_w", ["_h", key], "_j").select(key, (F.col("_w") * window + F.col("_j")).cast("long").alias("pos"))


def sized_sample(df: DataFrame, source: str, key: str, size: str, total: int, shares: dict[str, float], seed: int) -> DataFrame:
    """Records in hash order while each source stays within its share of ``total``."""
    share = F.lit(0.0)
    for s, v in shares.items():
        share = F.when(F.col(source) == s, F.lit(v)).otherwise(share)
    hashed = df.where(F.col(source).isin(*shares)).select(key, source, size, _hashed(seed, key).alias("_h"))
    ranked = rank_in_group(hashed, source, ["_h", key], "_i", total=size, running="_run")
    return ranked.where(F.col("_run") <= share * total).select(key, F.col(source).alias("src"))


def fractions(df: DataFrame, group: str, share: str) -> DataFrame:
    """``df`` with ``share`` as a fraction of 1: shares of a group that add up to more than 1.5 are percent."""
    total = df.groupBy(F.col(group).alias("_g")).agg(F.sum(share).alias("_t"))
    j = df.join(total, F.col(group).eqNullSafe(F.col("_g")), "left")
    return j.withColumn(share, F.when(F.col("_t") > 1.5, F.col(share) / 100.0).otherwise(F.col(share))).drop("_g", "_t")
