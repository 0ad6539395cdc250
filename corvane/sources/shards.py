"""Shard sinks with manifests and packed token files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of the written files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def config_digest(options: dict) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()


def refuse_changed(manifest: DataFrame, options: dict) -> None:
    """An error if the shards of the manifest were written under other options."""
    other = manifest.where(~F.col("config").eqNullSafe(F.lit(config_digest(options))))
    if other.limit(1).take(1):
        raise ValueError("the shards were written with a different configuration")


def sorted_jsonl(df: DataFrame, path: str, *order: str) -> str:
    """Write a bounded set of records as one sorted JSON lines file; its SHA-256 is the pin."""
    lines = df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.coalesce(1).write.text(path)
    return hashes(df.sparkSession, path).first()["sha256"]


def write(df: DataFrame, path: str, rows: int, options: dict | None = None) -> DataFrame:
    """Write shards of at most ``rows`` records, committed as a whole; manifest (file, sha256, bytes, records, config)."""
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("records"))
    manifest = hashes(spark, path).join(counts, "file").withColumn("config", F.lit(config_digest(options or {})))
    manifest.write.parquet(path + "-manifest")
    return spark.read.parquet(path + "-manifest")


def verify(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, records, ok): whether each shard still has its digest; missing files fail."""
    now = hashes(spark, path).select("file", F.col("sha256").alias("now"))
    return manifest.join(now, "file", "left").select("file", "records", F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)).alias("ok"))


def bad_shards(verified: DataFrame) -> DataFrame:
    """(all_match, bad): whether every shard matches, and the names of those that do not."""
    return verified.agg(F.bool_and("ok").alias("all_match"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("file")))).alias("bad"))


def spot_check(spark: SparkSession, path: str, manifest: DataFrame, n: int, seed: int) -> DataFrame:
    """(checked, all_match) over ``n`` shards chosen by hash."""
    some = manifest.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), "file"), 256)).limit(n)
    return verify(spark, path, some).agg(F.count(F.lit(1)).alias("checked"), F.bool_and("ok").alias("all_match"))


def totals(manifests: DataFrame, streams: list[str]) -> DataFrame:
    """Tokens per stream (``stream_tokens``, else ``tokens``); the total only if every stream is there."""
    t = manifests.groupBy("stream").agg(F.sum(F.coalesce("stream_tokens", "tokens")).alias("tokens"))
    return t.where(F.col("stream").isin(*streams)).agg(F.when(F.count(F.lit(1)) == len(streams), F.sum("tokens")).alias("total"), F.sort_array(F.collect_list("stream")).alias("present"))


def resume(done: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records behind the cursor of a manifest with ``source_records`` (keys below it are written)."""
    cursor = done.agg(F.coalesce(F.max("source_records"), F.lit(0)).alias("cursor"))
    return records.crossJoin(F.broadcast(cursor)).where(F.col(key) >= F.col("cursor")).drop("cursor")


def write_packed(ids: DataFrame, path: str, shard: str, token: str) -> None:
    """One row a chunk of unsigned 32-bit little-endian tokens, by shard."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, g in b.groupby("shard"):
                yield pd.DataFrame({"shard": [str(s)], "data": [g["token"].to_numpy().astype("<u4").tobytes()]})

    ids.select(F.col(shard).alias("shard"), F.col(token).alias("token")).mapInPandas(pack, "shard string, data binary").write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(shard, token) of packed chunks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, data in zip(b["shard"], b["data"]):
                yield pd.DataFrame({"shard": s, "token": np.frombuffer(data, "<u4").astype("int64")})

    return spark.read.parquet(path).mapInPandas(unpack, "shard string, token long")


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(shard, pos, token) of raw ``.bin`` files."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                t = np.frombuffer(data, "<u4").astype("int64")
                yield pd.DataFrame({"shard": p.rsplit("/", 1)[-1], "pos": np.arange(len(t)), "token": t})

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return f.mapInPandas(unpack, "shard string, pos long, token long")
