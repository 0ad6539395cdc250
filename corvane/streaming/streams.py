"""Structured Streaming forms: bounded-state dedup, guards, last-write-wins, budgets, resumable sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Files of a folder as they arrive; a bounded number a trigger keeps state and memory bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def guarded(stream: DataFrame, *values: str) -> tuple[DataFrame, DataFrame]:
    """(rows with finite values, rows to quarantine)."""
    bad = F.lit(False)
    for v in values:
        bad = bad | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = F.coalesce(bad, F.lit(False))
    return stream.where(~bad), stream.where(bad)


def windowed(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, key, n, total) of event-time windows."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return s.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def newest(stream: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Last write wins per key: emits a row whenever a key's newest version changes."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for b in batches:
            top = b.loc[b["version"].idxmax()]
            if best is None or top["version"] >= best[0]:
                best = (int(top["version"]), float(top["value"]))
        if best is not None and (not state.exists or best != tuple(state.get)):
            state.update(best)
            yield pd.DataFrame({"key": [k[0]], "version": [best[0]], "value": [best[1]]})

    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(version).cast("long").alias("version"), F.col(value).cast("double").alias("value"))
    return slim.groupBy("key").applyInPandasWithState(step, "key string, version long, value double", "version long, value double", "update", GroupStateTimeout.NoTimeout)


def spend(stream: DataFrame, hours: str, rate: float | None) -> DataFrame:
    """Greatest running counter times the rate; an unknown rate gives no number but a status."""
    top = stream.groupBy().agg(F.max(hours).alias("hours"))
    if rate is None:
        return top.select("hours", F.lit(None).cast("double").alias("spend"), F.lit("unverified").alias("status"))
    return top.select("hours", (F.col("hours") * rate).alias("spend"), F.lit("ok").alias("status"))


def resumable(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to ``path`` exactly once; a restart goes on behind the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_within(query: StreamingQuery, minutes: float, stop: Callable[[StreamingQuery], bool] | None = None) -> str:
    """Let an available-now query end, or stop it at its time budget or own condition; the reason."""
    end = time.monotonic() + minutes * 60
    while query.isActive:
        if time.monotonic() > end:
            query.stop()
            return "time budget"
        if stop is not None and stop(query):
            query.stop()
            return "condition"
        query.awaitTermination(1)
    return "source exhausted"
