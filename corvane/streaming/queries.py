"""Streams run to their end over the events, and the tables they leave; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.tables import table
from corvane.plans.materialize import new_path
from corvane.streaming import streams

_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _arrived(spark: SparkSession, d: str, path: str, doubled: bool = False) -> None:
    """Events as files in order of time; ``doubled`` delivers a part of them again in the same file."""
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), "ts", F.col("user_id").cast("long").alias("user_id"), "event_type", "value")
    if doubled:
        e = e.unionByName(e.where("event_id % 5 = 0"))
    e.repartitionByRange(4, "ts", "event_id").write.mode("append").parquet(path)


def _table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    streams.resumable(stream, out, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _paths(spark: SparkSession) -> tuple[str, str, str]:
    base = new_path(spark, "stream")
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered events once, with state bounded by a watermark."""
    src, out, cp = _paths(spark)
    _arrived(spark, d, src, doubled=True)
    t = _table(streams.deduplicated(streams.source(spark, src, _SCHEMA), ["event_id"], "ts", "60 days"), out, cp)
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def stream_guard(spark: SparkSession, d: str) -> DataFrame:
    """Finite readings go on, the others to quarantine."""
    src, out, cp = _paths(spark)
    _arrived(spark, d, src)
    s = streams.source(spark, src, _SCHEMA)
    hurt = s.withColumn("value", F.when(F.col("event_id") % 100 == 1, F.lit(float("nan"))).when(F.col("event_id") % 100 == 2, F.lit(float("inf"))).otherwise(F.col("value")))
    good, bad = streams.guarded(hurt, "value")
    kept, held = _table(good, out, cp), _table(bad, out + "-bad", cp + "-bad")
    return kept.agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("kept")).unionByName(held.agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("quarantine")))


def stream_resumed(spark: SparkSession, d: str) -> DataFrame:
    """A stream stopped and started again behind its checkpoint: nothing lost, nothing twice."""
    src, out, cp = _paths(spark)
    _arrived(spark, d, src)
    _table(streams.source(spark, src, _SCHEMA), out, cp)
    e = table(spark, d, "events").select((F.col("event_id") + 10_000_000).cast("long").alias("event_id"), "ts", F.col("user_id").cast("long").alias("user_id"), "event_type", "value").where("event_type = 'click'")
    e.write.mode("append").parquet(src)
    t = _table(streams.source(spark, src, _SCHEMA), out, cp)
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("distinct"))


def stream_newest(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping writes of a key: the newest wins."""
    src, out, cp = _paths(spark)
    _arrived(spark, d, src)
    changed = streams.newest(streams.source(spark, src, _SCHEMA, files_per_trigger=1), "user_id", "event_id", "value")
    query = changed.writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", cp).trigger(availableNow=True).start()
    query.awaitTermination()
    t = spark.read.schema("key string, version long, value double, batch long").parquet(out)
    return t.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.max("version").alias("version"), F.round(F.max_by("value", "version"), 6).alias("value"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, one record at a time with bounded state; the open windows are closed by a last mark."""
    src, out, cp = _paths(spark)
    _arrived(spark, d, src)
    end = table(spark, d, "events").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    s = streams.source(spark, src, _SCHEMA)
    t = _table(streams.windowed(s, "ts", "event_type", "value").select("window.start", "event_type", "n", "total"), out, cp)
    end.select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")).write.mode("append").parquet(src)
    t = _table(streams.windowed(streams.source(spark, src, _SCHEMA), "ts", "event_type", "value").select("window.start", "event_type", "n", "total"), out, cp)
    return t.where("event_type <> 'end'").select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_spend(spark: SparkSession, d: str) -> DataFrame:
    """The greatest running counter times the rate; without a rate no number but a status."""
    src, out, cp = _paths(spark)
    _arrived(spark, d, src)
    got = None
    for i, rate in enumerate((1.5, None)):
        s = streams.spend(streams.source(spark, src, _SCHEMA), "value", rate)
        q = s.writeStream.outputMode("complete").foreachBatch(lambda b, _, i=i: b.write.mode("overwrite").parquet(f"{out}-{i}")).option("checkpointLocation", f"{cp}-{i}").trigger(availableNow=True).start()
        q.awaitTermination()
        t = spark.read.schema("hours double, spend double, status string").parquet(f"{out}-{i}")
        got = t if got is None else got.unionByName(t)
    return got.select(F.round("hours", 4).alias("hours"), F.round("spend", 4).alias("spend"), "status")


QUERIES = {f.__name__: f for f in (stream_dedup, stream_guard, stream_resumed, stream_newest, stream_windows, stream_spend)}
SQL = {
    "stream_dedup": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "stream_guard": "SELECT count(*) AS n, 'kept' AS state FROM events WHERE event_id % 100 NOT IN (1, 2) UNION ALL SELECT count(*), 'quarantine' FROM events WHERE event_id % 100 IN (1, 2)",
    "stream_resumed": "SELECT event_type, count(*) * CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS n, count(*) * CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS distinct FROM events GROUP BY 1",
    "stream_newest": "SELECT user_id, max(event_id) AS version, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1",
    "stream_windows": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_spend": "SELECT round(max(value), 4) AS hours, round(max(value) * 1.5, 4) AS spend, 'ok' AS status FROM events UNION ALL SELECT round(max(value), 4), NULL, 'unverified' FROM events",
}
