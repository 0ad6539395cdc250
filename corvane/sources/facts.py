"""Append-only fact histories: one canonical JSON line a record, each with the digest of the line before it.

A line holds the sorted fields of ``FIELDS``; ``prev_sha256`` is the SHA-256 of the sensor's line before it
with its line end, null for the first. An append goes on from the last line of each sensor in the folder, so
a changed, lost or reordered line shows at the record behind it.

Defined cases: new records of a sensor are taken in order of ``seq`` and must lie behind those held (a
lower one stops the append); null values stay null; an empty append writes nothing that counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import series
from corvane.plans.materialize import path_exists

REQUIRED = ("sensor", "fact", "value", "seq")
FIELDS = (*REQUIRED, "prev_sha256")
SCHEMA = "sensor string, fact string, value double, seq long, prev_sha256 string"


def line_of(record: dict) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(line: str) -> str:
    return hashlib.sha256((line + "\n").encode()).hexdigest()


def append(facts: DataFrame, path: str) -> None:
    """Write facts as chained lines after those already there; a sensor's records pass one task in order, none is held."""
    missing = [c for c in REQUIRED if c not in facts.columns]
    if missing:
        raise ValueError(f"facts lack {missing}")
    spark = facts.sparkSession
    new = facts.select("sensor", "fact", F.col("value").cast("double").alias("value"), F.col("seq").cast("long").alias("seq"))
    if path_exists(spark, path):
        held = read(spark, path).groupBy(F.col("sensor").alias("__s")).agg(F.max_by("raw", "seq").alias("__last"), F.max("seq").alias("__at"))
        new = new.join(held, F.col("sensor").eqNullSafe(F.col("__s")), "left").drop("__s")
        late = F.raise_error(F.lit("a record lies before those held")).cast("long")
        new = new.withColumn("seq", F.when(F.col("seq") <= F.col("__at"), late).otherwise(F.col("seq"))).drop("__at")
    else:
        new = new.withColumn("__last", F.lit(None).cast("string"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, prev = object(), None
        for b in batches:
            out = []
            for sensor, fact, value, seq, last in zip(b["sensor"], b["fact"], b["value"], b["seq"], b["__last"]):
                if sensor != of:
                    of, prev = sensor, digest(last) if isinstance(last, str) else None
                line = line_of({"sensor": sensor, "fact": fact, "value": None if value != value else value, "seq": int(seq), "prev_sha256": prev})
                out.append(line)
                prev = digest(line)
            yield pd.DataFrame({"value": out})

    new.repartition("sensor").sortWithinPartitions("sensor", "seq").mapInPandas(link, "value string").write.mode("append").text(path)


def parsed(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Fields of lines and the line itself as ``raw``; a broken line stops the read."""
    return lines.select(F.from_json(raw, SCHEMA, {"mode": "FAILFAST"}).alias("r"), F.col(raw).alias("raw")).select("r.*", "raw")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def intact(facts: DataFrame) -> DataFrame:
    """(sensor, intact, broken) of read facts: whether each line holds the digest of the line before it."""
    return series.chain_breaks(facts, "sensor", "raw", "prev_sha256", "seq")


def raw_ref_violations(path: Column, sha256: Column, selector: Column) -> Column:
    """Violations of a reference to raw data: a path, 64 hexadecimal digits, a selector (empty for the whole file)."""
    bad_path = F.coalesce(F.trim(path) == "", F.lit(True))
    bad_sha = ~F.coalesce(F.lower(sha256).rlike("^[0-9a-f]{64}$"), F.lit(False))
    found = F.array(F.when(bad_path, "path"), F.when(bad_sha, "sha256"), F.when(selector.isNull(), "selector"))
    return F.array_compact(found)


def latest(facts: DataFrame) -> DataFrame:
    """The last record of each sensor and fact."""
    return series.last_wins(facts, ["sensor", "fact"], "seq")


def matching(facts: DataFrame, subject: dict[str, str | None]) -> DataFrame:
    """Facts whose subject agrees with every given key; a null reference value matches anything."""
    for k, v in subject.items():
        if v is not None:
            facts = facts.where(F.col(k) == v)
    return facts


def derived(facts: DataFrame, inputs: list[str], formula: str) -> DataFrame:
    """(value, status): a formula over the latest values of ``inputs``; missing ones make it unverified."""
    wide = latest(facts).where(F.col("fact").isin(*inputs)).groupBy().pivot("fact", inputs).agg(F.first("value"))
    known = F.lit(True)
    for i in inputs:
        known = known & F.col(f"`{i}`").isNotNull()
    return wide.select(F.when(known, F.expr(formula)).alias("value"), F.when(known, "ok").otherwise("unverified").alias("status"))


def sensors_of(registry: DataFrame) -> DataFrame:
    """(fact, sensors) from (id, facts ARRAY)."""
    return registry.select("id", F.explode("facts").alias("fact")).groupBy("fact").agg(F.array_sort(F.collect_set("id")).alias("sensors"))
