"""Registered queries of the core operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.tables import table
from corvane.operators import corpus_queries, episode_queries, gate_queries, report_queries, series_queries
from corvane.streaming import queries as stream_queries


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators import spikes

    return spikes.found(table(spark, d, "metrics"))


QUERIES = {"p4_found": p4_found, **corpus_queries.QUERIES, **series_queries.QUERIES, **episode_queries.QUERIES, **report_queries.QUERIES, **gate_queries.QUERIES, **stream_queries.QUERIES}
SQL = {**corpus_queries.SQL, **series_queries.SQL, **episode_queries.SQL, **report_queries.SQL, **gate_queries.SQL, **stream_queries.SQL}
