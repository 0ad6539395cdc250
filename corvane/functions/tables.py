"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` with zoneless timestamps cast to TIMESTAMP (session zone UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(plain) if plain else df
