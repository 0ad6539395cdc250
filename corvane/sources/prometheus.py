"""Text exposition of metrics: parse to rows, render rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\S+)?$"


def parse(df: DataFrame, line: str) -> DataFrame:
    """(name, labels MAP, value) of sample lines; comments, blanks and lines that are no samples are left out."""
    s = F.trim(F.col(line))
    rows = df.where(s.rlike(_LINE)).select(*[F.regexp_extract(s, _LINE, i).alias(n) for i, n in ((1, "name"), (2, "body"), (3, "number"))])
    pat = F.lit(r'([A-Za-z_]\w*)="((?:[^"\\]|\\.)*)"')
    keys, values = F.regexp_extract_all("body", pat, F.lit(1)), F.regexp_extract_all("body", pat, F.lit(2))
    plain = F.transform(values, lambda v: F.replace(F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    number = F.when(F.lower("number").isin("+inf", "inf"), float("inf")).when(F.lower("number") == "-inf", float("-inf")).otherwise(F.expr("try_cast(number AS double)"))
    return rows.select("name", F.map_from_arrays(keys, plain).alias("labels"), number.alias("value")).where("value IS NOT NULL")


def render(df: DataFrame) -> DataFrame:
    """(line) of (name, labels MAP, value) rows, sorted by nothing: order them when writing."""
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"')))
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return df.where("value IS NOT NULL").select(F.concat(F.col("name"), body, F.lit(" "), F.col("value").cast("string")).alias("line"))


def exposition(df: DataFrame, status: str = "status") -> DataFrame:
    """(at, line) of a closed exposition: numbers of facts whose status is ok, in order of their lines, then ``# EOF``."""
    lines = render(df.where(F.col(status) == "ok")).select(F.lit(0).alias("at"), "line")
    end = df.sparkSession.createDataFrame([(1, "# EOF")], "at int, line string")
    return lines.unionByName(end).orderBy("at", "line")
