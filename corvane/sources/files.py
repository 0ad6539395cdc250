"""File scans: JSON lines in three strictness levels, paragraphs, logs, directories, trees, git logs, CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest line taken, in characters.
LONGEST = 32 << 20
SUFFIXES = ("jsonl", "jsonl.zst", "json", "md", "txt")


def tolerant_jsonl(spark: SparkSession, path: str, longest: int = LONGEST) -> DataFrame:
    """(file, raw, state): state is record, blank, oversized, error or not_object; nothing is lost."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    v = F.try_parse_json("raw")
    shape = F.schema_of_variant(v)
    state = (
        F.when(F.trim("raw") == "", "blank").when(F.length("raw") > longest, "oversized").when(v.isNull(), "error")
        .when(~F.startswith(shape, F.lit("OBJECT")), "not_object").otherwise("record")
    )
    return lines.withColumn("state", state)


def scan_report(scan: DataFrame) -> DataFrame:
    names = {"records": "record", "blank": "blank", "errors": "error", "not_objects": "not_object", "oversized": "oversized"}
    return scan.agg(*[F.count_if(F.col("state") == v).alias(k) for k, v in names.items()])


def records(scan: DataFrame, schema: str) -> DataFrame:
    return scan.where("state = 'record'").select("file", F.from_json("raw", schema).alias("r")).select("file", "r.*")


def strict_texts(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Texts of JSON lines; a damaged line or missing field stops the read."""
    rows = spark.read.schema(T.StructType([T.StructField(field, T.StringType())])).option("mode", "FAILFAST").json(path)
    return rows.select(F.when(F.col(field).isNull(), F.raise_error(F.lit(f"no {field}")).cast("string")).otherwise(F.col(field)).alias("text"))


def lenient_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, field: str = "text") -> DataFrame:
    """(file, text) of all files below ``path`` with a known suffix and not blank.

    A ``.jsonl`` file gives a row a record: its ``field``, or the line where that is missing; others one row a file.
    """
    lined = [x for x in suffixes if x.startswith("jsonl")]
    whole = [x for x in suffixes if x not in lined]
    pick = lambda df, text, ends: df.select(F.col("_metadata.file_path").alias("file"), text.alias("text")).where(F.col("file").rlike(r"\.(" + "|".join(x.replace(".", r"\.") for x in ends) + ")$"))
    record = F.coalesce(F.get_json_object("value", f"$.{field}"), F.col("value"))
    parts = []
    if lined:
        parts.append(pick(spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl*"), record, lined))
    if whole:
        parts.append(pick(spark.read.text(path, wholetext=True, recursiveFileLookup=True), F.col("value"), whole))
    return reduce(DataFrame.unionByName, parts).where(F.col("text").rlike(r"\S"))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    parts = F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*\n+")
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(parts).alias("pos", "text")).withColumn("text", F.regexp_replace("text", r"^\n+|\n+$", "")).where(F.trim("text") != "")


def file_stamp(name: Column) -> Column:
    """Time in a file name, YYYYMMDD-HHMMSS."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}-\d{6})", 1), F.lit("yyyyMMdd-HHmmss"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, ts) of JSON reports; time from the file name, else its modification."""
    rows = spark.read.schema("status string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("status IS NOT NULL").select(
        F.col("_metadata.file_path").alias("file"), "status", F.coalesce(file_stamp(F.col("_metadata.file_name")), F.col("_metadata.file_modification_time")).alias("ts")
    )


def log_status(spark: SparkSession, path: str, pattern: str = r"status[=: ]+(\w+)") -> DataFrame:
    """(file, status): first line of each log that matches."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", pattern, 1).alias("status")).where("status <> ''")


def latest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return files.agg(F.max("path").alias("file"))


def tree(spark: SparkSession, path: str, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(bytes, digest over sorted name and content digests), and the largest files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha"))
    rows = F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha")))
    return f.agg(F.sum("length").alias("bytes"), F.sha2(F.array_join(rows, "\n"), 256).alias("digest")), f.orderBy(F.desc("length"), "path").limit(top).select("path", "length")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, ts, subject, files) of records separated by 0x1e: header fields by 0x1f, then file lines."""
    r = spark.read.text(path, lineSep="\x1e").where(F.trim("value") != "")
    lines = F.split(F.trim("value"), "\n")
    head = F.split(lines[0], "\x1f")
    return r.select(head[0].alias("commit"), head[1].alias("ts"), head[2].alias("subject"), F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x) != "").alias("files"))


def sampler_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Numeric columns of a CSV without header; short rows and rows that are not numbers are left out."""
    p = F.split("value", ",")
    cols = [F.try_cast(F.trim(F.try_element_at(p, F.lit(i + 1))), "double").alias(f) if hasattr(F, "try_cast") else F.trim(F.try_element_at(p, F.lit(i + 1))).try_cast("double").alias(f) for i, f in enumerate(fields)]
    return spark.read.text(path).select(*cols).na.drop()


def schema_types(df: DataFrame) -> dict[str, str]:
    """Column kinds: int, float, bool, str, list, dict."""
    kinds = {T.IntegerType: "int", T.LongType: "int", T.ShortType: "int", T.ByteType: "int", T.FloatType: "float", T.DoubleType: "float", T.BooleanType: "bool", T.ArrayType: "list", T.StructType: "dict", T.MapType: "dict"}
    return {f.name: kinds.get(type(f.dataType), "str") for f in df.schema.fields}


def synthetic(spark: SparkSession, seed: int, rows: int, words: int, vocabulary: list[str]) -> DataFrame:
    """Deterministic texts of hash-chosen words."""
    v = F.array(*[F.lit(w) for w in vocabulary])
    pick = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.element_at(v, (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(vocabulary))) + 1).cast("int")))
    return spark.range(rows).select("id", F.array_join(pick, " ").alias("text"))


def grid(levels: dict[str, list], count: int, spark: SparkSession) -> DataFrame:
    """Cross of short lists of levels with ``count`` repeats, and a seed by position."""
    out = spark.createDataFrame([(0,)], "x int")
    for name, values in levels.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = out.drop("x").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return out.withColumn("seed", F.pmod(F.xxhash64(*out.columns), F.lit(1 << 31)))


def allowed_output(path: str, roots: tuple[str, ...]) -> str:
    """``path`` if it lies below one of ``roots``; else an error."""
    import posixpath

    clean = posixpath.normpath(path)
    if not any(clean == r or clean.startswith(r.rstrip("/") + "/") for r in roots):
        raise ValueError(f"output outside the allowed folders: {path}")
    return path
