"""Smaller operators: attribution joins, containment, set differences, nested documents, selections, validators."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import dedup
from corvane.plans.materialize import is_empty, materialize

# --- deduplication against others --------------------------------------------------------------------


def greedy_near_dedup(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Keys dropped by greedy near dedup in key order: kept records suppress later ones, dropped ones do not.

    Pairs are linked to the least key of a bucket; a record whose only similar predecessors are dropped stays.
    Each round settles at least the first open record of every chain.
    """
    edges = materialize(dedup.near_pairs(df, key, text, threshold=threshold).select("a", "b"), "near")
    out = None
    while not is_empty(edges):
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = materialize(edges.join(kept, "a", "left_semi").select("b").distinct(), "dropped")
        out = gone if out is None else out.union(gone)
        edges = materialize(edges.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti"), "near")
    return (out if out is not None else edges.select("b")).withColumnRenamed("b", key)


def containment(small: DataFrame, large: DataFrame, key: str, text: str, other: str, n: int = 5, share: float = 0.8) -> DataFrame:
    """(key, other, contained): records of ``small`` with at least ``share`` of their n-grams in one of ``large``."""
    w = lambda d, k: d.select(F.col(k).alias(k), tx.words(F.col(text)).alias("w"))
    g = lambda d, k: w(d, k).select(k, F.explode(F.array_distinct(tx.ngrams(F.col("w"), n))).alias("g"))
    mine = g(small, key)
    size = mine.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = mine.join(g(large, other), "g").groupBy(key, other).agg(F.count(F.lit(1)).alias("c"))
    return both.join(size, key).where(F.col("c") >= share * F.col("n")).select(key, other, (F.col("c") / F.col("n")).alias("contained"))


# --- joins --------------------------------------------------------------------------------------------


def uncovered(deployments: DataFrame, budgets: DataFrame, name: str, labels: str, selector: str) -> DataFrame:
    """Names whose labels hold no budget's selector; an empty selector covers nothing.

    Selectors meet labels through their first entry, so no pair is compared without a common label.
    """
    b = budgets.where(F.size(selector) > 0).select(F.array_sort(F.transform(F.map_entries(selector), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("_need")).withColumn("_l", F.col("_need")[0])
    d = deployments.select(name, F.transform(F.map_entries(labels), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("_have"))
    hit = d.withColumn("_l", F.explode("_have")).join(b, "_l").where(F.size(F.array_except("_need", "_have")) == 0)
    return deployments.select(name).join(hit.select(name).distinct(), name, "left_anti")


def first_name(df: DataFrame, key: str, *lookups: DataFrame) -> DataFrame:
    """``df`` with ``name`` of the first lookup table (key, name) that knows the key."""
    out, found = df, []
    for i, t in enumerate(lookups):
        out = out.join(t.select(F.col("key").alias(f"_k{i}"), F.col("name").alias(f"_n{i}")), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_n{i}"))
    return out.withColumn("name", F.coalesce(*found)).drop(*[f"_n{i}" for i in range(len(lookups))])


def renderings(value: Column) -> Column:
    """Spellings of a number that a text may use."""
    v = value.cast("double")
    return F.array_distinct(F.array(F.format_string("%.0f", v), F.format_string("%.1f", v), F.format_string("%.2f", v), F.format_string("%.3f", v), F.format_number(v, 0), F.translate(F.format_number(v, 0), ",", " ")))


def claimed(text: Column, value: Column) -> Column:
    return F.exists(renderings(value), lambda r: F.contains(text, r))


def divergence(claims: DataFrame, claim: str, pair: str, verdict: str) -> DataFrame:
    """Claims that pass while their end-to-end partner fails."""
    other = claims.select(F.col(claim).alias("_c"), F.col(verdict).alias("_v"))
    return claims.join(other, F.col(pair) == F.col("_c")).where((F.col(verdict) == "pass") & (F.col("_v") == "fail")).select(claim, pair)


def symmetric_difference(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    a, b = declared.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("declared")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("actual")))


# --- selections ---------------------------------------------------------------------------------------


def nucleus(df: DataFrame, group: str, key: str, p: str, top: float) -> DataFrame:
    """Rows kept while the probability before them is below ``top``, renormalized."""
    w = Window.partitionBy(group).orderBy(F.desc(p), key)
    kept = df.withColumn("_before", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p)).where(F.col("_before") < top).drop("_before")
    return kept.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(group)))


def best_checkpoint(df: DataFrame, key: str, domain: str, general: str, base: str, gain: float = 3.0, loss: float = 0.2) -> DataFrame:
    """The checkpoint of greatest domain gain whose general loss rose at most ``loss``; none if no gain suffices."""
    b = df.where(F.col(key) == base).select(F.col(domain).alias("_d"), F.col(general).alias("_g"))
    ok = df.crossJoin(F.broadcast(b)).where((F.col("_d") - F.col(domain) >= gain) & (F.col(general) - F.col("_g") <= loss + 1e-9))
    return ok.orderBy(F.desc(F.col("_d") - F.col(domain)), key).limit(1).select(key)


def product_reward(parts: list[Column], difficulty: Column, target: float, width: float) -> Column:
    """Product of parts times a Gaussian of the distance from the wanted difficulty."""
    return reduce(lambda a, b: a * b, parts) * F.exp(-((difficulty - target) ** 2) / (2 * width * width))


def detection_matrix(df: DataFrame, case: str, guard: str, hit: str) -> DataFrame:
    """(all_detected, undetected): cases no guard finds."""
    by = df.groupBy(case).agg(F.bool_or(hit).alias("_hit"))
    return by.agg(F.bool_and("_hit").alias("all_detected"), F.array_sort(F.collect_list(F.when(~F.col("_hit"), F.col(case)))).alias("undetected"))


def mutation_score(df: DataFrame, group: str, killed: str, equivalent: str, weight: str) -> DataFrame:
    """Weighted share of killed among the mutants that are not equivalent."""
    live = ~F.col(equivalent)
    return df.groupBy(group).agg(F.try_divide(F.sum(F.when(live & F.col(killed), F.col(weight)).otherwise(0.0)), F.sum(F.when(live, F.col(weight)).otherwise(0.0))).alias("score"))


# --- texts, fragments, validators -----------------------------------------------------------------------


def fragment(text: Column, first: int | None = None, last: int | None = None, key: str | None = None) -> Column:
    """Digest of a whole text, of lines ``first``..``last``, or of the JSON value at a dotted key."""
    if key is not None:
        return F.sha2(F.get_json_object(text, "$." + key), 256)
    if first is not None:
        return F.sha2(F.array_join(F.slice(F.split(text, "\n"), first, (last or first) - first + 1), "\n"), 256)
    return F.sha2(text, 256)


def kernel_name(name: Column) -> Column:
    """Name of the operation behind a generated kernel: a numeric suffix becomes a dotted one."""
    return F.regexp_replace(name, r"_(\d+)$", ".$1")


def component(name: Column, probes: dict[str, str], default: str = "other") -> Column:
    out = F.lit(default)
    for label, pattern in reversed(probes.items()):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def violations(checks: dict[str, Column]) -> Column:
    """Messages of the checks that do not hold; a check that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in checks.items()]))


def human_bytes(n: Column) -> Column:
    unit = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1))) / 10)).cast("int")
    names = F.array(*[F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "TiB")])
    return F.concat(F.format_string("%.1f ", n / F.pow(F.lit(1024.0), unit)), F.element_at(names, F.least(unit, F.lit(4)) + 1))


# --- nested documents -----------------------------------------------------------------------------------


def _leaves(value: object, key: str) -> Iterator[object]:
    if isinstance(value, dict):
        for k, v in value.items():
            if k == key:
                yield v
            yield from _leaves(v, key)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, key)


def all_true(text: str | None, key: str = "identical") -> str:
    """pass if every nested ``key`` is true, fail if one is not, unverified if there is none or no JSON."""
    try:
        found = list(_leaves(json.loads(text or ""), key))
    except ValueError:
        return "unverified"
    return "unverified" if not found else "pass" if all(v is True for v in found) else "fail"


def first_value(text: str | None, key: str) -> str | None:
    """First value of ``key`` at any depth, as JSON."""
    try:
        return next((json.dumps(v, ensure_ascii=False) for v in _leaves(json.loads(text or ""), key)), None)
    except ValueError:
        return None


def lookup(text: Column, key: str) -> Column:
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def get(s: pd.Series) -> pd.Series:
        return s.map(lambda x: first_value(x, key))

    return get(text)


def plan_actions(spark: SparkSession, path: str) -> DataFrame:
    """(type, create, update, delete, replace, n) of the resource changes of infrastructure plans."""
    schema = "resource_changes array<struct<type string, change struct<actions array<string>>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("resource_changes").alias("r"))
    a = F.col("r.change.actions")
    has = lambda x: F.array_contains(a, x)
    replace = has("create") & has("delete")
    return r.groupBy(F.col("r.type").alias("type")).agg(
        F.count_if(has("create") & ~replace).alias("create"), F.count_if(has("update")).alias("update"), F.count_if(has("delete") & ~replace).alias("delete"), F.count_if(replace).alias("replace"), F.count(F.lit(1)).alias("n")
    )


def api_surface(spark: SparkSession, path: str) -> DataFrame:
    """(path, method) of API descriptions in JSON."""
    raw = spark.read.text(path, wholetext=True)
    methods = F.from_json(F.get_json_object("value", "$.paths"), "map<string,map<string,string>>")
    p = raw.select(F.explode(methods).alias("path", "ops"))
    return p.select("path", F.explode(F.map_keys("ops")).alias("method")).where(F.col("method").isin("get", "put", "post", "delete", "patch", "head", "options", "trace"))


def sqlite_table(spark: SparkSession, files: DataFrame, query: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite files that every executor can read; ``files`` has their paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with sqlite3.connect(f"file:{re.sub('^file:/*', '/', p)}?mode=ro", uri=True) as con:
                    yield from pd.read_sql_query(query, con, chunksize=50_000)

    return files.select("path").repartition(max(1, files.count())).mapInPandas(run, schema)


def registry(text: str) -> dict:
    """Nested mappings and lists of a small YAML subset: ``key: value``, ``- item``, indentation; else an error."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.strip().startswith("#")]

    def scalar(v: str) -> object:
        if v[:1] in "{[&*!|>%@`":
            raise ValueError(f"unsupported value: {v}")
        if v[:1] in "\"'":
            if len(v) < 2 or v[-1] != v[0]:
                raise ValueError(f"open quote: {v}")
            return v[1:-1]
        for t in (int, float):
            try:
                return t(v)
            except ValueError:
                pass
        return {"true": True, "false": False, "null": None, "~": None}.get(v, v)

    for i, (depth, line) in enumerate(lines):
        while stack[-1][0] >= depth:
            stack.pop()
        parent = stack[-1][1]
        item = line.startswith("- ")
        body = line[2:].strip() if item else line
        m = re.match(r"^([\w./-]+):(?:\s+(.*))?$", body)
        if item:
            if not isinstance(parent, list):
                raise ValueError(f"list item outside a list: {line}")
            if not m:
                parent.append(scalar(body))
                continue
            entry: dict = {}
            parent.append(entry)
            stack.append((depth, entry))
            parent, depth = entry, depth + 2
        elif not m or not isinstance(parent, dict):
            raise ValueError(f"unsupported line: {line}")
        if m.group(2):
            parent[m.group(1)] = scalar(m.group(2))
        else:
            deeper = lines[i + 1] if i + 1 < len(lines) else (0, "")
            child: object = [] if deeper[1].startswith("- ") and deeper[0] >= depth - (2 if item else 0) else {} if deeper[0] > depth else None
            parent[m.group(1)] = child
            if child is not None:
                stack.append((depth if isinstance(child, dict) or deeper[0] > depth else depth - 1, child))
    return root
