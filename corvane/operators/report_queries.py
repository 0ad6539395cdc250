"""Queries of the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.tables import table
from corvane.operators import reports


def greedy_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return reports.greedy_near_dedup(table(spark, d, "documents"), "doc_id", "text")


def contained_items(spark: SparkSession, d: str) -> DataFrame:
    c = reports.containment(table(spark, d, "eval_items"), table(spark, d, "documents"), "item_id", "text", "doc_id")
    return c.select("item_id", "doc_id", F.round("contained", 6).alias("contained"))


def nucleus_sets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    t = e.groupBy("event_type").agg(F.sum("n").alias("t"))
    p = e.join(t, "event_type").select("event_type", "user_id", (F.col("n") / F.col("t")).alias("p"))
    return reports.nucleus(p, "event_type", "user_id", "p", 0.5).select("event_type", "user_id", F.round("p", 6).alias("p"))


def catalog_difference(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "mix_plan").select("source")
    docs = table(spark, d, "documents").select("source").where("source IS NOT NULL")
    return reports.symmetric_difference(plan, docs, "source")


def lines_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", reports.fragment(F.col("text"), 1, 2).alias("head"), reports.fragment(F.col("text")).alias("whole"))


def tool_paths(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("kind = 'tool_call'").dropDuplicates(["turn_id"])
    return t.select("turn_id", reports.lookup(F.col("content"), "path").alias("path"))


def record_violations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").dropDuplicates(["id"])
    v = reports.violations({"no class": F.col("class").isNotNull(), "no start": F.col("started_at").isNotNull(), "no end": F.col("ended_at").isNotNull(), "no turns": F.col("n_turns") > 0})
    return e.select(F.explode(v).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def claimed_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(reports.claimed(F.col("text"), F.col("doc_id"))).select("doc_id")


def kernel_components(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("path IS NOT NULL")
    name = reports.kernel_name(F.concat(F.regexp_replace("path", r"\W", "_"), F.lit("_"), (F.col("doc_id") % 7).cast("string")))
    kind = reports.component(F.col("path"), {"kernel": "kernels", "test": "^tests/", "tool": "^tools/"})
    return docs.groupBy(kind.alias("kind"), F.regexp_extract(name, r"\.(\d+)$", 1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def uncovered_repos(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("repo IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    dep = docs.groupBy("repo").agg(F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array(F.min("lang"), F.min("source"))).alias("labels"))
    sel = spark.createDataFrame([({"lang": "en"},), ({"lang": "ru", "source": "web"},), ({},)], "selector map<string,string>")
    return reports.uncovered(dep, sel, "repo", "labels", "selector")


def shaped_reward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    r = reports.product_reward([F.col("value") / 100, F.lit(0.5)], F.col("value") / 100, 0.5, 0.2)
    return e.select("event_id", F.round(r, 6).alias("reward"))


QUERIES = {f.__name__: f for f in (
    greedy_near_dedup, contained_items, nucleus_sets, catalog_difference, lines_digest, tool_paths, record_violations, claimed_sizes, kernel_components, uncovered_repos, shaped_reward,
)}

_W = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)')"


def _g(name: str, key: str) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT {key}, {_W} AS w FROM {name})))"


SQL = {
    "tool_paths": "SELECT turn_id, CAST(coalesce(json_extract(content, '$.input.path'), json_extract(content, '$.path')) AS VARCHAR) AS path FROM (SELECT DISTINCT ON (turn_id) * FROM turns) WHERE kind = 'tool_call'",
    "claimed_sizes": "SELECT doc_id FROM documents WHERE contains(text, doc_id::VARCHAR) OR contains(text, format('{:,}', doc_id)) OR contains(text, replace(format('{:,}', doc_id), ',', ' '))",
    "contained_items": f"WITH a AS {_g('eval_items', 'item_id')}, b AS {_g('documents', 'doc_id')}, n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1), c AS (SELECT item_id, doc_id, count(*) AS c FROM a JOIN b USING (g) GROUP BY 1, 2) SELECT item_id, doc_id, round(c / n::DOUBLE, 6) AS contained FROM c JOIN n USING (item_id) WHERE c >= 0.8 * n",
    "nucleus_sets": "WITH e AS (SELECT event_type, user_id, count(*) / sum(count(*)) OVER (PARTITION BY event_type) AS p FROM events GROUP BY 1, 2), r AS (SELECT *, sum(p) OVER (PARTITION BY event_type ORDER BY p DESC, user_id ROWS UNBOUNDED PRECEDING) - p AS b FROM e) SELECT event_type, user_id, round(p / sum(p) OVER (PARTITION BY event_type), 6) AS p FROM r WHERE b < 0.5",
    "catalog_difference": "SELECT source, 'declared' AS side FROM (SELECT DISTINCT source FROM mix_plan WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)) UNION ALL SELECT source, 'actual' FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM mix_plan))",
    "lines_digest": "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[1:2], chr(10))) AS head, sha256(text) AS whole FROM documents",
    "record_violations": "SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN class IS NULL THEN 'no class' END, CASE WHEN started_at IS NULL THEN 'no start' END, CASE WHEN ended_at IS NULL THEN 'no end' END, CASE WHEN NOT coalesce(n_turns > 0, false) THEN 'no turns' END], lambda x: x IS NOT NULL)) AS v FROM (SELECT DISTINCT ON (id) * FROM episodes)) GROUP BY 1",
    "kernel_components": "SELECT CASE WHEN regexp_matches(path, 'kernels') THEN 'kernel' WHEN regexp_matches(path, '^tests/') THEN 'test' WHEN regexp_matches(path, '^tools/') THEN 'tool' ELSE 'other' END AS kind, CAST(doc_id % 7 AS VARCHAR) AS suffix, count(*) AS n FROM documents WHERE path IS NOT NULL GROUP BY 1, 2",
    "uncovered_repos": "WITH d AS (SELECT repo, min(lang) AS lang, min(source) AS source FROM documents WHERE repo IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL GROUP BY 1) SELECT repo FROM d WHERE NOT (lang = 'en' OR lang = 'ru' AND source = 'web')",
    "shaped_reward": "SELECT event_id, round(value / 100 * 0.5 * exp(-((value / 100 - 0.5) ** 2) / (2 * 0.2 * 0.2)), 6) AS reward FROM events",
}
