"""Queries of episodes, answers, rewards, byte pairs and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.tables import table
from corvane.operators import bpe, episodes, properties, series
from corvane.plans.materialize import new_path
from corvane.sources import facts, files, prometheus, shards

#: Rows of a session are in order of ``seq``; those without one (old logger) in order of time, after the others.
_ORDER = ["no_seq", "seq", "no_ts", "at", "msg_id"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "session_turns").dropDuplicates(["msg_id"])
    at = F.when(F.col("seq").isNull(), F.col("ts"))
    t = t.withColumns({"no_seq": F.col("seq").isNull(), "no_ts": at.isNull(), "at": at})
    role = F.lower(F.trim("role"))
    return t.withColumn("role", F.when(role == "human", "user").when(role.isin("ai", "model"), "assistant").when(role == "function", "tool").otherwise(role))


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    s = episodes.sessionized(_rows(spark, d), "source_session", _ORDER, F.col("role") == "user")
    return episodes.gathered(s, "source_session", _ORDER)


def session_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d).select("id", "source_session", "episode", F.size("turns").alias("n_turns"))


def last_frames(spark: SparkSession, d: str) -> DataFrame:
    e = _episodes(spark, d)
    return e.select("id", F.length(episodes.last_results(F.col("turns"))).alias("result_chars"), F.coalesce(F.length(episodes.last_answer(F.col("turns"))), F.lit(-1)).alias("answer_chars"))


def classified(spark: SparkSession, d: str) -> DataFrame:
    e = _episodes(spark, d).select("id", episodes.contract(episodes.last_answer(F.col("turns"))).alias("status"), episodes.suite(episodes.last_results(F.col("turns"))).alias("suite"))
    return e.select("id", "status", "suite", episodes.outcome(F.col("status"), F.col("suite"), F.lit(None).cast("string")).alias("class"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").dropDuplicates(["id"])
    return e.groupBy(F.coalesce("class", F.lit("none")).alias("class"), "batch_no").agg(F.count(F.lit(1)).alias("n"))


def training_admission(spark: SparkSession, d: str) -> DataFrame:
    keep, failed = episodes.admitted(table(spark, d, "episodes").dropDuplicates(["id"]))
    return keep.select("id", F.lit("train").alias("pool")).unionByName(failed.select("id", F.lit("negative").alias("pool")))


def episode_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").dropDuplicates(["id"])
    t = tx.parse_time(F.col("started_at"))
    return e.groupBy(t.isNotNull().alias("parsed"), F.col("started_at").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))


def answer_structure(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("role = 'assistant' AND kind = 'text'").dropDuplicates(["turn_id"])
    return t.select(F.explode(episodes.structure_defects(F.col("content"))).alias("defect")).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


def tool_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("kind = 'tool_call'").dropDuplicates(["turn_id"])
    return t.groupBy(F.get_json_object("content", "$.name").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


def rewards(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    base = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")), lambda i: F.concat(F.lit("v"), i.cast("string")))
    final = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 7).cast("int")), lambda i: F.concat(F.lit("v"), (i * 2).cast("string")))
    r = episodes.reward(F.col("value") > 50, base, final, F.col("value"), F.lit(40.0))
    return e.select("event_id", F.round(r, 6).alias("reward"))


def byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bpe.best_pair(bpe.pair_counts(table(spark, d, "documents"), "text"))


def pair_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(table(spark, d, "documents"), "text")


def encoding_efficiency(spark: SparkSession, d: str) -> DataFrame:
    merges = [("t", "h"), ("th", "e"), ("o", "n"), ("с", "т"), ("н", "о"), ("е", "н"), ("i", "n"), ("e", "r")]
    return bpe.efficiency(table(spark, d, "documents"), "text", F.lower(F.trim(F.coalesce("source", F.lit("none")))), merges)


def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines with damaged ones among them, read tolerantly and counted."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    raw = F.when(F.col("event_id") % 100 == 3, "{broken").when(F.col("event_id") % 100 == 5, "[1]").when(F.col("event_id") % 100 == 7, " ").otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    path = new_path(spark, "jsonl")
    e.select(raw.alias("value")).write.text(path)
    return files.scan_report(files.tolerant_jsonl(spark, path))


def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as shards with a manifest, hashes recomputed from the files; then one digest of the manifest is altered."""
    path = new_path(spark, "shards")
    docs = table(spark, d, "documents").select("doc_id", "text")
    m = shards.write(docs, path, rows=200)
    one = m.select(F.min("file").alias("_f"))
    altered = m.crossJoin(F.broadcast(one)).withColumn("sha256", F.when(F.col("file") == F.col("_f"), F.reverse("sha256")).otherwise(F.col("sha256"))).drop("_f")
    whole, hurt = shards.bad_shards(shards.verify(spark, path, m)), shards.bad_shards(shards.verify(spark, path, altered))
    back = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    state = whole.select("all_match", F.size("bad").alias("bad")).crossJoin(F.broadcast(hurt.select(F.col("all_match").alias("altered_match"), F.size("bad").alias("altered_bad"))))
    return back.crossJoin(F.broadcast(state))


def token_stream(spark: SparkSession, d: str) -> DataFrame:
    """Packed little-endian token files read back as positions."""
    path = new_path(spark, "bins")
    ids = table(spark, d, "events").select((F.col("user_id") % 3).alias("shard"), F.col("event_id").alias("token"))
    shards.write_packed(ids, path, "shard", "token")
    return shards.read_packed(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("token").alias("total"))


def openmetrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    text = prometheus.render(e.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), "value"))
    return prometheus.parse(text, "line").select(F.col("labels")["type"].alias("event_type"), "value")


def fact_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as facts of one sensor a type, appended in two parts and read back; then lines are edited and the breaks counted."""
    e = table(spark, d, "events").select(F.col("event_type").alias("sensor"), F.col("event_type").alias("fact"), "value", F.col("event_id").alias("seq"))
    path = new_path(spark, "facts")
    half = F.col("seq") < 500
    facts.append(e.where(half), path)
    facts.append(e.where(~half), path)
    f = facts.read(spark, path)
    edited = F.when(F.col("seq") % 1000 == 7, F.regexp_replace("raw", r'"value":[^,}]+', '"value":-1.0')).otherwise(F.col("raw"))
    ok = facts.intact(f).select(F.col("sensor").alias("fact"), "intact")
    bad = facts.intact(facts.parsed(f.select(edited.alias("value")))).select(F.col("sensor").alias("fact"), "broken")
    return facts.latest(f).select("fact", F.round("value", 6).alias("value")).join(ok, "fact").join(bad, "fact")


def preflight(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    claims = e.groupBy(F.col("event_type").alias("claim")).agg(F.when(F.avg("value") > 49, "pass").otherwise("fail").alias("verdict"), (F.count(F.lit(1)) % 2 == 0).alias("flap"))
    req = spark.createDataFrame([("click",), ("view",), ("purchase",), ("missing",)], "claim string")
    return properties.requirements(req, claims, "claim", "verdict", "flap")


QUERIES = {f.__name__: f for f in (
    session_episodes, last_frames, classified, class_counts, training_admission, episode_times, answer_structure, tool_names, rewards, byte_pairs, pair_frequencies,
    encoding_efficiency, jsonl_scan, shard_manifest, token_stream, openmetrics, fact_history, preflight,
)}

_R = (
    "(SELECT *, row_number() OVER (PARTITION BY source_session ORDER BY seq IS NULL, seq, tm IS NULL, tm, msg_id) AS rn FROM (SELECT DISTINCT ON (msg_id) source_session, seq, CASE WHEN seq IS NULL THEN ts END AS tm, msg_id, content, kind, "
    "CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'function' THEN 'tool' ELSE lower(trim(role)) END AS role FROM session_turns))"
)
_E = f"(SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY source_session ORDER BY rn ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM {_R})"
_ID = "'ep-' || substr(sha256(encode(source_session) || '\\x00'::BLOB || encode(CAST(CAST(episode AS BIGINT) AS VARCHAR))), 1, 16)"
_CH = "(SELECT w, count(*) AS f FROM (SELECT unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)')) AS w FROM documents) GROUP BY 1)"
_PAIRS = f"(SELECT substr(w, i, 1) AS a, substr(w, i + 1, 1) AS b, CAST(sum(f) AS BIGINT) AS n FROM (SELECT w, f, unnest(range(1, length(w))) AS i FROM {_CH} WHERE length(w) > 1) GROUP BY 1, 2)"
SQL = {
    "session_episodes": f"SELECT {_ID} AS id, source_session, CAST(episode AS BIGINT) AS episode, CAST(count(*) AS INTEGER) AS n_turns FROM {_E} WHERE episode >= 0 GROUP BY source_session, episode",
    "last_frames": f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY source_session, episode, kind ORDER BY rn DESC) AS back FROM {_E} WHERE episode >= 0), r AS (SELECT source_session, episode, string_agg(coalesce(content, ''), chr(10) ORDER BY rn) FILTER (kind = 'tool_result' AND back <= 5) AS res, arg_max(coalesce(content, chr(0)), rn) FILTER (role = 'assistant' AND kind = 'text') AS ans FROM e GROUP BY 1, 2) SELECT {_ID} AS id, CAST(coalesce(length(res), 0) AS INTEGER) AS result_chars, CAST(coalesce(CASE WHEN ans <> chr(0) THEN length(ans) END, -1) AS INTEGER) AS answer_chars FROM r",
    "episode_times": "SELECT TRY_CAST(started_at AS TIMESTAMPTZ) IS NOT NULL AS parsed, started_at IS NULL AS missing, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM episodes) GROUP BY 1, 2",
    "classified": f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY source_session, episode, kind ORDER BY rn DESC) AS back FROM {_E} WHERE episode >= 0), r AS (SELECT source_session, episode, coalesce(string_agg(coalesce(content, ''), chr(10) ORDER BY rn) FILTER (kind = 'tool_result' AND back <= 5), '') AS res, arg_max(coalesce(content, ''), rn) FILTER (role = 'assistant' AND kind = 'text') AS ans FROM e GROUP BY 1, 2), c AS (SELECT {_ID} AS id, nullif(regexp_extract(ans, '\\{{\"status\": \"(\\w+)\"[^{{}}]*\\}}[\\s`]*$', 1), '') AS status, CASE WHEN regexp_matches(res, '(?i)\\b\\d+ (?:failed|errors?)\\b|\\bFAILED\\b') THEN 'red' WHEN regexp_matches(res, '(?i)\\b\\d+ passed\\b') THEN 'green' END AS suite FROM r), s AS (SELECT *, CASE status WHEN 'complete' THEN 'complete' WHEN 'partial' THEN 'partial' WHEN 'failed' THEN 'failed' WHEN 'blocked' THEN 'failed' END AS said FROM c) SELECT id, status, suite, CASE WHEN said = 'failed' OR suite = 'red' THEN 'verified-failed' WHEN said = 'complete' AND suite = 'green' THEN 'verified-complete' WHEN said = 'partial' AND suite = 'green' THEN 'verified-partial' ELSE 'unverified' END AS class FROM s",
    "class_counts": "SELECT coalesce(class, 'none') AS class, batch_no, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM episodes) GROUP BY 1, 2",
    "training_admission": "SELECT id, CASE class WHEN 'verified-failed' THEN 'negative' ELSE 'train' END AS pool FROM (SELECT DISTINCT ON (id) * FROM episodes) WHERE class IN ('verified-complete', 'verified-partial', 'verified-failed')",
    "tool_names": "SELECT json_extract_string(content, '$.name') AS tool, count(*) AS n FROM (SELECT DISTINCT ON (turn_id) * FROM turns) WHERE kind = 'tool_call' GROUP BY 1",
    "byte_pairs": f"SELECT * FROM {_PAIRS} ORDER BY n DESC, a, b LIMIT 1",
    "pair_frequencies": f"SELECT * FROM {_PAIRS}",
    "jsonl_scan": "SELECT count(*) FILTER (event_id % 100 NOT IN (3, 5, 7)) AS records, count(*) FILTER (event_id % 100 = 7) AS blank, count(*) FILTER (event_id % 100 = 3) AS errors, count(*) FILTER (event_id % 100 = 5) AS not_objects, CAST(0 AS BIGINT) AS oversized FROM events",
    "shard_manifest": "SELECT count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS all_match, CAST(0 AS INTEGER) AS bad, false AS altered_match, CAST(1 AS INTEGER) AS altered_bad FROM documents",
    "token_stream": "SELECT CAST(user_id % 3 AS VARCHAR) AS shard, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1",
    "openmetrics": "SELECT event_type, count(*)::DOUBLE AS value FROM events GROUP BY 1",
    "fact_history": "WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) SELECT event_type AS fact, round(arg_max(value, event_id), 6) AS value, true AS intact, count(*) FILTER (before % 1000 = 7) AS broken FROM e GROUP BY 1",
    "preflight": "WITH c AS (SELECT event_type, CASE WHEN avg(value) > 49 THEN 'pass' ELSE 'fail' END AS v, count(*) % 2 = 0 AS flap FROM events GROUP BY 1) SELECT claim, CASE WHEN v IS NULL THEN 'fail' WHEN flap THEN 'unverified' ELSE v END AS verdict FROM (VALUES ('click'), ('view'), ('purchase'), ('missing')) r(claim) LEFT JOIN c ON claim = event_type",
    "rewards": "WITH s AS (SELECT event_id, value, list_transform(range(event_id % 5 + 1), lambda i: 'v' || i) AS b, list_transform(range(event_id % 7 + 1), lambda i: 'v' || (i * 2)) AS f FROM events) SELECT event_id, round((value > 50)::INT + 0.5 * (1 - len(list_intersect(b, f)) / len(b)::DOUBLE) - 0.25 * least(len(f) - len(list_intersect(f, b)), 4) / 4 - (value > 80)::INT, 6) AS reward FROM s",
}
