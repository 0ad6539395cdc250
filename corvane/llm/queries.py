"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import neardup

    docs = neardup.episode_texts(table(spark, d, "turns"))
    return neardup.similar_pairs(neardup.signed(docs), docs)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import neardup

    docs = neardup.episode_texts(table(spark, d, "turns"))
    return neardup.groups(neardup.signed(docs), docs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import pii

    return pii.found_types(table(spark, d, "turns"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import pii

    turns = table(spark, d, "turns").select("turn_id", "role", "kind", "content").dropDuplicates(["turn_id"])
    return pii.redacted(turns)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import pairs

    return pairs.defects(table(spark, d, "turns"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import conversations

    return conversations.dropped(table(spark, d, "session_turns"))


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import conversations

    return conversations.rebuilt(table(spark, d, "session_turns"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import leakage

    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import residue

    return residue.excluded(table(spark, d, "documents")).select("doc_id")


def _mix(spark: SparkSession, d: str):
    from corvane.llm import mixing
    from corvane.plans.materialize import materialize

    counts = materialize(mixing.token_counts(table(spark, d, "documents")), "tokens")
    rated = mixing.rates(counts, table(spark, d, "mix_plan"))
    return counts, rated, mixing.copies(counts, rated)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[2]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import mixing

    _, rated, selection = _mix(spark, d)
    return mixing.report(selection, rated)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm import history

    return history.rejected(table(spark, d, "episodes"), table(spark, d, "turns"))


QUERIES = {"p6_found": p6_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p7_found": p7_found, "p5_found": p5_found, "p5_conversations": p5_conversations, "p3_found": p3_found, "p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_groups": p2_groups}
_P5 = """
WITH r AS (
  SELECT source_session, seq, CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant'
         WHEN 'function' THEN 'tool' ELSE lower(trim(role)) END AS role, lower(trim(kind)) AS kind, content, ts, msg_id
  FROM session_turns WHERE source_session IS NOT NULL),
m AS (
  SELECT source_session, seq, role, kind, content, min(ts) AS ts, min(msg_id) AS msg_id,
         content IS NULL OR NOT regexp_matches(content, '[^\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200d}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}\\x{00ad}\\x{0085}]') AS blank
  FROM r GROUP BY source_session, seq, role, kind, content, CASE WHEN seq IS NULL THEN ts END),
gap AS (
  SELECT source_session FROM m WHERE seq IS NOT NULL GROUP BY 1 HAVING max(seq) - min(seq) + 1 > count(DISTINCT seq)),
s AS (
  SELECT *, row_number() OVER w AS rn,
         CASE WHEN role = 'user' THEN 'ask' WHEN role = 'assistant' AND kind = 'text' AND NOT blank THEN 'answer' END AS talk,
         CASE WHEN kind IN ('tool_call', 'tool_result') THEN kind END AS tool
  FROM m WHERE role <> 'system' WINDOW w AS (PARTITION BY source_session ORDER BY seq NULLS LAST, ts NULLS LAST, msg_id)),
doubled AS (SELECT source_session FROM s WHERE seq IS NOT NULL GROUP BY source_session, seq HAVING count(*) > 1),
talk AS (
  SELECT source_session, talk, lead(talk) OVER (PARTITION BY source_session ORDER BY rn) AS after FROM s WHERE talk IS NOT NULL),
tool AS (
  SELECT source_session, tool, lag(tool) OVER (PARTITION BY source_session ORDER BY rn) AS before,
         lead(tool) OVER (PARTITION BY source_session ORDER BY rn) AS after FROM s WHERE tool IS NOT NULL),
bad AS (
  SELECT source_session FROM gap UNION SELECT source_session FROM doubled
  UNION SELECT source_session FROM talk WHERE talk = 'ask' AND after IS DISTINCT FROM 'answer'
  UNION SELECT source_session FROM tool WHERE tool = 'tool_call' AND after IS DISTINCT FROM 'tool_result'
  UNION SELECT source_session FROM tool WHERE tool = 'tool_result' AND before IS DISTINCT FROM 'tool_call'
  UNION SELECT source_session FROM s WHERE rn = 1 AND role <> 'user'
  UNION SELECT source_session FROM m GROUP BY 1
    HAVING count(*) FILTER (role = 'user' AND kind = 'text' AND NOT blank) = 0 OR count(*) FILTER (role = 'assistant' AND kind = 'text' AND NOT blank) = 0)"""

_P2 = """
WITH t AS (SELECT DISTINCT ON (turn_id) episode_id, turn_no, turn_id, content FROM turns WHERE episode_id IS NOT NULL),
e AS (SELECT episode_id AS id, string_agg(coalesce(content, ''), ' ' ORDER BY turn_no, turn_id) AS text FROM t GROUP BY 1),
w AS (SELECT id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)') AS w FROM e),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE common >= 0.6 * (na.n + nb.n - common)
UNION SELECT a.id, b.id FROM w a JOIN w b ON a.w = b.w AND a.id < b.id WHERE len(a.w) > 0"""

SQL: dict[str, str] = {
    "p2_found": _P2,
    "p5_found": _P5 + " SELECT source_session FROM bad",
    "p5_conversations": _P5 + """ SELECT source_session, rn - 1 AS turn_no, role, kind, content
FROM s WHERE source_session NOT IN (SELECT source_session FROM bad)""",
}
