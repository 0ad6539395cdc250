"""Episodes from session events: sessionizing, last frames, status contracts, classes, structure of answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.plans.ranking import rank_in_group

#: Words of suites that ran; the red ones decide over the green ones.
GREEN = r"(?i)\b\d+ passed\b"
RED = r"(?i)\b\d+ (?:failed|errors?)\b|\bFAILED\b"
#: Status words and their outcome (fixed values).
STATUS = {"complete": "complete", "partial": "partial", "failed": "failed", "blocked": "failed"}


def sessionized(events: DataFrame, session: str, order: list[str], opens: Column) -> DataFrame:
    """``events`` with ``episode`` (0-based per session, opened by each prompt); events before the first are out.

    The running count comes from a distributed numbering, so no task holds a session.
    """
    flagged = events.withColumn("_open", F.coalesce(opens, F.lit(False)).cast("int"))
    counted = rank_in_group(flagged, session, order, "_at", total="_open", running="_run")
    return counted.withColumn("episode", F.col("_run").cast("long") - 1).where("episode >= 0").drop("_open", "_at", "_run")


def episode_id(session: Column, index: Column) -> Column:
    """``ep-`` and 16 hex digits of the digest of session, NUL and index."""
    return F.concat(F.lit("ep-"), F.substring(F.sha2(F.concat(session, F.char(F.lit(0)), index.cast("string")), 256), 1, 16))


def gathered(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """One row an episode: ordered turns, first and last time."""
    turn = F.struct(*order, "role", "kind", "content")
    g = events.groupBy(session, "episode").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return g.select(
        session, "episode", episode_id(F.col(session), F.col("episode")).alias("id"), "started_at", "ended_at",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["kind"].alias("kind"), x["content"].alias("content"))).alias("turns"),
    )


def last_results(turns: Column, n: int = 5) -> Column:
    """The last ``n`` tool results joined by line ends."""
    r = F.filter(turns, lambda t: t["kind"] == "tool_result")
    return F.array_join(F.transform(F.slice(r, F.greatest(F.size(r) - n + 1, F.lit(1)), n), lambda t: F.coalesce(t["content"], F.lit(""))), "\n")


def last_answer(turns: Column) -> Column:
    a = F.filter(turns, lambda t: (t["role"] == "assistant") & (t["kind"] == "text"))
    return F.when(F.size(a) > 0, F.element_at(a, -1)["content"])


def trailing_status(text: str | None) -> str | None:
    """``status`` of the last top-level JSON object, if only blanks or a fence follow it."""
    if not text:
        return None
    s = re.sub(r"(?:\s|`{3,}[\w-]*)+$", "", text)
    if not s.endswith("}"):
        return None
    decoder, at = json.JSONDecoder(), s.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(s, at)
        except ValueError:
            at = s.find("{", at + 1)
            continue
        if end == len(s):
            status = value.get("status") if isinstance(value, dict) else None
            return status if isinstance(status, str) else None
        at = s.find("{", end)
    return None


@F.pandas_udf(T.StringType())
def contract(s: pd.Series) -> pd.Series:
    return s.map(trailing_status)


def suite(text: Column) -> Column:
    """green, red or null by what the last results say."""
    return F.when(text.rlike(RED), "red").when(text.rlike(GREEN), "green")


def outcome(status: Column, suite_state: Column, report: Column) -> Column:
    """Class of an episode: a red suite or failed contract or report fails it; a contract must not be contradicted."""
    said = F.coalesce(*[F.when(status == k, v) for k, v in STATUS.items()])
    return (
        F.when((said == "failed") | (report == "failed"), "verified-failed")
        .when(suite_state == "red", "verified-failed")
        .when((said == "complete") & (suite_state == "green"), "verified-complete")
        .when((said == "partial") & (suite_state == "green"), "verified-partial")
        .when(said.isNull() & (report == "complete"), "verified-complete")
        .otherwise("unverified")
    )


def admitted(df: DataFrame, cls: str = "class") -> tuple[DataFrame, DataFrame]:
    """(records for training, pool of failures)."""
    return df.where(F.col(cls).isin("verified-complete", "verified-partial")), df.where(F.col(cls) == "verified-failed")


# --- events to turns --------------------------------------------------------------------------------

#: Longest turn taken, in characters (fixed value).
MAX_TURN = 200_000
_TURNS = T.StructType([T.StructField("prompt", T.BooleanType()), T.StructField("turns", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("role", "kind", "content")])))])


def _flat(block: object) -> str:
    """Text of a block: its own, or that of the blocks it holds, one a line."""
    if isinstance(block, str):
        return block
    if isinstance(block, dict):
        for held in (block.get("text"), block.get("content")):
            if isinstance(held, str):
                return held
            if isinstance(held, list) and (inner := "\n".join(filter(None, map(_flat, held)))):
                return inner
    return ""


def event_of(raw: str | None) -> tuple[bool, list[tuple[str, str, str]]]:
    """(opens an episode, turns) of one JSON event; what is no event gives no turns.

    A user's event opens an episode if it is not meta and says something, and brings no tool result.
    """
    try:
        event = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        event = None
    message = event.get("message") if isinstance(event, dict) else None
    content = message.get("content") if isinstance(message, dict) else None
    who = event.get("type") if isinstance(event, dict) else None
    if who == "user" and isinstance(content, str):
        content = [{"type": "text", "text": content}]
    turns: list[tuple[str, str, str]] = []
    for block in content if isinstance(content, list) else ():
        kind = block.get("type") if isinstance(block, dict) else None
        said = str(block.get("text", "")) if kind == "text" else ""
        if said.strip() and who in ("user", "assistant"):
            turns.append((who, "text", said[:MAX_TURN]))
        elif kind == "tool_result" and who == "user":
            inner = block.get("content")
            flat = "\n".join(filter(None, map(_flat, inner))) if isinstance(inner, list) else _flat(inner)
            turns.append(("tool", "tool_result", flat[:MAX_TURN]))
        elif kind == "tool_use" and who == "assistant":
            call = json.dumps({"name": str(block.get("name", "")), "input": block.get("input", {})}, ensure_ascii=False, sort_keys=True)
            turns.append(("assistant", "tool_call", call[:MAX_TURN]))
    kinds = {k for _, k, _ in turns}
    return who == "user" and not event.get("isMeta") and kinds == {"text"}, turns


@F.pandas_udf(_TURNS)
def parsed_event(s: pd.Series) -> pd.DataFrame:
    """prompt and turns of JSON events."""
    got = [event_of(x) for x in s]
    return pd.DataFrame({"prompt": [p for p, _ in got], "turns": [[dict(zip(("role", "kind", "content"), t)) for t in ts] for _, ts in got]})


# --- structure of answers with thinking -----------------------------------------------------------

_TAG = re.compile(r"</?think>|</?tool_call>|</?answer>")


def structure(text: str | None) -> list[str]:
    """Defects of one answer: unclosed_think, tool_call_in_think, no_answer, truncated."""
    if text is None:
        return ["no_answer"]
    inside, seen_call, out, end = False, False, [], 0
    for m in _TAG.finditer(text):
        tag = m.group(0)
        if tag == "<think>":
            inside = True
        elif tag == "</think>":
            inside = False
        elif tag == "<tool_call>":
            seen_call = True
            if inside:
                out.append("tool_call_in_think")
        end = m.end()
    if inside:
        out.append("unclosed_think")
    if not inside and not seen_call and not text[end:].strip():
        out.append("no_answer")
    if text.count("<tool_call>") > text.count("</tool_call>"):
        out.append("truncated")
    return sorted(set(out))


def normalized(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """Text with open tags closed, and the edits (start, old, new) that undo it when applied backwards."""
    edits: list[tuple[int, str, str]] = []
    call = text.rfind("<tool_call>")
    if text.count("<think>") > text.count("</think>"):
        at = call if call > text.rfind("<think>") else len(text)
        edits.append((at, "", "</think>"))
        text = text[:at] + "</think>" + text[at:]
    return text, edits


def restored(text: str, edits: list[tuple[int, str, str]]) -> str:
    for start, old, new in reversed(edits):
        text = text[:start] + old + text[start + len(new) :]
    return text


@F.pandas_udf(T.ArrayType(T.StringType()))
def structure_defects(s: pd.Series) -> pd.Series:
    return s.map(structure)


# --- rewards ----------------------------------------------------------------------------------------


def reward(passed: Column, base: Column, final: Column, spent: Column, budget: Column) -> Column:
    """1 for passing, half the restored share, minus up to a quarter for new violations, minus 1 beyond twice the budget."""
    remaining = F.size(F.array_intersect(base, final))
    new = F.size(F.array_except(final, base))
    restored_share = F.when(F.size(base) == 0, 1.0).otherwise(1 - remaining / F.size(base))
    return passed.cast("double") + 0.5 * restored_share - 0.25 * F.least(new, F.lit(4)) / 4 - (spent > 2 * budget).cast("double")
