"""Rebuilding conversations from message rows.

The rows of a session, as they arrived, are the nodes of a reply graph: a numbered message replies to the
messages of the number before it, and different spoken messages that claim one number must each follow the
others, which is a cycle. Kahn's algorithm orders the graph, taking the earliest timestamp among the ready
nodes (in sessions without numbers all nodes are ready, so time orders them); nodes left over lie on or
behind a cycle and break the session. Opening, answers, tool calls and gaps are checked in Kahn's order,
and the order of the rebuilt conversations is Kahn's.

A session of more than ``CHUNK`` messages is split into ranges of its numbers or times, each with a graph of
its own. A chunk is summed up as a transition (what it needs of the state before it, what it leaves behind),
so a session of any length is checked exactly without one task holding it.

Defined cases: rows without ``source_session`` are ignored; blank means null or white space of any
kind, invisible characters included; roles are compared without case and blanks, with the spellings in
``ROLES``; an unknown role is no speaker and only counts as a message; null ``seq`` sorts last in a
session that has numbers; null ``ts`` sorts last; rows without ``seq`` are one message only if ``ts``
is equal too; empty input gives empty output; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.grouped import sorted_group_map
from corvane.plans.materialize import is_empty, materialize
from corvane.plans.ranking import rank_in_group

CHUNK = 4096
#: Spellings of speaker roles, lower case.
ROLES = {
    "user": "user", "human": "user", "customer": "user", "client": "user",
    "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant", "gpt": "assistant",
    "tool": "tool", "function": "tool", "tool_result": "tool",
    "system": "system", "developer": "system",
}
_BLANK = r"^[\s\x{00a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}\x{00ad}\x{0085}]*$"


def kahn(parents: Sequence[Sequence[int]], keys: Sequence) -> list[int]:
    """Topological order of nodes 0..n-1; the least key among ready nodes goes first.

    Nodes on or behind a cycle are missing from the result.
    """
    n = len(keys)
    need = [len(p) for p in parents]
    children: list[list[int]] = [[] for _ in range(n)]
    for i, ps in enumerate(parents):
        for p in ps:
            children[p].append(i)
    ready = [(keys[i], i) for i in range(n) if not need[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for c in children[i]:
            need[c] -= 1
            if not need[c]:
                heapq.heappush(ready, (keys[c], c))
    return out


def reply_order(seq: Sequence[float], ts: Sequence, ids: Sequence, spoken: Sequence[bool] | None = None) -> list[int]:
    """Positions in reply order: numbered messages reply to the number before, others follow by time.

    Spoken messages of one number follow each other in a ring, so they and all behind them are left out.
    One barrier node a number keeps the graph linear where many messages share a number.
    """
    n = len(ts)
    levels = sorted({s for s in seq if s == s})
    at = {s: n + i for i, s in enumerate(levels)}
    parents: list[list[int]] = [[] for _ in range(n + len(levels))]
    ring: dict[float, list[int]] = {}
    for i, s in enumerate(seq):
        if s == s:
            if (k := at[s]) > n:
                parents[i].append(k - 1)
            parents[k].append(i)
            if spoken is not None and spoken[i]:
                ring.setdefault(s, []).append(i)
        elif levels:
            parents[i].append(n + len(levels) - 1)
    for same in ring.values():
        if len(same) > 1:
            for a, b in zip(same, [*same[1:], same[0]]):
                parents[b].append(a)
    big = (1, 0)
    keys = [((1, 0) if t is None or t != t else (0, t), m) for t, m in zip(ts, ids)] + [(big, 0)] * len(levels)
    return [i for i in kahn(parents, keys) if i < n]


def clean(rows: DataFrame, keep: bool = False) -> DataFrame:
    """Each message once, with clean role and a blank flag; ``keep`` retains the content."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[role], role)
    base = rows.where("source_session IS NOT NULL").select(
        "source_session",
        F.col("seq").cast("long").alias("seq"),
        mapped.alias("role"),
        F.lower(F.trim(F.coalesce("kind", F.lit("")))).alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "msg_id",
        F.md5(F.coalesce("content", F.lit("\x00null"))).alias("digest"),
        (F.col("content").isNull() | F.col("content").rlike(_BLANK)).alias("blank"),
        *(["content"] if keep else []),
    )
    same = F.when(F.col("seq").isNull(), F.col("at")).alias("same_at")
    return base.groupBy("source_session", "seq", "role", "kind", "digest", same).agg(
        F.min("at").alias("at"), F.min("msg_id").alias("msg_id"), F.any_value("blank").alias("blank"),
        *([F.any_value("content").alias("content")] if keep else []),
    ).drop("digest", "same_at")


def chunked(rows: DataFrame, keep: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Clean messages with their ``chunk``: 0, or the range of its numbers or times in a session beyond ``chunk`` messages."""
    c = materialize(clean(rows, keep), "messages")
    large = c.groupBy("source_session").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("source_session")
    long = c.join(large, "source_session", "left_semi")
    if is_empty(long):
        return c.withColumn("chunk", F.lit(0).cast("long"))
    ranked = rank_in_group(long.withColumns({"no_seq": F.col("seq").isNull(), "no_at": F.col("at").isNull()}), "source_session", ["no_seq", "seq", "no_at", "at", "msg_id"], "idx")
    split = ranked.withColumn("chunk", F.floor(F.col("idx") / chunk).cast("long")).select(*c.columns, "chunk")
    return c.join(large, "source_session", "left_anti").withColumn("chunk", F.lit(0).cast("long")).unionByName(split)


_SUMMARY = (
    "source_session string, chunk long, bad boolean, user_text boolean, asst_text boolean, first_role string,"
    " meets string, pending boolean, tool_needs string, tool_open boolean, lo long, hi long, lo_spoken long, hi_spoken long, spoken long"
)


def _order(rows: list[tuple]) -> list[int]:
    return reply_order([r[0] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[1] != "system" for r in rows])


def _summary(rows: list[tuple]) -> tuple:
    """Of (seq, role, kind, at, msg_id, blank) tuples in any order."""
    order = _order(rows)
    bad = len(order) < len(rows)
    user_text = asst_text = False
    first_role = meets = tool_needs = None
    pending = tool_open = None
    lo = hi = lo_spoken = hi_spoken = None
    spoken = 0
    for i in order:
        seq, role, kind, _, _, blank = rows[i]
        numbered = seq == seq
        if numbered:
            bad |= hi is not None and seq - hi > 1
            lo, hi = seq if lo is None else lo, seq
        if role == "system":
            continue
        spoken += 1
        if numbered:
            lo_spoken, hi_spoken = seq if lo_spoken is None else lo_spoken, seq
        first_role = first_role or role
        if role == "user":
            user_text |= kind == "text" and not blank
            if pending is None:
                meets = meets or "ask"
            bad |= pending is True
            pending = True
        elif role == "assistant" and kind == "text" and not blank:
            asst_text = True
            if pending is None:
                meets = meets or "answer"
            pending = False
        if kind == "tool_call":
            if tool_open is None:
                tool_needs = tool_needs or "closed"
            bad |= tool_open is True
            tool_open = True
        elif kind == "tool_result":
            if tool_open is None:
                tool_needs = tool_needs or "open"
            bad |= tool_open is False
            tool_open = False
    return bad, user_text, asst_text, first_role, meets, pending, tool_needs, tool_open, lo, hi, lo_spoken, hi_spoken, spoken


def _each_group(g: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, slice]]:
    k = [g[c].to_numpy() for c in keys]
    new = np.ones(len(g), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in k])
    start = np.flatnonzero(new)
    for a, b in zip(start, np.r_[start[1:], len(g)]):
        yield tuple(c[a] for c in k), slice(a, b)


def _columns(g: pd.DataFrame) -> list[list]:
    cols = [g[c].tolist() for c in ("seq", "role", "kind", "at", "msg_id", "blank")]
    cols[0] = [float("nan") if x is None or x != x else int(x) for x in cols[0]]
    cols[3] = [None if x is None or x != x else x for x in cols[3]]
    return cols


def _summaries(g: pd.DataFrame) -> pd.DataFrame:
    cols = _columns(g)
    names = [x.split()[0] for x in _SUMMARY.split(",")]
    out = [(s, c, *_summary(list(zip(*(x[sl] for x in cols))))) for (s, c), sl in _each_group(g, ["source_session", "chunk"])]
    df = pd.DataFrame(out, columns=names)
    for c in ("lo", "hi", "lo_spoken", "hi_spoken"):
        df[c] = df[c].astype("Int64")
    return df


def verdict(chunks: Sequence[tuple]) -> bool:
    """Whether a session is broken, from the summaries of its chunks in order."""
    user_text = asst_text = pending = tool_open = False
    first_role = hi = hi_spoken = None
    for bad, ut, at, first, meets, after, needs, opened, lo, h, lo_s, hi_s, _ in chunks:
        if bad or pending and meets == "ask" or needs == "closed" and tool_open or needs == "open" and not tool_open:
            return True
        if hi is not None and lo is not None and lo - hi > 1 or hi_spoken is not None and lo_s is not None and lo_s == hi_spoken:
            return True
        user_text |= ut
        asst_text |= at
        first_role = first_role or first
        pending = pending if after is None else after
        tool_open = tool_open if opened is None else opened
        hi, hi_spoken = h if h is not None else hi, hi_s if hi_s is not None else hi_spoken
    return not (user_text and asst_text) or first_role != "user" or pending or tool_open


def _verdicts(g: pd.DataFrame) -> pd.DataFrame:
    fields = [x.split()[0] for x in _SUMMARY.split(",")][2:]
    cols = [[None if x is None or x is pd.NA or x != x else x for x in g[c].astype(object).tolist()] for c in fields]
    out = [(s, verdict(list(zip(*(x[sl] for x in cols))))) for (s,), sl in _each_group(g, ["source_session"])]
    return pd.DataFrame(out, columns=["source_session", "broken"])


def _summed(parts: DataFrame) -> DataFrame:
    slim = parts.select("source_session", "chunk", "seq", "role", "kind", "at", "msg_id", "blank")
    return sorted_group_map(slim, ["source_session", "chunk"], ["msg_id"], _summaries, _SUMMARY)


def _judge(summed: DataFrame) -> DataFrame:
    return sorted_group_map(summed, ["source_session"], ["chunk"], _verdicts, "source_session string, broken boolean")


def session_verdicts(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(source_session, broken) for every session."""
    return _judge(_summed(chunked(rows, chunk=chunk)))


def dropped(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(source_session): the sessions to leave out."""
    return session_verdicts(rows, chunk).where("broken").select("source_session")


def _placed(g: pd.DataFrame) -> pd.DataFrame:
    """Spoken messages of whole chunks in Kahn's order, with their turn number in the session."""
    cols, role = _columns(g), g["role"].to_numpy()
    rows, turn = [], []
    for _, sl in _each_group(g, ["source_session", "chunk"]):
        said = [sl.start + i for i in _order(list(zip(*(x[sl] for x in cols)))) if role[sl.start + i] != "system"]
        rows += said
        turn += range(len(said))
    out = g.iloc[rows]
    return out[["source_session", "role", "kind", "content"]].assign(turn_no=out["before"] + np.array(turn, np.int64))[["source_session", "turn_no", "role", "kind", "content"]]


def rebuilt(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(source_session, turn_no, role, kind, content): the whole sessions, each message once, in order."""
    parts = materialize(chunked(rows, keep=True, chunk=chunk), "chunks")
    summed = materialize(_summed(parts), "summaries")
    # spoken messages of the chunks before; a session has one row a chunk here
    w = Window.partitionBy("source_session").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = summed.select("source_session", "chunk", F.coalesce(F.sum("spoken").over(w), F.lit(0)).alias("before"))
    whole = before.join(_judge(summed).where("NOT broken"), "source_session", "left_semi")
    said = parts.join(whole, ["source_session", "chunk"])
    return sorted_group_map(said, ["source_session", "chunk"], ["msg_id"], _placed, "source_session string, turn_no long, role string, kind string, content string")
