import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from corvane.llm import conversations as c

SCHEMA = "msg_id long, source_session string, seq int, role string, kind string, content string, ts timestamp, idx long, blank string"
T0 = datetime(2026, 1, 1)


def rows(session, msgs, start=0):
    return [(start + i, session, m[0], m[1], m[2], m[3], T0 + timedelta(seconds=m[4] if len(m) > 4 else i), 5, "x") for i, m in enumerate(msgs)]


U, A, C, R, S = ("user", "text"), ("assistant", "text"), ("assistant", "tool_call"), ("tool", "tool_result"), ("system", "text")


def msgs(*kinds, first=0, text="hi"):
    return [(first + i, *k, f"{text} {i}") for i, k in enumerate(kinds)]


CASES = {
    "good": (msgs(U, C, R, A, U, A), False), "from one": (msgs(U, A, first=1), False), "system counted": (msgs(S, U, S, A), False), "no answer": (msgs(U, A, U), True), "two asks": (msgs(U, U, A), True),
    "assistant first": (msgs(A, U, A), True), "no user": (msgs(A, A), True), "result alone": (msgs(U, R, A), True), "call alone": (msgs(U, C, A), True), "two calls": (msgs(U, C, C, R, A), True), "two results": (msgs(U, C, R, R, A), True),
    "gap": ([m for m in msgs(U, A, U, A) if m[0] != 1] + [(4, *A, "x")], True), "blank answer": ([(0, *U, "q"), (1, *A, " \t​")], True), "null answer": ([(0, *U, "q"), (1, *A, None)], True),
    "blank then answer": ([(0, *U, "q"), (1, *A, " "), (2, *A, "yes")], False), "same seq": (msgs(U, A) + [(1, *A, "other")], True), "logged twice": (msgs(U, A) + [(1, "AI", "text", "hi 1")], False), "roles": ([(0, " Human", "text", "q"), (1, "MODEL", "text", "a")], False),
    "no seq": ([(None, *U, "q", 1), (None, *A, "a", 2)], False), "no seq swapped": ([(None, *A, "a", 1), (None, *U, "q", 2)], True),
}


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_verdicts(spark, chunk):
    data, k = [], 0
    for name, (m, _) in CASES.items():
        part = rows(name, m, k)
        random.Random(name).shuffle(part)
        data += part + part[:2]
        k += 100
    data.append((10**6, None, 0, "user", "text", "lost", T0, 5, "x"))
    got = {r["source_session"]: r["broken"] for r in c.session_verdicts(spark.createDataFrame(data, SCHEMA), chunk).collect()}
    assert got == {n: b for n, (_, b) in CASES.items()}


def test_chunks_do_not_change_random_sessions(spark):
    rng = random.Random(2)
    data = []
    for s in range(120):
        m = [(i + (rng.random() < 0.03), *rng.choice([U, A, A, C, R, S]) , "t") for i in range(rng.randrange(1, 9))] if s % 2 else msgs(*[x for _ in range(rng.randrange(1, 6)) for x in rng.choice([(U, A), (U, C, R, A)])])
        data += rows(f"s{s}", m, s * 50)
    df = spark.createDataFrame(data, SCHEMA)
    assert {tuple(r) for r in c.dropped(df, 3).collect()} == {tuple(r) for r in c.dropped(df).collect()}


def test_rebuilt_order(spark):
    m = [(2, *A, "a"), (0, *S, "s"), (1, *U, "q")]
    got = [tuple(r) for r in c.rebuilt(spark.createDataFrame(rows("x", m), SCHEMA)).orderBy("turn_no").collect()]
    assert got == [("x", 0, "user", "text", "q"), ("x", 1, "assistant", "text", "a")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert c.dropped(none).count() == 0 and c.rebuilt(none).count() == 0


def test_kahn():
    assert c.kahn([[], [0], [0], [1, 2]], [0, 5, 1, 0]) == [0, 2, 1, 3]
    assert c.kahn([[1], [0], []], [0, 0, 0]) == [2] and c.kahn([], []) == []
    assert c.reply_order([1, 0, float("nan"), 1], [3, 9, 0, 1], [1, 2, 3, 4]) == [1, 3, 0, 2]


def test_kahn_orders_and_finds_cycles():
    nan = float("nan")
    assert c.reply_order([2, 0, 1], [1, 2, 3], [1, 2, 3], [True] * 3) == [1, 2, 0]
    assert c.reply_order([0, 1, 1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [True] * 4) == [0]
    assert c.reply_order([0, 1, 1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [True, True, False, True]) == [0, 1, 2, 3]
    assert c.reply_order([nan] * 3, [3, None, 1], [1, 2, 3], [True] * 3) == [2, 0, 1]


def test_without_kahn_other_rows(monkeypatch):
    """The rows are handed over as they arrived; the graph alone orders them and finds doubled numbers."""
    m = [(2, *U, "q2"), (3, *A, "a2"), (0, *U, "q1"), (1, *A, "a1")]
    g = pd.DataFrame([("s", 0, q, r, k, i, i, False, t, 0) for i, (q, r, k, t) in enumerate(m)], columns=["source_session", "chunk", "seq", "role", "kind", "at", "msg_id", "blank", "content", "before"])
    doubled = [(0, "user", "text", 0, 0, False), (1, "assistant", "text", 1, 1, False), (1, "assistant", "note", 2, 2, False)]
    assert c._placed(g)["content"].tolist() == ["q1", "a1", "q2", "a2"] and c._summary(doubled)[0]
    monkeypatch.setattr(c, "kahn", lambda parents, keys: list(range(len(keys))))
    assert c._placed(g)["content"].tolist() != ["q1", "a1", "q2", "a2"] and not c._summary(doubled)[0]


@pytest.mark.parametrize("chunk", [2, 4096])
def test_arrival_order_does_not_matter(spark, chunk):
    rng = random.Random(8)
    data = []
    for s in range(12):
        m = msgs(U, A, U, C, R, A)
        rng.shuffle(m)
        data += rows(f"s{s}", m, s * 50)
    df = spark.createDataFrame(data, SCHEMA)
    assert {(r[0], r[1], r[4]) for r in c.rebuilt(df, chunk).collect()} == {(f"s{s}", i, f"hi {i}") for s in range(12) for i in range(6)}
