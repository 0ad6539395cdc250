"""Queries over whole tables: brute force on tables none of whose rows a query may leave out."""

from datetime import datetime, timedelta

from corvane.operators.queries import QUERIES

T0 = datetime(2026, 1, 1)


def tables(spark, path, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_fact_history_of_every_event(spark, tmp_path):
    events = [(i, "ab"[i % 2], float(i)) for i in range(1, 26)]
    d = tables(spark, tmp_path, events=(events, "event_id long, event_type string, value double"))
    assert {tuple(r) for r in QUERIES["fact_history"](spark, d).select("fact", "value", "intact").collect()} == {("a", 24.0, True), ("b", 25.0, True)}


def test_unique_reports_of_every_event_and_spelling(spark, tmp_path):
    spelled = ["2026-01-01T00:00:00Z", "2026-01-01T06:00:00", "2026-01-01 12:00:00", "2026-01-01T21:00:00+03:00", None]
    events = [(i, T0 + timedelta(hours=6 * i, minutes=5), f"type {i}") for i in range(4)] + [(4, T0 + timedelta(hours=18, minutes=9), "other")]
    d = tables(spark, tmp_path, episodes=([(f"e{i}", s) for i, s in enumerate(spelled)], "id string, started_at string"), events=(events, "event_id long, ts timestamp, event_type string"))
    got = {r["id"]: (r["status"], r["ambiguous"]) for r in QUERIES["unique_reports"](spark, d).collect()}
    assert got == {"e0": ("type 0", False), "e1": ("type 1", False), "e2": ("type 2", False), "e3": (None, True), "e4": (None, False)}


def test_unexplained_jumps_of_every_step(spark, tmp_path):
    steps = [-500, -400, 0, 1, 400, 401, 970, 2599, 2600, 3000, 3400, 3401, 2**31 - 1]
    d = tables(spark, tmp_path, metrics=([(i, s, 1.0) for i, s in enumerate(steps)], "row_id long, step long, loss double"))
    ledger = [s for s in steps if s % 3000 == 0 and 0 <= s <= 1_000_000]
    want = {i for i, s in enumerate(steps) if all(abs(s - p) > 400 for p in ledger)}
    assert {r["row_id"] for r in QUERIES["unexplained_jumps"](spark, d).collect()} == want


def test_corpus_operators_take_every_language(spark, tmp_path):
    docs = [(i, lang, "abc"[: i % 3 + 1] * 20, 100 * i) for i, lang in enumerate(["de", "en", None, "ru", "de", "en", "en", "fr", "ru", "en"])]
    d = tables(spark, tmp_path, documents=(docs, "doc_id long, lang string, text string, n_chars long"))
    total, run, want = sum(n for *_, n in docs), 0, {}
    for i, _, _, n in docs:
        want[i] = 8192 if run < 0.9 * total else 65536
        run += n
    assert {r["doc_id"]: r["context"] for r in QUERIES["curriculum"](spark, d).collect()} == want
    assert {r["doc_id"]: (r["batch"], r["padding"]) for r in QUERIES["length_batches"](spark, d).collect()} == {i: (i // 8, 100 * ((7 if i < 8 else 9) - i)) for i in range(10)}
    packed = {i: ([1, *map(ord, t[:30]), 2] + [0] * 32)[:32] for i, _, t, _ in docs}
    assert {r["doc_id"]: (r["inputs"], r["labels"]) for r in QUERIES["packed_sequences"](spark, d).collect()} == {i: (",".join(map(str, f[:31])), ",".join(map(str, f[1:]))) for i, f in packed.items()}


def test_sessions_without_seq_are_in_order_of_time(spark, tmp_path):
    said = [("user", "text", "ask"), ("function", "tool_result", "3 passed"), ("ai", "text", '{"status": "complete"}'), ("human", "text", "more"), ("tool", "tool_result", "2 failed"), ("assistant", "text", "done here")]
    # msg_id runs against time where there is no seq, time against seq where there is one
    old = [(20 - i, "old", None, *m, T0 + timedelta(seconds=i)) for i, m in enumerate(said)]
    new = [(40 - i, "new", i, *m, T0 - timedelta(seconds=i)) for i, m in enumerate(said)]
    d = tables(spark, tmp_path, session_turns=([*new, *old, old[2]], "msg_id long, source_session string, seq int, role string, kind string, content string, ts timestamp"))
    e = {r["id"]: (r["source_session"], r["episode"], r["n_turns"]) for r in QUERIES["session_episodes"](spark, d).collect()}
    assert sorted(e.values()) == [("new", 0, 3), ("new", 1, 3), ("old", 0, 3), ("old", 1, 3)]
    assert {(*e[r["id"]][:2], r["result_chars"], r["answer_chars"]) for r in QUERIES["last_frames"](spark, d).collect()} == {(s, i, 8, (22, 9)[i]) for s in ("new", "old") for i in (0, 1)}
    assert {(*e[r["id"]][:2], r["class"]) for r in QUERIES["classified"](spark, d).collect()} == {(s, i, ("verified-complete", "verified-failed")[i]) for s in ("new", "old") for i in (0, 1)}
