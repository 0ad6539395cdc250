import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import bpe, dedup, episodes, gates, vectors
from corvane.operators.queries import QUERIES
from corvane.sources import facts, prometheus, shards

NEW = "sensor string, fact string, value double, seq long"


def lines(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


def test_appends_go_on_with_the_chain(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    facts.append(spark.createDataFrame([("s", "a", 1.0, 0), ("s", "b", None, 1), ("t", "a", 2.0, 5)], NEW), path)
    facts.append(spark.createDataFrame([("s", "a", 3.0, 2), ("t", "a", 4.0, 6), ("u", "a", 4.0, 0)], NEW), path)
    f = facts.read(spark, path)
    assert {r["sensor"]: (r["intact"], r["broken"]) for r in facts.intact(f).collect()} == {"s": (True, 0), "t": (True, 0), "u": (True, 0)}
    by = {(r["sensor"], r["seq"]): r for r in f.collect()}
    assert by["s", 0]["prev_sha256"] is None and by["s", 2]["prev_sha256"] == facts.digest(by["s", 1]["raw"])
    assert all(line == facts.line_of(json.loads(line)) for line in lines(spark, path))
    for old, new in (('"value":1.0', '"value":9.0'), (f'"prev_sha256":"{by["s", 1]["prev_sha256"]}"', '"prev_sha256":null')):
        edited = [(line.replace(old, new) if '"sensor":"s"' in line else line,) for line in lines(spark, path)]
        got = facts.intact(facts.parsed(spark.createDataFrame(edited, "value string")))
        assert {r["sensor"]: r["intact"] for r in got.collect()} == {"s": False, "t": True, "u": True}
    with pytest.raises(Exception, match="before those held"):
        facts.append(spark.createDataFrame([("s", "a", 3.0, 1)], NEW), path)
    with pytest.raises(ValueError, match="lack"):
        facts.append(spark.createDataFrame([(1,)], "seq long"), path)


def test_broken_line_stops_the_read(spark):
    with pytest.raises(Exception):
        facts.parsed(spark.createDataFrame([("{broken",)], "value string")).collect()


EVENTS = [
    ({"type": "user", "message": {"content": "do it"}}, True, [("user", "text", "do it")]),
    ({"type": "user", "isMeta": True, "message": {"content": "do it"}}, False, [("user", "text", "do it")]),
    ({"type": "user", "message": {"content": "  "}}, False, []),
    ({"type": "user", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_result", "content": [{"text": "x"}, {"content": [{"text": "y"}, "z"]}, 5]}]}}, False, [("user", "text", "a"), ("tool", "tool_result", "x\ny\nz")]),
    ({"type": "assistant", "message": {"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "b"}, {"type": "tool_use", "name": "run", "input": {"b": 1, "a": "ж"}}]}}, False, [("assistant", "text", "b"), ("assistant", "tool_call", '{"input": {"a": "ж", "b": 1}, "name": "run"}')]),
    ({"type": "user", "message": {"content": "x" * 300_000}}, True, [("user", "text", "x" * 200_000)]),
    ({"type": "summary"}, False, []), ([1], False, []), (None, False, []),
]


def test_events_to_turns(spark):
    rows = [(i, json.dumps(e, ensure_ascii=False)) for i, (e, _, _) in enumerate(EVENTS)] + [(90, None), (91, "{broken")]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(rows, "i long, raw string").select("i", episodes.parsed_event(F.col("raw")).alias("e")).collect()}
    for i, (_, opens, turns) in enumerate(EVENTS):
        assert got[i]["prompt"] == opens and [tuple(t) for t in got[i]["turns"]] == turns
    assert got[90]["turns"] == got[91]["turns"] == []


def test_token_windows_do_not_cross_shards(spark):
    stream = spark.createDataFrame([(s, p, t) for s, ts in (("a", range(10)), ("b", range(10, 20))) for p, t in enumerate(ts)], "shard string, pos long, token long")
    cand = spark.createDataFrame([(1, [3, 4, 5]), (2, [8, 9, 10]), (3, [9, 10]), (4, [18, 19, 77]), (5, None), (6, [12, 13, 14, 15])], "id long, ids array<long>")
    for chunk in (3, 4096):
        seen = {tuple(r["gram"]) for r in gates.stream_windows(stream, "shard", "pos", "token", 3, chunk).collect()}
        assert seen == {tuple(range(i, i + 3)) for i in (*range(8), *range(10, 18))}
    assert {r["id"] for r in gates.clean_of_stream(cand, "id", "ids", stream, "shard", "pos", "token", 3).collect()} == {2, 3, 4, 5}


def test_windows_of_texts_by_brute_force(spark):
    rng = random.Random(5)
    for n, a_pass in ((1, 1 << 20), (2, 7), (5, 1 << 20), (12, 7)):
        draw = lambda most, words=2 if n == 12 else 4: [rng.randrange(words) for _ in range(rng.randrange(most))]
        texts = [(draw(40),) for _ in range(6)] + [(None,), (list(range(10, 4130)),)]
        cand = [(i, draw(n + 4)) for i in range(40)] + [(40, None), (41, []), (42, [*range(4100, 4100 + n)]), (43, [*range(4100, 4099 + n), 5])]
        held = {tuple(t[i : i + n]) for (t,) in texts if t for i in range(len(t) - n + 1)}
        want = {k for k, t in cand if not any(tuple(t[i : i + n]) in held for i in range(len(t or ()) - n + 1))}
        got = gates.clean_of_texts(spark.createDataFrame(cand, "id long, t array<long>"), "id", "t", spark.createDataFrame(texts, "w array<long>"), "w", n, a_pass)
        assert {r["id"] for r in got.collect()} == want and 42 not in want


def test_windows_of_documents_are_not_sent_to_the_driver(spark, tmp_path):
    said = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, said), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, said[:60]), (2, "other words"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    df = QUERIES["token_window_clean"](spark, str(tmp_path))
    assert {r["item_id"] for r in df.collect()} == {2, 3}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "HashedRelationBroadcastMode(List(input[0, array<" not in plan


def test_leak_report(spark):
    w = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    ev = spark.createDataFrame([(1, w("src", 60)), (2, w("uniq", 20) + " " + w("shared", 12)), (3, "Short, text")], "id long, text string")
    src = spark.createDataFrame([("whole", w("src", 120)), ("gram", w("other", 30) + " " + w("shared", 12)), ("clean", w("clean", 40)), ("short", "a short, text here"), ("tok", w("src", 120)), (None, w("src", 120)), ("nulls", None)], "source string, text string")
    got = {r["src"]: r for r in gates.leak_report(src, "source", "text", ev, "id", token_sources=("tok",)).collect()}
    assert {k: (r["docs_overlap"], r["ngram_overlap"] > 0, r["examples"], r["verdict"]) for k, r in got.items()} == {
        "whole": (True, True, [1], "leak"), "gram": (False, True, [2], "leak"), "clean": (False, False, [], "clean"), "short": (True, False, [], "leak"), "tok": (None, True, [1], "leak"), "nulls": (False, False, [], "clean"),
    }
    assert {r["verdict"] for r in gates.leak_report(src, "source", "text", ev.limit(0), "id").collect()} == {"empty"}


def test_e2m1(spark):
    x = [0.0, 0.24, 0.25, 0.26, 0.75, 1.3, -2.5, 2.6, 3.5, 5.0, 5.1, -6.0, 0.0, 0.0, 0.0, 0.0]
    want = [0.0, 0.0, 0.0, 0.5, 0.5, 1.5, -2.0, 3.0, 3.0, 4.0, 6.0, -6.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, x), (2, [0.0] * 16)], "id long, v array<double>")
    got = {r["id"]: r["q"] for r in df.select("id", vectors.e2m1_block(F.col("v")).alias("q")).collect()}
    assert got == {1: want, 2: [0.0] * 16}
    e = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.06, 1.07, 447.0, 1000.0, 2.0**-9)], "x double").select(vectors.e4m3(F.col("x")).alias("y"))
    assert [r["y"] for r in e.collect()] == [0.0, 1.0, 1.0, 1.125, 448.0, 448.0, 2.0**-9]


def test_filters_and_probes(spark):
    paths = {"a/b.py": True, "data/x.md": False, "a/data/x.md": True, ".git/x": False, "a/.hid": False, "runs/x": False, "runs-2/x": False, "a/env/x": False, "a/b.PARQUET": False, None: False}
    got = {r["p"]: r["k"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", gates.in_snapshot(F.col("p")).alias("k")).collect()}
    assert got == paths
    one = spark.range(1)
    probe = lambda *v: tuple(one.select(gates.sensor_probe(*[F.lit(x) for x in v]).alias("p")).first()["p"])
    assert probe(False, True, True, True, 1.0, 2.0, "ok") == ("pass", "ok") and probe(True, False, False, False, 1.0, 2.0, "ok") == ("unverified", "pending")
    assert probe(False, True, False, True, 9.0, 2.0, "ok") == ("fail", "chain") and probe(False, True, True, True, 9.0, 2.0, "ok") == ("fail", "stale")
    assert probe(False, True, True, True, 1.0, 2.0, "unverified") == ("unverified", "last unverified")
    refs = spark.createDataFrame([("a", "0" * 64, ""), (" ", "0" * 63, None), (None, "G" * 64, "key a")], "p string, s string, sel string")
    assert [r[0] for r in refs.select(facts.raw_ref_violations(F.col("p"), F.col("s"), F.col("sel"))).collect()] == [[], ["path", "sha256", "selector"], ["path", "sha256"]]


def test_exposition_and_vocabulary(spark):
    df = spark.createDataFrame([("m", {"a": 'x"y'}, 2.0, "ok"), ("b", {}, 1.5, "ok"), ("c", {}, 1.0, "unverified")], "name string, labels map<string,string>, value double, status string")
    assert [r["line"] for r in prometheus.exposition(df).collect()] == ["b 1.5", 'm{a="x\\"y"} 2.0', "# EOF"]
    v = spark.createDataFrame([("b", 1), ("a", 0)], "s string, r int")
    assert bpe.vocabulary_hash(v, "s", "r").first()["sha256"] == bpe.vocabulary_hash(v.orderBy("s"), "s", "r").first()["sha256"]


def test_empty_input_opens_no_gate(spark):
    """Guards on absent input: none of them passes."""
    none = spark.createDataFrame([], "repo string, approved boolean, met boolean")
    assert gates.unmet_pins(none, none, "repo", "approved", "met").count() == 0
    missing = spark.createDataFrame([("r", True)], "repo string, approved boolean")
    assert gates.unmet_pins(missing, none, "repo", "approved", "met").first()["violation"] == "missing"
    null = F.lit(None).cast("string")
    assert spark.range(1).select(gates.raw_probe(null, null)).first()[0] == "unverified"
    assert spark.range(1).select(gates.sensor_probe(F.lit(False), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(1.0), F.lit("ok"))["verdict"]).first()[0] == "fail"


def test_near_prior(spark):
    base = [f"b{i}" for i in range(60)]
    text = lambda *k: " ".join("x" if i in k else w for i, w in enumerate(base))
    cand = spark.createDataFrame([(1, text(3)), (2, text(*range(0, 60, 5))), (3, None), (4, "a b"), (5, text(3))], "doc_id long, text string")
    prior = spark.createDataFrame([(10, text()), (11, None)], "doc_id long, text string")
    assert {r[0] for r in dedup.near_prior(cand, prior, "doc_id", "text").collect()} == {1, 5}
    assert dedup.near_prior(cand, prior.limit(0), "doc_id", "text").count() == 0


def test_pin_and_changed_configuration(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "k long, t string")
    a, b = shards.sorted_jsonl(df, f"file://{tmp_path}/a", "k"), shards.sorted_jsonl(df.orderBy("t"), f"file://{tmp_path}/b", "k")
    assert a == b and [r[0] for r in spark.read.text(f"file://{tmp_path}/a").collect()] == ['{"k":1,"t":null}', '{"k":2,"t":"b"}', '{"k":3,"t":"c"}']
    m = shards.write(df, f"file://{tmp_path}/s", 2, {"seed": 1})
    shards.refuse_changed(m, {"seed": 1})
    with pytest.raises(ValueError, match="different configuration"):
        shards.refuse_changed(m, {"seed": 2})
