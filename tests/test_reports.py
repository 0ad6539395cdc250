import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import dedup, reports


def test_greedy_near_dedup_equals_loop(spark):
    rng = random.Random(12)
    texts, w = [], [f"w{rng.randrange(900)}" for _ in range(120)]
    for _ in range(14):  # a drifting chain: neighbours are alike, the ends are not
        texts.append(" ".join(w))
        for _ in range(2):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = []
    for t in texts:
        x = t.split()
        sets.append({tuple(x[i : i + 5]) for i in range(len(x) - 4)})
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    linked = {(r["a"], r["b"]) for r in dedup.near_pairs(df, "id", "text").collect()}
    assert linked == {(a, b) for a in range(14) for b in range(a + 1, 14) if sim(a, b) >= 0.8}
    kept, dropped = [], set()
    for i in range(len(texts)):
        if any((k, i) in linked for k in kept):
            dropped.add(i)
        else:
            kept.append(i)
    assert {r["id"] for r in reports.greedy_near_dedup(df, "id", "text").collect()} == dropped
    assert reports.greedy_near_dedup(df.limit(0), "id", "text").count() == 0


def test_containment(spark):
    a = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y"), (3, None)], "k long, text string")
    b = spark.createDataFrame([(7, "zero a b c d e f g h nine"), (8, "a b c d e z z z")], "o long, text string")
    assert [(r["k"], r["o"]) for r in reports.containment(a, b, "k", "text", "o").collect()] == [(1, 7)]


def test_uncovered(spark):
    d = spark.createDataFrame([("a", {"app": "x", "tier": "1"}), ("b", {"app": "y"}), ("c", {})], "name string, labels map<string,string>")
    s = spark.createDataFrame([({"app": "x"},), ({},), ({"app": "y", "tier": "1"},)], "selector map<string,string>")
    assert sorted(r["name"] for r in reports.uncovered(d, s, "name", "labels", "selector").collect()) == ["b", "c"]


def test_names_claims_divergence(spark):
    df = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "k string")
    t = lambda rows: spark.createDataFrame(rows, "key string, name string")
    got = {r["k"]: r["name"] for r in reports.first_name(df, "k", t([("k1", "a")]), t([("k1", "z"), ("k2", "b")])).collect()}
    assert got == {"k1": "a", "k2": "b", "k3": None}
    c = spark.createDataFrame([("up", "e2e", "pass"), ("e2e", None, "fail"), ("ok", "up", "pass")], "claim string, pair string, verdict string")
    assert [r["claim"] for r in reports.divergence(c, "claim", "pair", "verdict").collect()] == ["up"]
    x = spark.createDataFrame([("about 12,500 tokens", 12500.0), ("12 500", 12500.0), ("0.27 %", 0.27), ("none", 3.0)], "t string, v double")
    assert [r["r"] for r in x.select(reports.claimed(F.col("t"), F.col("v")).alias("r")).collect()] == [True, True, True, False]


@pytest.mark.parametrize(("text", "want"), [('{"a": [{"identical": true}], "identical": true}', "pass"), ('[{"identical": true}, {"x": {"identical": false}}]', "fail"), ("{}", "unverified"), ("oops", "unverified"), (None, "unverified"), ('{"identical": 1}', "fail")])
def test_all_true(text, want):
    assert reports.all_true(text) == want


def test_nested_documents(spark, tmp_path):
    change = lambda t, *a: {"type": t, "change": {"actions": list(a)}}
    (tmp_path / "plan.json").write_text(json.dumps({"resource_changes": [change("vm", "create"), change("vm", "delete", "create"), change("net", "update"), change("net", "delete")]}))
    got = {r["type"]: (r["create"], r["update"], r["delete"], r["replace"]) for r in reports.plan_actions(spark, str(tmp_path / "plan.json")).collect()}
    assert got == {"vm": (1, 0, 0, 1), "net": (0, 1, 1, 0)}
    (tmp_path / "api.json").write_text(json.dumps({"paths": {"/a": {"get": {}, "summary": "x"}, "/b": {"post": {}, "get": {}}}}))
    assert reports.api_surface(spark, str(tmp_path / "api.json")).count() == 3
    con = sqlite3.connect(tmp_path / "t.db")
    con.executescript("CREATE TABLE k (start INT, stop INT); INSERT INTO k VALUES (1, 5), (7, 6), (8, 9);")
    con.close()
    files = spark.createDataFrame([(str(tmp_path / "t.db"),)], "path string")
    assert reports.sqlite_table(spark, files, "SELECT start, stop FROM k WHERE stop > start", "start long, stop long").count() == 2


def test_registry():
    text = "# sensors\nname: x\nlevels:\n  - 1\n  - b\nnested:\n  on: true\n  rate: 0.5\nitems:\n  - id: a\n    n: 2\n  - id: 'b: c'\nnone:\n"
    assert reports.registry(text) == {"name": "x", "levels": [1, "b"], "nested": {"on": True, "rate": 0.5}, "items": [{"id": "a", "n": 2}, {"id": "b: c"}], "none": None}
    for bad in ("a: &x 1", "just text", "- a", 'a: "open'):
        with pytest.raises(ValueError):
            reports.registry(bad)


def test_selections(spark):
    p = spark.createDataFrame([("g", i, v) for i, v in enumerate((0.5, 0.3, 0.2))], "g string, k int, p double")
    assert [(r["k"], round(r["p"], 3)) for r in reports.nucleus(p, "g", "k", "p", 0.6).orderBy("k").collect()] == [(0, 0.625), (1, 0.375)]
    c = spark.createDataFrame([("base", 100.0, 2.0), ("a", 96.5, 2.1), ("b", 90.0, 2.9), ("c", 96.0, 2.2)], "k string, d double, g double")
    assert [r["k"] for r in reports.best_checkpoint(c, "k", "d", "g", "base").collect()] == ["c"]
    m = spark.createDataFrame([("x", "g1", False), ("x", "g2", True), ("y", "g1", False)], "c string, g string, h boolean")
    assert reports.detection_matrix(m, "c", "g", "h").first().asDict() == {"all_detected": False, "undetected": ["y"]}
    assert spark.range(1).select(reports.human_bytes(F.lit(3 * 2**20)).alias("r")).first()["r"] == "3.0 MiB"
    assert spark.createDataFrame([("a\nb\nc",)], "t string").select((reports.fragment(F.col("t"), 2) == F.sha2(F.lit("b"), 256)).alias("r")).first()["r"]
    assert spark.range(1).select(tx.coin("a", F.lit(1)).alias("r")).first()["r"] < 1
