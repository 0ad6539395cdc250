"""Core operators against closed forms and brute force on small frames."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import bpe, dedup, episodes, intervals, mix, properties, series, vectors

T0 = datetime(2026, 1, 1)


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


# --- text -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("licenses", "want"), [(["MIT"], True), (["mit", "gpl-3.0"], False), ([], False), (None, False)])
def test_license_gate(spark, licenses, want):
    assert one(spark, licenses, tx.all_licensed, "array<string>") is want


@pytest.mark.parametrize("text", ["плюс" * 9, "a" * 40, "aé" * 15, "日本語" * 8, "x😀" * 9, "short", ""])
@pytest.mark.parametrize("limit", [11, 12, 13, 14, 15])
def test_cut_bytes_keeps_characters(spark, text, limit):
    got = one(spark, text, lambda c: tx.cut_bytes(c, limit))
    raw = text.encode()[:limit]
    assert got == raw.decode(errors="ignore")


def test_ngrams_and_words(spark):
    assert one(spark, "A-b, c1_Д e", tx.words) == ["a", "b", "c1", "д", "e"]
    assert one(spark, ["a", "b", "c"], lambda c: tx.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: tx.ngrams(c, 2), "array<string>") == []


def test_scrub(spark):
    h = "0123456789abcdef0123456789abcdef01234567"
    got = one(spark, f"key {h} TOKEN=abc /home/ann/x sha1={h}", tx.scrub)
    assert got == f"key <REDACTED> <REDACTED> <HOME>/x sha1={h}"


@pytest.mark.parametrize("text", ["2026-01-01T02:00:00Z", "2026-01-01T05:00:00+03:00", "2026-01-01 02:00:00", "2026-01-01T02:00:00", "20260101T020000", "01.01.2026 02:00:00"])
def test_time_spellings(spark, text):
    assert one(spark, text, tx.parse_time) == T0 + timedelta(hours=2)


def test_bad_time(spark):
    assert one(spark, "soon", tx.parse_time) is None and one(spark, None, tx.parse_time) is None


# --- series -----------------------------------------------------------------------------------------


def blocks(spark, values):
    return spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run string, block long, med double")


def noise(n, level=2.0, seed=1):
    rng = random.Random(seed)
    return [level + rng.gauss(0, 0.02) for _ in range(n)]


@pytest.mark.parametrize(("values", "want"), [
    (noise(80), []), (noise(40) + noise(40, 2.3, 2), ["up"]), (noise(40) + noise(40, 1.7, 2), ["down"]), ([x + i * 0.002 for i, x in enumerate(noise(80))], []), (noise(40) + [9.0] + noise(39, seed=4), []), (noise(12), []), ([], []),
])
def test_changepoints(spark, values, want):
    got = series.changepoints(blocks(spark, values), "run").collect()
    assert [r["direction"] for r in got] == want
    assert all(abs(r["start"] - 43) <= 4 for r in got)


def test_flapping_and_chain(spark):
    v = spark.createDataFrame([("c", i, s) for i, s in enumerate("pfpfpf")] + [("d", i, "p") for i in range(9)], "claim string, seq long, verdict string")
    got = {r["claim"]: (r["switches"], r["flapping"]) for r in series.flapping(v, "claim", "verdict", "seq").collect()}
    assert got == {"c": (5, True), "d": (0, False)}
    c = series.chained(v, "claim", "verdict", "seq")
    assert all(r["intact"] for r in series.chain_breaks(c, "claim", "verdict", "prev_sha256", "seq").collect())
    cut = c.where("claim = 'd' OR seq <> 2")
    assert {r["claim"]: r["intact"] for r in series.chain_breaks(cut, "claim", "verdict", "prev_sha256", "seq").collect()} == {"c": False, "d": True}
    bad = c.withColumn("verdict", F.when(F.col("seq") == 3, "x").otherwise(F.col("verdict")))
    assert not any(r["intact"] for r in series.chain_breaks(bad, "claim", "verdict", "prev_sha256", "seq").collect())


def test_slope_and_quantile(spark):
    df = spark.createDataFrame([("r", i, 5 - 0.1 * i) for i in range(30)] + [("s", 0, 1.0)], "run string, i long, v double")
    got = {r["run"]: r["slope"] for r in series.slope(df.withColumnRenamed("i", "k"), "run", "v", "k").collect()}
    assert math.isclose(got["r"], -0.1) and got["s"] is None
    h = spark.createDataFrame([("m", 0.1, 40.0), ("m", 0.25, 80.0), ("m", 1.0, 100.0)], "m string, le double, cum double")
    q = lambda p: series.histogram_quantile(h, ["m"], "le", "cum", p).first()["value"]
    assert math.isclose(q(0.5), 0.1375) and math.isclose(q(1.0), 1.0)


# --- intervals --------------------------------------------------------------------------------------


def spans(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "g string, s long, e long")


def test_intervals_equal_brute_force(spark):
    rng = random.Random(9)
    mk = lambda n: [(a, a + rng.randrange(-2, 30)) for a in (rng.randrange(300) for _ in range(n))]
    a, b = mk(25), mk(25)
    covered = lambda rows: {t for s, e in rows for t in range(s, e)}
    u = intervals.union(spans(spark, a), "g", "s", "e").collect()
    assert set().union(*[set(range(r["s"], r["e"])) for r in u]) == covered(a) and sum(r["e"] - r["s"] for r in u) == len(covered(a))
    got = sorted((r["s"], r["e"]) for r in intervals.intersection(spans(spark, [x for x in a if x[1] > x[0]]), spans(spark, [x for x in b if x[1] > x[0]]), "g", "s", "e", 16.0).collect())
    want = sorted((max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if x[1] > x[0] and y[1] > y[0] and min(x[1], y[1]) > max(x[0], y[0]))
    assert got == want


def test_unique_match(spark):
    s = spark.createDataFrame([("none", 0.0, 10.0), ("one", 10_000.0, None), ("two", 20_000.0, 20_500.0), ("null", None, 5.0), ("early", 30_000.0, 1.0)], "id string, s double, e double")
    p = spark.createDataFrame([(13_600.0, "a"), (20_100.0, "b"), (20_200.0, "b"), (33_600.0, "c"), (33_601.0, "d"), (None, "z")], "at double, status string")
    got = {r["id"]: (r["status"], r["ambiguous"]) for r in intervals.unique_match(s, p, "id", "s", "e", "at", "status", 3600.0).collect()}
    assert got == {"none": (None, False), "one": ("a", False), "two": (None, True), "null": (None, False), "early": ("c", False)}


# --- dedup, mixing ----------------------------------------------------------------------------------


def test_near_pairs(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    near = [*base[:70], "new", *base[71:]]
    other = [f"z{rng.randrange(500)}" for _ in range(150)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, near, other, base))] + [(9, None), (10, "")], "id long, text string")
    assert [(r["a"], r["b"]) for r in dedup.near_pairs(df, "id", "text").collect()] == [(0, 1)]
    assert dedup.near_rate(df, "id", "text").first()["n_near"] == 1
    assert dedup.near_pairs(df.limit(0), "id", "text").count() == 0


def test_phase_mix_reaches_half(spark):
    got = [r["stream"] for r in mix.phase(spark.range(200).withColumnRenamed("id", "t"), "t", 200).orderBy("t").collect()]
    assert got.count("Q") == 100 and got[:10].count("Q") <= 1 and got[-10:].count("Q") >= 9


def test_pack(spark):
    df = spark.createDataFrame([([5, 6],), (list(range(10, 30)),), ([],)], "ids array<int>")
    got = [(r["inputs"], r["labels"]) for r in mix.pack(df, "ids", 6).collect()]
    assert got[0] == ([1, 5, 6, 2, 0], [5, 6, 2, 0, 0]) and got[1] == ([1, 10, 11, 12, 13], [10, 11, 12, 13, 2]) and got[2] == ([1, 2, 0, 0, 0], [2, 0, 0, 0, 0])


def test_holdout_is_stable(spark):
    df = spark.range(40).withColumnRenamed("id", "k")
    a = [r["k"] for r in mix.holdout(df, "k", 0.5, 10, 3).collect()]
    assert a == [r["k"] for r in mix.holdout(df.repartition(7), "k", 0.5, 10, 3).collect()] and len(a) == 20
    assert mix.holdout(df.limit(5), "k", 0.5, 10, 3).count() == 5


# --- episodes ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "want"), [
    ('done\n```json\n{"status": "complete", "x": {"y": "}"}}\n```', "complete"), ('{"status": "partial"}', "partial"), ('{"a": 1} then {"status": "failed"} ', "failed"), ('{"status": "complete"} and more', None), ('{"status": 3}', None), ("", None), (None, None), ("{" * 500, None),
])
def test_trailing_status(text, want):
    assert episodes.trailing_status(text) == want


@pytest.mark.parametrize(("status", "suite", "report", "want"), [
    ("complete", "green", None, "verified-complete"), ("partial", "green", None, "verified-partial"), ("partial", None, "complete", "unverified"), ("complete", "green", "failed", "verified-failed"), ("complete", "red", None, "verified-failed"),
    (None, None, "complete", "verified-complete"), (None, "green", None, "unverified"), ("odd", "green", None, "unverified"), (None, None, None, "unverified"),
])
def test_outcome(spark, status, suite, report, want):
    df = spark.createDataFrame([(status, suite, report)], "a string, b string, c string")
    assert df.select(episodes.outcome(F.col("a"), F.col("b"), F.col("c")).alias("r")).first()["r"] == want


@pytest.mark.parametrize(("text", "want"), [
    ("<think>a</think>answer", []), ("<think>a", ["unclosed_think"]), ("<think>a<tool_call>{}</tool_call></think>x", ["tool_call_in_think"]), ("<think>a</think>  ", ["no_answer"]), (None, ["no_answer"]),
])
def test_structure_and_normalization(text, want):
    assert episodes.structure(text) == want
    if text:
        fixed, edits = episodes.normalized(text)
        assert episodes.restored(fixed, edits) == text and "unclosed_think" not in episodes.structure(fixed)


@pytest.mark.parametrize(("passed", "base", "final", "spent", "want"), [(True, ["a", "b"], [], 10.0, 1.5), (False, ["a"], ["a"], 10.0, 0.0), (False, ["a", "b"], ["a", "c"], 10.0, 0.1875), (True, [], [], 50.0, 0.5)])
def test_reward(spark, passed, base, final, spent, want):
    df = spark.createDataFrame([(passed, base, final, spent, 20.0)], "p boolean, b array<string>, f array<string>, s double, g double")
    assert math.isclose(df.select(episodes.reward(*[F.col(c) for c in "pbfsg"]).alias("r")).first()["r"], want)


# --- properties, vectors, byte pairs ----------------------------------------------------------------


def test_templates(spark):
    v = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    n, x = F.lit(None).cast("double"), F.lit(3.0)
    assert [v(properties.bounds(x, F.lit(3.0), F.lit(3.0))), v(properties.bounds(x, F.lit(4.0))), v(properties.bounds(n, x)), v(properties.bounds(x))] == ["pass", "fail", "unverified", "unverified"]
    assert [v(properties.identity(F.lit("ab"), F.lit(s))) for s in ("ab", "a", "xy")] == ["pass", "truncated", "fail"]
    assert [v(properties.conservation([x, x], [F.lit(6.0)])), v(properties.conservation([x, n], [x])), v(properties.safety(x, x > 2)), v(properties.metamorphic(x, F.lit(7.0), 2.0, 0.5))] == ["pass", "unverified", "fail", "fail"]
    assert v(properties.freshness(F.lit(T0), F.lit(T0 + timedelta(hours=5)), 4.0)) == "fail"
    s = spark.createDataFrame([("a", 1, 1.0, T0), ("a", 2, 0.5, T0 + timedelta(seconds=9)), ("b", 1, 1.0, T0)], "k string, i int, v double, ts timestamp")
    assert {r["k"]: r["verdict"] for r in properties.monotonic(s, "k", "v", 0.1, "i").collect()} == {"a": "fail", "b": "unverified"}
    assert {r["k"]: r["verdict"] for r in properties.liveness(s, "k", "v", "ts", 10, "i").collect()} == {"a": "pass", "b": "unverified"}
    assert not properties.gate(s.limit(0).select(F.lit("x").alias("v")), "v").first()["open"]


def test_top_k_and_softmax(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 5.0, float("-inf"), float("nan")]), (2, [2.0])], "id long, s array<double>")
    got = {(r["id"], r["pos"]): r["score"] for r in vectors.top_k(df, "id", "s", 3).collect()}
    assert got == {(1, 1): 5.0, (1, 2): 5.0, (1, 0): 1.0, (2, 0): 2.0}
    u = spark.createDataFrame([([0.0] * 100,)], "s array<double>").select((-vectors.log_softmax_at(F.col("s"), F.lit(7))).alias("r")).first()["r"]
    assert math.isclose(math.exp(u), 100, rel_tol=1e-9)
    q = vectors.quantization_error(spark.createDataFrame([(1, [0.0] * 4), (2, [1.0, 2.0, 3.0, 448.0])], "id long, s array<double>"), "id", "s", 4)
    assert {r["id"]: r["error"] for r in q.collect()} == {1: None, 2: 0.0}


def test_byte_pairs(spark):
    df = spark.createDataFrame([("aab aab ab",)], "text string")
    assert [tuple(r) for r in bpe.best_pair(bpe.pair_counts(df, "text")).collect()] == [("a", "b", 3)]
    ranks = {("a", "b"): 0, ("a", "ab"): 1}
    assert bpe.encode("aab", ranks) == ["aab"] and bpe.encode("", ranks) == [] and bpe.encode("xyz", ranks) == ["x", "y", "z"]
