import os

import pytest

from corvane.llm import mixing

needs = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files")


def counts(spark, sizes):
    return spark.createDataFrame([(k * 10000 + i, s, t) for k, (s, n, t) in enumerate(sizes) for i in range(n)], "doc_id long, source string, tokens long")


def plan(spark, rows):
    return spark.createDataFrame(rows, "plan string, source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    c = counts(spark, [("a", 2000, 50), ("b", 800, 40), ("c", 300, 100)])
    p = plan(spark, [("p", "A ", 50.0, 2), ("p", "b", 30.0, 4), ("p", "c", 20.0, 1), ("q", "a", 0.9, 1), ("q", "b", 0.1, 1)])
    rated = mixing.rates(c, p)
    sel = mixing.copies(c, rated)
    rep = {(r["plan"], r["source"]): r for r in mixing.report(sel, rated).collect()}
    for r in rep.values():
        assert abs(r["actual_share"] - r["target_share"]) < 0.02
    caps = {("p", "a"): 2, ("p", "b"): 4, ("p", "c"): 1, ("q", "a"): 1, ("q", "b"): 1}
    assert all(r["copies"] <= caps[r["plan"], r["source"]] for r in sel.collect())
    assert any(abs(r["rate"] - caps[k]) < 1e-9 for k, r in rep.items() if k[0] == "p")
    assert mixing.emitted(sel).count() == sel.groupBy().sum("copies").first()[0]
    assert {tuple(r) for r in sel.collect()} == {tuple(r) for r in mixing.copies(c.repartition(7), rated).collect()}


def test_missing_and_null(spark):
    c = counts(spark, [("a", 10, 5)])
    p = plan(spark, [("p", "a", 0.5, 1), ("p", "none", 0.5, 3), ("r", "a", None, None)])
    rep = {(r["plan"], r["source"]): r["tokens"] for r in mixing.report(mixing.copies(c, mixing.rates(c, p)), mixing.rates(c, p)).collect()}
    assert rep == {("p", "a"): 50, ("p", "none"): 0, ("r", "a"): 0}
    assert mixing.rates(c.limit(0), p).where("rate > 0").count() == 0 and mixing.rates(c, p.limit(0)).count() == 0


@needs
def test_tokens(spark):
    docs = spark.createDataFrame([(1, "hello world", " Web"), (1, "hello world", " Web"), (2, None, "web"), (3, "", "web"), (4, "x", None), (5, "й" * 5000, "web")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixing.token_counts(docs.selectExpr("*", "9 AS tokens")).collect()}
    assert set(got) == {1, 3, 5} and got[1] == ("web", 2) and got[3][1] == 0 and got[5][1] > 1000
