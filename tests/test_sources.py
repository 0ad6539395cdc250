import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.sources import facts, files, prometheus, shards
from corvane.streaming import streams


def test_tolerant_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "x", "n": 1}\n\n{oops\n[1]\n3\n' + json.dumps({"t": "y" * 50}) + "\n")
    scan = files.tolerant_jsonl(spark, str(tmp_path), longest=40)
    assert files.scan_report(scan).first().asDict() == {"records": 1, "blank": 1, "errors": 1, "not_objects": 2, "oversized": 1}
    assert files.records(scan, "type string, n int").first()["n"] == 1


def test_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "a"}\n{"other": 1}\n')
    with pytest.raises(PySparkException):
        files.strict_texts(spark, str(tmp_path), "text").collect()
    (tmp_path / "a.jsonl").write_text('{"text": "a"}\n{bad\n')
    assert files.lenient_json(spark, str(tmp_path), "text string").count() == 1


def test_directory_paragraphs_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("one\n\n\ntwo\nlines\n\n  \n")
    (tmp_path / "sub" / "b.txt").write_text("x\nstatus: failed\nstatus: complete\n")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "d.md").write_text(" \n")
    assert files.directory(spark, str(tmp_path)).count() == 2
    assert [r["text"] for r in files.paragraphs(spark, str(tmp_path / "a.md")).orderBy("pos").collect()] == ["one", "two\nlines"]
    assert files.log_status(spark, str(tmp_path / "sub")).first()["status"] == "failed"
    total, top = files.tree(spark, str(tmp_path / "sub"))
    assert total.first()["bytes"] == top.first()["length"]


def test_reports(spark, tmp_path):
    (tmp_path / "run-20260102-030405.json").write_text('{"status": "complete"}')
    r = files.reports(spark, str(tmp_path)).first()
    assert r["status"] == "complete" and r["ts"].isoformat() == "2026-01-02T03:04:05"


def test_git_log_and_csv(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eabc\x1f2026\x1ffix\nnet/a.py\ndocs/b.md\n\x1edef\x1f2025\x1fadd\n")
    got = {r["commit"]: r["files"] for r in files.git_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"abc": ["net/a.py", "docs/b.md"], "def": []}
    (tmp_path / "p.csv").write_text("1, 2.5\nbad, 3\n4\n5,6\n")
    assert files.sampler_csv(spark, str(tmp_path / "p.csv"), ["a", "b"]).count() == 2


def test_schema_grid_synthetic_output(spark):
    assert files.schema_types(spark.sql("SELECT 1 a, 1.5D b, true c, 'x' d, array(1) e")) == {"a": "int", "b": "float", "c": "bool", "d": "str", "e": "list"}
    assert files.grid({"level": [1, 2], "src": ["a"]}, 3, spark).count() == 6
    a, b = (files.synthetic(spark, 5, 10, 8, ["x", "y"]).collect() for _ in range(2))
    assert a == b
    assert files.allowed_output("/out/a", ("/out",)) == "/out/a"
    with pytest.raises(ValueError):
        files.allowed_output("/out/../etc", ("/out",))


def test_shards(spark, tmp_path):
    m = shards.write(spark.range(100).select("id"), str(tmp_path / "s"), 10)
    assert m.agg(F.sum("records")).first()[0] == 100
    assert shards.verify(spark, str(tmp_path / "s"), m).where("NOT ok").count() == 0
    assert shards.spot_check(spark, str(tmp_path / "s"), m, 3, 1).first().asDict() == {"checked": 3, "all_match": True}
    bad = m.withColumn("sha256", F.lit("0"))
    assert shards.verify(spark, str(tmp_path / "s"), bad).where("ok").count() == 0
    t = spark.createDataFrame([("W", 100, None), ("C", None, 7), ("Q", 3, 9)], "stream string, stream_tokens long, tokens long")
    assert shards.totals(t, ["W", "C", "Q"]).first()["total"] == 110 and shards.totals(t, ["W", "X"]).first()["total"] is None


def test_bins(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x01\x00\x00\x00\xff\xff\xff\xff")
    assert [r["token"] for r in shards.read_bins(spark, str(tmp_path)).orderBy("pos").collect()] == [1, 2**32 - 1]


def test_facts(spark, tmp_path):
    f = spark.createDataFrame([("s", "tok", 1.0, 1), ("s", "tok", 3.0, 2), ("s", "peak", 2.0, 3)], "sensor string, fact string, value double, seq long")
    facts.append(f, str(tmp_path / "f"))
    g = facts.read(spark, str(tmp_path / "f"))
    assert {r["fact"]: r["value"] for r in facts.latest(g).collect()} == {"tok": 3.0, "peak": 2.0}
    assert facts.derived(g, ["tok", "peak"], "tok / peak").first()["value"] == 1.5
    assert facts.derived(g, ["tok", "none"], "tok + none").first()["status"] == "unverified"
    with pytest.raises(ValueError):
        facts.append(f.drop("seq"), str(tmp_path / "g"))


def test_prometheus(spark):
    lines = ["# HELP x", "", 'a_total{p="x\\"y",q="2"} 3 17', "b 1e3", "c NaNx", "d{} +Inf"]
    got = {r["name"]: (r["labels"], r["value"]) for r in prometheus.parse(spark.createDataFrame([(x,) for x in lines], "l string"), "l").collect()}
    assert got == {"a_total": ({"p": 'x"y', "q": "2"}, 3.0), "b": ({}, 1000.0), "d": ({}, float("inf"))}
    again = prometheus.parse(prometheus.render(prometheus.parse(spark.createDataFrame([(lines[2],)], "l string"), "l")), "line").first()
    assert again["labels"] == {"p": 'x"y', "q": "2"}


def test_streams(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 20).alias("k"), F.timestamp_seconds(F.lit(1767225600) + F.col("id") % 20).alias("ts"), F.when(F.col("id") == 7, float("nan")).otherwise(F.col("id").cast("double")).alias("v"), "id")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "k long, ts timestamp, v double, id long"
    src = lambda: streams.source(spark, str(tmp_path / "in"), schema, 1)
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run finds nothing new
        q = streams.resumable(streams.deduplicated(src(), ["k"], "ts"), out, str(tmp_path / "cp"))
        assert streams.run_within(q, 2.0) == "source exhausted"
    assert spark.read.parquet(out).count() == 20
    good, bad = streams.guarded(src(), "v")
    q = bad.writeStream.format("memory").queryName("bad").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bad").count() == 1
    q = streams.newest(src().where("NOT isnan(v)"), "k", "id", "v").writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["key"]: r["v"] for r in spark.table("newest").groupBy("key").agg(F.max("version").alias("v")).collect()}
    assert last == {str(k): 40 + k for k in range(20)}
    q = streams.spend(src(), "id", None).writeStream.format("memory").queryName("spend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("spend").first()["status"] == "unverified"


def test_directory_gives_a_row_a_record(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n{"text": "two", "k": 1}\n\n{"other": 3}\n')
    (tmp_path / "b.md").write_text("whole\n\nfile\n")
    (tmp_path / "c.bin").write_text("no")
    got = sorted(r["text"] for r in files.directory(spark, f"file://{tmp_path}").collect())
    assert got == ["one", "two", "whole\n\nfile\n", '{"other": 3}']
