"""Queries of series, histories, intervals, properties and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.tables import table
from corvane.operators import intervals, properties, series, vectors


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics").dropDuplicates(["row_id"])
    return m.where(F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < 1e9))


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """Every row once, whatever it holds."""
    return table(spark, d, "metrics").dropDuplicates(["row_id"])


_A = "(SELECT DISTINCT ON (row_id) * FROM metrics)"
_M = "(SELECT * FROM (SELECT DISTINCT ON (row_id) * FROM metrics) WHERE loss IS NOT NULL AND NOT isnan(loss) AND abs(loss) < 1e9)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def window_medians(spark: SparkSession, d: str) -> DataFrame:
    t = series.tail(_metrics(spark, d), "run_id", 20, "segment", "logged_at", "row_id")
    return t.groupBy("run_id").agg(F.round(F.median("loss"), 6).alias("loss"), F.round(F.median("step_seconds"), 6).alias("step_seconds"), F.count(F.lit(1)).alias("n"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_type").agg(*[F.round(F.percentile("value", q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)])


def loss_slope(spark: SparkSession, d: str) -> DataFrame:
    s = series.slope(_metrics(spark, d), "run_id", "loss", "segment", "logged_at", "row_id")
    return s.select("run_id", F.round("slope", 6).alias("slope"), "n")


def variation_tolerance(spark: SparkSession, d: str) -> DataFrame:
    t = series.tail(_metrics(spark, d), "run_id", 50, "segment", "logged_at", "row_id")
    return t.groupBy("run_id").agg(F.round(series.variation("loss"), 6).alias("cv"), F.round(series.variation("loss") * 2, 6).alias("tolerance"))


def robust_scales(spark: SparkSession, d: str) -> DataFrame:
    return series.robust_scale(_events(spark, d), "event_type", "value").select("event_type", F.round("scale", 6).alias("scale"))


def block_medians(spark: SparkSession, d: str) -> DataFrame:
    b = series.block_medians(_metrics(spark, d), "run_id", "loss", "segment", "logged_at", "row_id")
    return b.select("run_id", "block", F.round("med", 6).alias("med"))


def changepoints(spark: SparkSession, d: str) -> DataFrame:
    """Lasting changes of loss at the standard parameters, over all rows with a possible reading."""
    m = _logged(spark, d).where("loss > 0 AND loss < double('infinity')")
    b = series.block_medians(m, "run_id", "loss", "segment", "logged_at", "row_id")
    return series.changepoints(b, "run_id").select("run_id", "start", "stop", "direction", F.round("delta", 4).alias("delta"))


def unexplained_jumps(spark: SparkSession, d: str) -> DataFrame:
    m = _logged(spark, d).where("step IS NOT NULL")
    events = m.select("row_id", "step")
    ledger = m.where("step % 3000 = 0 AND step BETWEEN 0 AND 1000000").select(F.col("step").alias("at")).distinct()
    return series.unexplained(events, ledger, "step", "at", 400).select("row_id")


def flapping(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("state", F.when(F.col("value") > 50, "fail").otherwise("pass"))
    return series.flapping(e, "event_type", "state", "ts", "event_id")


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return series.last_wins(_events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


def duplicate_steps(spark: SparkSession, d: str) -> DataFrame:
    return series.last_wins(_logged(spark, d).select("run_id", "step", "segment", "logged_at", "row_id"), ["run_id", "step"], "segment", "logged_at", "row_id").select("run_id", "step", "row_id")


def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    e = _events(spark, d).select("event_type", "event_id", raw.alias("raw"))
    c = series.chained(e, "event_type", "raw", "event_id").withColumn("prev_sha256", F.when(F.col("event_id") % 1000 == 7, F.lit("0" * 64)).otherwise(F.col("prev_sha256")))
    return series.chain_breaks(c, "event_type", "raw", "prev_sha256", "event_id")


def entropy_collapse(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return series.consecutive(e, "event_type", F.col("value") > 80, 2, "ts", "event_id").select("event_type", F.col("start").cast("long").alias("start"), "length")


def dual_windows(spark: SparkSession, d: str) -> DataFrame:
    n = series.numbered(_metrics(spark, d), "run_id", "segment", "logged_at", "row_id")
    first = n.where("i < 50").withColumn("win", F.lit("first_50"))
    now = series.tail(_metrics(spark, d), "run_id", 50, "segment", "logged_at", "row_id").withColumn("win", F.lit("current"))
    return first.select("run_id", "win", "loss").unionByName(now.select("run_id", "win", "loss")).groupBy("run_id", "win").agg(F.round(F.median("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


def rising_points(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 rows whose median is above the one before, three times in sequence."""
    b = series.block_medians(_metrics(spark, d), "run_id", "loss", "segment", "logged_at", "row_id", size=20)
    w = Window.partitionBy("run_id").orderBy("block")
    up = b.withColumn("a", F.lag("med", 1).over(w)).withColumn("b", F.lag("med", 2).over(w)).withColumn("c", F.lag("med", 3).over(w))
    return up.where("med > a AND a > b AND b > c").select("run_id", "block")


def relative_drift(spark: SparkSession, d: str) -> DataFrame:
    t = series.tail(_metrics(spark, d), "run_id", 1000, "segment", "logged_at", "row_id")
    last = F.max_by("loss", F.struct("segment", "logged_at", "row_id"))
    return t.groupBy("run_id").agg(F.round(last / F.median("loss") - 1, 6).alias("drift"), (last / F.median("loss") - 1 > 0.03).alias("alarm"))


def histogram_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    le = F.ceil(F.col("value") / 20) * 20.0
    h = e.groupBy("event_type", le.alias("le")).agg(F.count(F.lit(1)).alias("n")).withColumn("cum", F.sum("n").over(Window.partitionBy("event_type").orderBy("le")).cast("double"))
    return series.histogram_quantile(h, ["event_type"], "le", "cum", 0.9).select("event_type", F.round("value", 6).alias("p90"))


def error_share(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("200"), F.lit("404"), F.lit("503"), F.lit("201")), (F.col("event_id") % 4 + 1).cast("int"))
    return _events(spark, d).groupBy("event_type").agg(F.round(F.sum(F.when(code.rlike(r"^[45]\d\d$"), F.col("value")).otherwise(0.0)) / F.sum("value"), 6).alias("share"))


def weekly_shares(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").where("ingested_at IS NOT NULL").groupBy(tx.iso_week(F.col("ingested_at")).alias("week"), tx.path_class(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    total = w.groupBy("week").agg(F.sum("n").alias("total"))
    wide = w.join(total, "week").withColumn("share", F.round(F.col("n") / F.col("total"), 6))
    return wide.groupBy("week").pivot("kind", ["docs", "behaviour", "work"]).agg(F.first("share")).fillna(0.0)


def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").groupBy("path").agg(F.countDistinct("repo").alias("repos")).where(F.col("path").isNotNull() & (F.col("repos") > 1))
    return t.agg(F.count(F.lit(1)).alias("collisions"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    cols = ["lang", "source", "repo", "path", "int_score"]
    return docs.groupBy(F.coalesce("int_score", F.lit(0)).alias("score")).agg(*[F.round(F.try_divide(F.count(c), F.count(F.lit(1))), 6).alias(f"{c}_share") for c in cols[:4]])


def range_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    span = F.max("loss") - F.min("loss")
    return m.groupBy("run_id").agg(F.count("loss").alias("n"), F.round(F.min("loss") - span * 0.1, 6).alias("lo"), F.round(F.max("loss") + span * 0.1, 6).alias("hi")).where("n >= 20")


def running_spend(spark: SparkSession, d: str) -> DataFrame:
    """The last reading of the running counter times the rate."""
    m = _logged(spark, d).where("step IS NOT NULL")
    last = F.max_by("step", F.struct("segment", "logged_at", "row_id"))
    return m.groupBy("run_id").agg((last * 1.5).alias("spend"))


def session_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Covered time of overlapping event spans per type, in microseconds."""
    s = F.unix_micros("ts")
    e = _events(spark, d).select("event_type", s.alias("s"), (s + (F.col("value") * 60e6).cast("long")).alias("e"))
    return intervals.union(e, "event_type", "s", "e").groupBy("event_type").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col("e") - F.col("s")).alias("covered"))


def interval_common(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds("ts")
    e = _events(spark, d).select("user_id", "event_id", s.alias("s"), (s + 1800).alias("e"))
    a, b = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    both = intervals.intersection(a, b, "user_id", "s", "e", 3600.0)
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("seconds"))


def stabbed(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds("ts")
    e = _events(spark, d).select("user_id", "event_id", "event_type", s.alias("at"))
    spans = e.where("event_id % 5 = 0").select("user_id", F.col("at").alias("s"), (F.col("at") + 600 + F.col("event_id") % 7 * 100).alias("e"), F.concat(F.lit("span-"), F.col("event_id").cast("string")).alias("label"))
    points = e.where("event_id % 5 <> 0").select("user_id", "event_id", "at")
    return intervals.stab(points, spans, "user_id", "at", "s", "e", "label", 1200.0).select("event_id", "label")


def unique_reports(spark: SparkSession, d: str) -> DataFrame:
    ep = table(spark, d, "episodes").dropDuplicates(["id"]).select("id", F.unix_seconds(tx.parse_time(F.col("started_at"))).cast("double").alias("s"))
    ev = _events(spark, d).select(F.unix_seconds("ts").cast("double").alias("at"), F.col("event_type").alias("status"))
    return intervals.unique_match(ep.withColumn("e", F.lit(None).cast("double")), ev, "id", "s", "e", "at", "status", 3600.0)


def bounds_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = _metrics(spark, d).groupBy("run_id").agg(F.median("loss").alias("v"))
    return v.select("run_id", properties.bounds(F.col("v"), F.lit(1.5), F.lit(4.0)).alias("verdict"))


def property_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return properties.table_of_verdicts(_events(spark, d))


def gate(spark: SparkSession, d: str) -> DataFrame:
    v = bounds_verdicts(spark, d)
    return properties.gate(v, "verdict")


def card_status(spark: SparkSession, d: str) -> DataFrame:
    v = bounds_verdicts(spark, d)
    return properties.card(v, "run_id", "verdict")


def topk_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("vec_id", "pos", F.round("score", 5).alias("score"))


def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vectors.l2(F.col("embedding")), 5).alias("l2"), F.round(vectors.rms(F.col("embedding")), 5).alias("rms"))


def global_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.sqrt(F.sum(vectors.square_sum(F.col("embedding")))), 4).alias("norm"))


def log_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vectors.log_softmax_at(F.col("embedding"), (F.col("vec_id") % 64 + 1).cast("int")), 5).alias("logp"))


def perplexity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nll = -vectors.log_softmax_at(F.col("embedding"), (F.col("vec_id") % 64 + 1).cast("int"))
    return e.groupBy("label").agg(F.round(F.exp(F.sum(nll) / F.count(F.lit(1))), 4).alias("ppl"), F.round(F.sum(nll) / F.sum(F.lit(4.0)) / F.ln(F.lit(2.0)), 4).alias("bits_per_byte"))


def quantization_error(spark: SparkSession, d: str) -> DataFrame:
    return vectors.quantization_error(table(spark, d, "embeddings"), "vec_id", "embedding", 32).select("vec_id", F.round("error", 5).alias("error"))


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    weight = F.length("event_type").cast("double")
    e = _events(spark, d).withColumn("w", weight)
    base = F.try_divide(F.sum(F.col("w") * F.col("value")).over(w) - F.col("w") * F.col("value"), F.sum("w").over(w) - F.col("w"))
    return e.select("event_id", F.round(base, 6).alias("baseline"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    rate = F.avg((F.col("value") > 50).cast("double"))
    return e.groupBy("user_id").agg(F.round(rate, 6).alias("pass_rate"), F.round(F.stddev_pop("value"), 6).alias("spread"), rate.between(0.10, 0.90).alias("in_corridor"))


def significance(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 50).cast("double")).alias("p"))
    base = e.where("event_type = 'click'").select(F.col("p").alias("p0"))
    se = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    j = e.crossJoin(F.broadcast(base))
    return j.select("event_type", F.when(F.col("n") < 100, "too_few").when(F.abs(F.col("p") - F.col("p0")) < se, "indistinguishable").otherwise("different").alias("verdict"))


def mfu(spark: SparkSession, d: str) -> DataFrame:
    m = _logged(spark, d).where("tokens_per_sec > 0 AND tokens_per_sec < double('infinity')")
    return m.groupBy("run_id").agg(F.round(F.median("tokens_per_sec") * 6 * 1.2e9 / 1e15, 6).alias("mfu"), F.round(1e9 / F.median("tokens_per_sec") / 3600, 4).alias("eta_hours"))


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Top components by share of the total: a star join with broadcast-sized dimensions left to the planner."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    cust, nation = table(spark, d, "customer"), table(spark, d, "nation")
    rev = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    by = rev.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    # one row a nation is left: the window holds no more than the dimension
    total = F.sum("r").over(Window.partitionBy(F.lit(0)))
    return by.select("n_name", F.round("r", 2).alias("revenue"), F.round(100 * F.col("r") / total, 4).alias("percent"))


QUERIES = {f.__name__: f for f in (
    window_medians, percentiles, loss_slope, variation_tolerance, robust_scales, block_medians, changepoints, unexplained_jumps, flapping, latest_event, duplicate_steps,
    hash_chain, entropy_collapse, dual_windows, rising_points, relative_drift, histogram_quantiles, error_share, weekly_shares, id_collisions, coverage, range_candidates,
    running_spend, session_overlap, interval_common, stabbed, unique_reports, bounds_verdicts, property_verdicts, gate, card_status, topk_embeddings, embedding_norms,
    global_norm, log_softmax, perplexity, quantization_error, leave_one_out, calibration, significance, mfu, revenue_by_nation,
)}

_ORD = "segment, logged_at, row_id"
_NUM = f"(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_ORD}) - 1 AS i, row_number() OVER (PARTITION BY run_id ORDER BY segment DESC, logged_at DESC, row_id DESC) AS back FROM {_M})"
_DOT = "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))"
_LSE = "(list_max(embedding)::DOUBLE + ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)))))"
_LOGP = f"(embedding[(vec_id % 64 + 1)]::DOUBLE - {_LSE})"
_BV = f"(SELECT run_id, CASE WHEN v IS NULL THEN 'unverified' WHEN v BETWEEN 1.5 AND 4.0 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT run_id, median(loss) AS v FROM {_M} GROUP BY 1))"
_KIND = "CASE WHEN path IS NULL THEN 'work' WHEN regexp_matches(path, '^(docs|changes|evidence)/|\\.md$') THEN 'docs' WHEN regexp_matches(path, '^(net|env|tools)/.*\\.py$') THEN 'behaviour' ELSE 'work' END"

SQL = {
    "window_medians": f"SELECT run_id, round(median(loss), 6) AS loss, round(median(step_seconds), 6) AS step_seconds, count(*) AS n FROM {_NUM} WHERE back <= 20 GROUP BY 1",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "loss_slope": f"SELECT run_id, round(CASE WHEN count(loss) >= 2 THEN regr_slope(loss, i) END, 6) AS slope, count(loss) AS n FROM {_NUM} GROUP BY 1",
    "variation_tolerance": f"SELECT run_id, round(CASE WHEN count(loss) >= 2 AND avg(loss) <> 0 THEN stddev_pop(loss) / abs(avg(loss)) END, 6) AS cv, round(CASE WHEN count(loss) >= 2 AND avg(loss) <> 0 THEN 2 * stddev_pop(loss) / abs(avg(loss)) END, 6) AS tolerance FROM {_NUM} WHERE back <= 50 GROUP BY 1",
    "robust_scales": "SELECT event_type, round(1.4826 * mad(value), 6) AS scale FROM events GROUP BY 1",
    "block_medians": f"SELECT run_id, i // 25 AS block, round(median(loss), 6) AS med FROM {_NUM} GROUP BY 1, 2 HAVING count(*) = 25",
    "changepoints": f"WITH n AS (SELECT run_id, loss AS v, row_number() OVER (PARTITION BY run_id ORDER BY {_ORD}) - 1 AS i FROM {_A} WHERE loss > 0 AND NOT isnan(loss) AND NOT isinf(loss)), "
    "b AS (SELECT run_id, i // 25 AS block, median(v) AS med FROM n GROUP BY 1, 2 HAVING count(*) = 25), d AS (SELECT *, med - lag(med) OVER (PARTITION BY run_id ORDER BY block) AS d FROM b), s AS (SELECT run_id, 1.4826 * mad(d) / sqrt(2) AS s FROM d GROUP BY 1), "
    "x AS (SELECT run_id, block, list(med) OVER (PARTITION BY run_id ORDER BY block ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS nw, list(med) OVER (PARTITION BY run_id ORDER BY block ROWS BETWEEN 19 PRECEDING AND 8 PRECEDING) AS rf FROM b), "
    "y AS (SELECT run_id, block, list_median(nw) - list_median(rf) AS delta FROM x WHERE len(nw) = 6 AND len(rf) = 12), "
    "f AS (SELECT run_id, block, delta, sign(delta) AS sg FROM y JOIN s USING (run_id) WHERE abs(delta) >= 0.10 AND s > 0 AND abs(delta / (s * sqrt(1 / 6.0 + 1 / 12.0))) >= 3.5), "
    "g AS (SELECT *, CASE WHEN block - lag(block) OVER w <= 1 AND sg = lag(sg) OVER w THEN 0 ELSE 1 END AS brk FROM f WINDOW w AS (PARTITION BY run_id ORDER BY block)), k AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY block) AS k FROM g), "
    "r AS (SELECT run_id, min(block) AS start, max(block) AS stop, any_value(sg) AS sg, arg_max(delta, abs(delta)) AS delta FROM k GROUP BY run_id, k HAVING count(*) >= 3), "
    "e AS (SELECT *, CASE WHEN start - lag(stop) OVER w < 3 AND sg = lag(sg) OVER w THEN 0 ELSE 1 END AS brk FROM r WINDOW w AS (PARTITION BY run_id ORDER BY start)), m AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY start) AS k FROM e) "
    "SELECT run_id, min(start) AS start, max(stop) AS stop, CASE WHEN any_value(sg) > 0 THEN 'up' ELSE 'down' END AS direction, round(arg_max(delta, abs(delta)), 4) AS delta FROM m GROUP BY run_id, k",
    "unexplained_jumps": f"WITH m AS (SELECT * FROM {_A} WHERE step IS NOT NULL), l AS (SELECT DISTINCT step AS pt FROM m WHERE step % 3000 = 0 AND step BETWEEN 0 AND 1000000) SELECT row_id FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE pt BETWEEN step - 400 AND step + 400)",
    "flapping": "WITH e AS (SELECT event_type, ts, event_id, CASE WHEN value > 50 THEN 'fail' ELSE 'pass' END AS state, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events), x AS (SELECT event_type, CASE WHEN state <> lag(state) OVER (PARTITION BY event_type ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM e WHERE back <= 10) SELECT event_type, CAST(sum(c) AS BIGINT) AS switches, sum(c) >= 3 AS flapping FROM x GROUP BY 1",
    "latest_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "duplicate_steps": f"SELECT run_id, step, row_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY segment DESC, logged_at DESC, row_id DESC) AS rn FROM {_A}) WHERE rn = 1",
    "hash_chain": "WITH r AS (SELECT event_type, event_id, event_id || '|' || event_type || '|' || props AS raw FROM events), c AS (SELECT *, sha256(lag(raw) OVER w || chr(10)) AS want FROM r WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), p AS (SELECT *, CASE WHEN event_id % 1000 = 7 THEN repeat('0', 64) ELSE want END AS prev FROM c) SELECT event_type, bool_and(want IS NOT DISTINCT FROM prev) AS intact, count(*) FILTER (want IS DISTINCT FROM prev) AS broken FROM p GROUP BY 1",
    "entropy_collapse": "WITH x AS (SELECT event_type, value > 80 AS h, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events), g AS (SELECT event_type, i, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS g FROM x WHERE h) SELECT event_type, min(i) AS start, count(*) AS length FROM g GROUP BY event_type, g HAVING count(*) >= 2",
    "dual_windows": f"SELECT run_id, win, round(median(loss), 6) AS loss, count(*) AS n FROM (SELECT run_id, 'first_50' AS win, loss FROM {_NUM} WHERE i < 50 UNION ALL SELECT run_id, 'current', loss FROM {_NUM} WHERE back <= 50) GROUP BY 1, 2",
    "rising_points": f"WITH b AS (SELECT run_id, i // 20 AS block, median(loss) AS med FROM {_NUM} GROUP BY 1, 2 HAVING count(*) = 20), l AS (SELECT *, lag(med, 1) OVER w AS a, lag(med, 2) OVER w AS b, lag(med, 3) OVER w AS c FROM b WINDOW w AS (PARTITION BY run_id ORDER BY block)) SELECT run_id, block FROM l WHERE med > a AND a > b AND b > c",
    "relative_drift": f"SELECT run_id, round(max(loss) FILTER (back = 1) / median(loss) - 1, 6) AS drift, max(loss) FILTER (back = 1) / median(loss) - 1 > 0.03 AS alarm FROM {_NUM} WHERE back <= 1000 GROUP BY 1",
    "histogram_quantiles": "WITH h AS (SELECT event_type, ceil(value / 20) * 20.0 AS le, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS cum, sum(n) OVER (PARTITION BY event_type) * 0.9 AS t FROM h), l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cum) OVER w, 0) AS cl FROM c WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(arg_min(lo + (le - lo) * (t - cl) / (cum - cl), le), 6) AS p90 FROM l WHERE cum >= t GROUP BY 1",
    "error_share": "SELECT event_type, round(sum(CASE WHEN event_id % 4 IN (1, 2) THEN value ELSE 0 END) / sum(value), 6) AS share FROM events GROUP BY 1",
    "weekly_shares": f"WITH w AS (SELECT strftime(ingested_at AT TIME ZONE 'UTC', '%G-W%V') AS week, {_KIND} AS kind FROM documents WHERE ingested_at IS NOT NULL) SELECT week, round(count(*) FILTER (kind = 'docs') / count(*)::DOUBLE, 6) AS docs, round(count(*) FILTER (kind = 'behaviour') / count(*)::DOUBLE, 6) AS behaviour, round(count(*) FILTER (kind = 'work') / count(*)::DOUBLE, 6) AS work FROM w GROUP BY 1",
    "id_collisions": "SELECT count(*) AS collisions FROM (SELECT path FROM documents WHERE path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo) > 1)",
    "coverage": "SELECT coalesce(int_score, 0) AS score, round(count(lang) / count(*)::DOUBLE, 6) AS lang_share, round(count(source) / count(*)::DOUBLE, 6) AS source_share, round(count(repo) / count(*)::DOUBLE, 6) AS repo_share, round(count(path) / count(*)::DOUBLE, 6) AS path_share FROM documents GROUP BY 1",
    "range_candidates": f"SELECT run_id, count(loss) AS n, round(min(loss) - (max(loss) - min(loss)) * 0.1, 6) AS lo, round(max(loss) + (max(loss) - min(loss)) * 0.1, 6) AS hi FROM {_M} GROUP BY 1 HAVING count(loss) >= 20",
    "running_spend": f"SELECT run_id, CAST(any_value(step) * 1.5 AS DOUBLE) AS spend FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY segment DESC, logged_at DESC, row_id DESC) AS back FROM {_A} WHERE step IS NOT NULL) WHERE back = 1 GROUP BY 1",
    "session_overlap": "WITH e AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(trunc(value * 60e6) AS BIGINT) AS e FROM events), x AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e WHERE e > s), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM x), u AS (SELECT event_type, k, max(e) - min(s) AS len FROM i GROUP BY 1, 2) SELECT event_type, count(*) AS islands, CAST(sum(len) AS BIGINT) AS covered FROM u GROUP BY 1",
    "interval_common": "WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 1800 AS e FROM events) SELECT a.user_id, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS seconds FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND least(a.e, b.e) > greatest(a.s, b.s) GROUP BY 1",
    "stabbed": "WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS pt FROM events), s AS (SELECT user_id, pt AS s, pt + 600 + event_id % 7 * 100 AS e, 'span-' || event_id AS label FROM e WHERE event_id % 5 = 0), j AS (SELECT p.event_id, label, row_number() OVER (PARTITION BY p.event_id ORDER BY e - s, label) AS rn FROM e p LEFT JOIN s ON p.user_id = s.user_id AND p.pt BETWEEN s.s AND s.e WHERE p.event_id % 5 <> 0) SELECT event_id, coalesce(label, 'none') AS label FROM j WHERE rn = 1",
    "unique_reports": "WITH p AS (SELECT DISTINCT ON (id) id, floor(epoch(TRY_CAST(started_at AS TIMESTAMPTZ))) AS s FROM episodes), v AS (SELECT floor(epoch(ts)) AS pt, event_type FROM events), j AS (SELECT id, count(pt) AS n, min(event_type) AS st FROM p LEFT JOIN v ON pt BETWEEN s - 3600 AND s + 3600 GROUP BY 1) SELECT id, CASE WHEN n = 1 THEN st END AS status, n > 1 AS ambiguous FROM j",
    "bounds_verdicts": f"SELECT * FROM {_BV}",
    "property_verdicts": "WITH e AS (SELECT event_id, event_type, ts, value AS v, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), t AS ("
    + " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS template, CASE WHEN ({known}) IS NOT TRUE OR ({ok}) IS NULL THEN 'unverified' WHEN {ok} THEN 'pass' ELSE 'fail' END AS verdict FROM e"
        for n, known, ok in (
            ("declared_equals_actual", "k IS NOT NULL AND v IS NOT NULL", "abs(k - round(v)) <= 5"), ("bounds", "v IS NOT NULL", "v >= 5 AND v <= 95"), ("conservation", "v + k IS NOT NULL", "abs(v + k - 100) <= 40"),
            ("reversibility", "v IS NOT NULL", "v = round(v, 1)"), ("differential", "v IS NOT NULL AND k IS NOT NULL", "v = k OR abs(v - k) <= 50"), ("metamorphic", "v IS NOT NULL AND k IS NOT NULL", "abs(k - v * 2) <= 20"), ("safety", "v IS NOT NULL", "NOT v > 90"), ("freshness", "ts IS NOT NULL", "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9 <= 360"),
        )
    )
    + " UNION ALL SELECT event_id, 'identity', CASE WHEN event_type IS NULL THEN 'unverified' WHEN event_type = s THEN 'pass' WHEN length(event_type) <> length(s) AND (starts_with(event_type, s) OR starts_with(s, event_type)) THEN 'truncated' ELSE 'fail' END "
    "FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN event_type[1:3] WHEN 1 THEN 'click' ELSE event_type END AS s FROM e)) SELECT * FROM t",
    "gate": f"SELECT bool_and(verdict = 'pass') AS open, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (verdict = 'unverified') AS unverified FROM {_BV}",
    "card_status": f"SELECT CASE WHEN bool_and(verdict = 'pass') THEN 'v1' ELSE 'v1-draft' END AS status, list_sort(coalesce(list(run_id) FILTER (verdict <> 'pass'), [])) AS reasons FROM {_BV}",
    "topk_embeddings": "SELECT vec_id, pos, score FROM (SELECT vec_id, pos, round(x::DOUBLE, 5) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS rn FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)) WHERE rn <= 5",
    "embedding_norms": f"SELECT vec_id, round(sqrt({_DOT}), 5) AS l2, round(sqrt({_DOT} / len(embedding)), 5) AS rms FROM embeddings",
    "global_norm": f"SELECT label, round(sqrt(sum({_DOT})), 4) AS norm FROM embeddings GROUP BY 1",
    "log_softmax": f"SELECT vec_id, round({_LOGP}, 5) AS logp FROM embeddings",
    "perplexity": f"SELECT label, round(exp(sum(-{_LOGP}) / count(*)), 4) AS ppl, round(sum(-{_LOGP}) / (4.0 * count(*)) / ln(2.0), 4) AS bits_per_byte FROM embeddings GROUP BY 1",
    "leave_one_out": "SELECT event_id, round((sum(w * value) OVER (PARTITION BY user_id) - w * value) / nullif(sum(w) OVER (PARTITION BY user_id) - w, 0), 6) AS baseline FROM (SELECT *, length(event_type)::DOUBLE AS w FROM events)",
    "calibration": "SELECT user_id, round(avg((value > 50)::INT), 6) AS pass_rate, round(stddev_pop(value), 6) AS spread, avg((value > 50)::INT) BETWEEN 0.10 AND 0.90 AS in_corridor FROM events GROUP BY 1",
    "significance": "WITH e AS (SELECT event_type, count(*) AS n, avg((value > 50)::INT) AS p FROM events GROUP BY 1), b AS (SELECT p AS p0 FROM e WHERE event_type = 'click') SELECT event_type, CASE WHEN n < 100 THEN 'too_few' WHEN abs(p - p0) < sqrt(p * (1 - p) / n) THEN 'indistinguishable' ELSE 'different' END AS verdict FROM e, b",
    "mfu": f"SELECT run_id, round(median(tokens_per_sec) * 6 * 1.2e9 / 1e15, 6) AS mfu, round(1e9 / median(tokens_per_sec) / 3600, 4) AS eta_hours FROM {_A} WHERE tokens_per_sec > 0 AND NOT isnan(tokens_per_sec) AND NOT isinf(tokens_per_sec) GROUP BY 1",
    "revenue_by_nation": "WITH r AS (SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_name, round(r, 2) AS revenue, round(100 * r / sum(r) OVER (), 4) AS percent FROM r",
}
