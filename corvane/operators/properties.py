"""Three-valued property templates: every verdict is pass, fail or unverified, with missing input unverified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _verdict(ok: Column, known: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)) | ok.isNull(), "unverified").when(ok, "pass").otherwise("fail")


def declared_equals_actual(declared: Column, actual: Column, tolerance: float = 0.0) -> Column:
    return _verdict(F.abs(declared - actual) <= tolerance, declared.isNotNull() & actual.isNotNull())


def bounds(value: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Both bounds belong to the range; no bound at all is unverified."""
    tests = [t for t in ((value >= lo) if lo is not None else None, (value <= hi) if hi is not None else None) if t is not None]
    return _verdict(reduce(lambda a, b: a & b, tests), value.isNotNull()) if tests else F.lit("unverified")


def conservation(left: list[Column], right: list[Column], tolerance: float = 0.0) -> Column:
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    return _verdict(F.abs(total(left) - total(right)) <= tolerance, (total(left) + total(right)).isNotNull())


def identity(a: Column, b: Column) -> Column:
    """pass, fail, or truncated where one string is a proper prefix of the other."""
    cut = (F.length(a) != F.length(b)) & (F.startswith(a, b) | F.startswith(b, a))
    return F.when(a.isNull() | b.isNull(), "unverified").when(a == b, "pass").when(cut, "truncated").otherwise("fail")


def reversibility(before: Column, after: Column) -> Column:
    return _verdict(before.cast("string") == after.cast("string"), before.isNotNull() & after.isNotNull())


def differential(a: Column, b: Column, tolerance: float) -> Column:
    return _verdict((a == b) | (F.abs(a - b) <= tolerance), a.isNotNull() & b.isNotNull())


def metamorphic(base: Column, changed: Column, factor: float, tolerance: float) -> Column:
    return _verdict(F.abs(changed - base * factor) <= tolerance, base.isNotNull() & changed.isNotNull())


def safety(value: Column, forbidden: Column) -> Column:
    """A forbidden condition must not hold; one that cannot be evaluated does not hold."""
    return F.when(value.isNull(), "unverified").when(F.coalesce(forbidden, F.lit(False)), "fail").otherwise("pass")


def freshness(ts: Column, now: Column, max_hours: float) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(ts)) / 3.6e9
    return _verdict(age <= max_hours, ts.isNotNull())


def determinism(df: DataFrame, subject: str, value: str, least: int = 2) -> DataFrame:
    return df.groupBy(subject).agg(F.when(F.count(value) < least, "unverified").when(F.countDistinct(value) == 1, "pass").otherwise("fail").alias("verdict"))


def monotonic(df: DataFrame, source: str, value: str, tolerance: float, *order: str) -> DataFrame:
    """No value falls below the one before by more than the tolerance."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(source).orderBy(*order))
    return df.where(F.col(value).isNotNull()).withColumn("_ok", F.coalesce(step >= -tolerance, F.lit(True))).groupBy(source).agg(
        F.when(F.count(F.lit(1)) < 2, "unverified").when(F.bool_and("_ok"), "pass").otherwise("fail").alias("verdict")
    )


def liveness(df: DataFrame, source: str, value: str, ts: str, max_seconds: float, *order: str) -> DataFrame:
    """The last two records differ and lie at most ``max_seconds`` apart."""
    w = Window.partitionBy(source).orderBy(*order)
    x = df.withColumn("_v", F.lag(value).over(w)).withColumn("_t", F.lag(ts).over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull()).where("_last")
    ok = (F.col(value) != F.col("_v")) & (F.unix_seconds(F.col(ts)) - F.unix_seconds(F.col("_t")) <= max_seconds)
    return x.select(source, _verdict(ok, F.col("_t").isNotNull()).alias("verdict"))


def gate(verdicts: DataFrame, verdict: str) -> DataFrame:
    """(open, failed, unverified): open only if every verdict passes; no verdicts do not open it."""
    v = F.col(verdict)
    return verdicts.agg(F.coalesce(F.bool_and(v == "pass"), F.lit(False)).alias("open"), F.count_if(v == "fail").alias("failed"), F.count_if(v == "unverified").alias("unverified"))


def card(verdicts: DataFrame, name: str, verdict: str) -> DataFrame:
    """(status, reasons): final only if every check passes, else a draft with the names of the others."""
    v = F.col(verdict)
    return verdicts.agg(F.when(F.bool_and(v == "pass"), "v1").otherwise("v1-draft").alias("status"), F.array_sort(F.collect_list(F.when(v != "pass", F.col(name)))).alias("reasons"))


def requirements(required: DataFrame, claims: DataFrame, claim: str, verdict: str, flapping: str) -> DataFrame:
    """(claim, verdict): missing claims fail, flapping ones are unverified, others keep their verdict."""
    v = F.when(F.col(verdict).isNull(), "fail").when(F.col(flapping), "unverified").otherwise(F.col(verdict))
    return required.select(claim).join(claims.select(claim, verdict, flapping), claim, "left").select(claim, v.alias("verdict"))


def agreement(a: DataFrame, b: DataFrame, rule: str, verdict: str) -> DataFrame:
    """(rule, agrees) of two sets of verdicts."""
    return a.select(rule, F.col(verdict).alias("_a")).join(b.select(rule, F.col(verdict).alias("_b")), rule).select(rule, F.col("_a").eqNullSafe(F.col("_b")).alias("agrees"))


def table_of_verdicts(events: DataFrame) -> DataFrame:
    """Every column template over each event: (event_id, template, verdict)."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    kind, third = F.col("event_type"), F.col("event_id") % 3
    seen = F.when(third == 0, F.substring(kind, 1, 3)).when(third == 1, "click").otherwise(kind)
    rows = {
        "declared_equals_actual": declared_equals_actual(k, F.round(v), 5.0), "bounds": bounds(v, F.lit(5.0), F.lit(95.0)),
        "conservation": conservation([v, k], [F.lit(100.0)], 40.0), "identity": identity(kind, seen),
        "reversibility": reversibility(v, F.round(v, 1)), "differential": differential(v, k, 50.0), "metamorphic": metamorphic(v, k, 2.0, 20.0),
        "safety": safety(v, v > 90), "freshness": freshness(F.col("ts"), F.lit("2024-01-31").cast("timestamp"), 360.0),
    }
    wide = events.select("event_id", *[c.alias(n) for n, c in rows.items()])
    return wide.select("event_id", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rows]), F.array(*[F.col(n) for n in rows]))).alias("template", "verdict"))
