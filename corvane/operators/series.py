"""Series analytics: window statistics, blocks, changepoints, health rules, histories.

Series are partitioned by their source; positions come from the named order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.ranking import rank_in_group


def numbered(df: DataFrame, source: str, *order: str, out: str = "i") -> DataFrame:
    """``df`` with the 0-based position of each row in its source; ``order`` must be total."""
    return rank_in_group(df, source, list(order), out)


def tail(df: DataFrame, source: str, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows of each source; each of 16 salted parts gives its own last rows first."""
    w = Window.partitionBy(source).orderBy(*[F.desc(c) for c in order])
    own = Window.partitionBy(source, "_p").orderBy(*[F.desc(c) for c in order])
    salted = df.withColumn("_p", F.pmod(F.xxhash64(*order), F.lit(16)))
    first = salted.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).drop("_r", "_p")
    return first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    whole = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(whole).select("_row.*")


def slope(df: DataFrame, source: str, value: str, *order: str) -> DataFrame:
    """Least-squares slope over the row number; null for fewer than two values."""
    n = numbered(df.where(F.col(value).isNotNull() & ~F.isnan(value)), source, *order)
    return n.groupBy(source).agg(F.when(F.count(value) >= 2, F.regr_slope(value, "i")).alias("slope"), F.count(value).alias("n"))


def variation(value: str) -> Column:
    """Population deviation over the absolute mean; null for one value or mean 0."""
    mean = F.abs(F.avg(value))
    return F.when((F.count(value) >= 2) & (mean > 0), F.stddev_pop(value) / mean)


def robust_scale(df: DataFrame, source: str, value: str) -> DataFrame:
    """1.4826 times the median absolute deviation from the median."""
    med = df.groupBy(source).agg(F.median(value).alias("_m"))
    return df.join(med, source).groupBy(source).agg((F.median(F.abs(F.col(value) - F.col("_m"))) * 1.4826).alias("scale"))


def block_medians(df: DataFrame, source: str, value: str, *order: str, size: int = 25) -> DataFrame:
    """Medians of whole blocks of ``size`` rows; a short tail is left out."""
    n = numbered(df, source, *order).withColumn("block", F.floor(F.col("i") / size).cast("long"))
    return n.groupBy(source, "block").agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size).drop("n")


def _median_of(items: Column) -> Column:
    s, n = F.array_sort(items), F.size(items)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def changepoints(
    blocks: DataFrame, source: str, recent: int = 6, gap: int = 2, reference: int = 12, least: float = 0.10, z: float = 3.5, persist: int = 3, merge: int = 3
) -> DataFrame:
    """Lasting level changes of block medians: (source, start, stop, direction, delta).

    The median of ``recent`` blocks is held against that of ``reference`` blocks, ``gap`` blocks apart.
    The scatter is the robust scale of the source's block-to-block differences.
    """
    w = Window.partitionBy(source).orderBy("block")
    d = blocks.withColumn("_d", F.col("med") - F.lag("med").over(w))
    mid = d.groupBy(source).agg(F.median("_d").alias("_dm"))
    sigma = d.join(mid, source).groupBy(source).agg((F.median(F.abs(F.col("_d") - F.col("_dm"))) * 1.4826 / (2**0.5)).alias("_s"))
    now = F.collect_list("med").over(w.rowsBetween(-(recent - 1), 0))
    ref = F.collect_list("med").over(w.rowsBetween(-(recent + gap + reference - 1), -(recent + gap)))
    x = blocks.withColumn("_now", now).withColumn("_ref", ref).where((F.size("_now") == recent) & (F.size("_ref") == reference)).join(sigma, source)
    x = x.withColumn("delta", _median_of(F.col("_now")) - _median_of(F.col("_ref")))
    x = x.withColumn("z", F.try_divide(F.col("delta"), F.col("_s") * (1 / recent + 1 / reference) ** 0.5))
    fired = (F.abs("delta") >= least) & (F.abs("z") >= z)
    x = x.where(fired).withColumn("sign", F.signum("delta").cast("int"))
    near = F.coalesce(F.col("block") - F.lag("block").over(w) > 1, F.lit(True)) | F.coalesce(F.col("sign") != F.lag("sign").over(w), F.lit(True))
    runs = x.withColumn("_run", F.sum(near.cast("int")).over(w)).groupBy(source, "_run").agg(
        F.min("block").alias("start"), F.max("block").alias("stop"), F.first("sign").alias("sign"), F.max_by("delta", F.abs("delta")).alias("delta"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= persist)
    ws = Window.partitionBy(source).orderBy("start")
    apart = F.coalesce((F.col("start") - F.lag("stop").over(ws) >= merge) | (F.col("sign") != F.lag("sign").over(ws)), F.lit(True))
    return (
        runs.withColumn("_event", F.sum(apart.cast("int")).over(ws)).groupBy(source, "_event")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("sign").alias("sign"), F.max_by("delta", F.abs("delta")).alias("delta"))
        .select(source, "start", "stop", F.when(F.col("sign") > 0, "up").otherwise("down").alias("direction"), "delta")
    )


def unexplained(events: DataFrame, ledger: DataFrame, at: str, step: str, tolerance: int = 400) -> DataFrame:
    """Events with no ledger entry within ``tolerance``; the entries meet their own and the next buckets only."""
    b = ledger.select(F.explode(F.sequence(F.floor((F.col(step) - tolerance) / tolerance), F.floor((F.col(step) + tolerance) / tolerance))).alias("_b"), F.col(step).alias("_s"))
    e = events.withColumn("_b", F.floor(F.col(at) / tolerance))
    return e.join(b, (e["_b"] == b["_b"]) & (F.abs(e[at] - b["_s"]) <= tolerance), "left_anti").drop("_b")


def flapping(df: DataFrame, source: str, state: str, *order: str, last: int = 10, least: int = 3) -> DataFrame:
    """(source, switches, flapping) among the last states."""
    t = tail(df, source, last, *order)
    changed = (F.col(state) != F.lag(state).over(Window.partitionBy(source).orderBy(*order))).cast("int")
    return t.withColumn("_c", changed).groupBy(source).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("switches")).withColumn("flapping", F.col("switches") >= least)


def consecutive(df: DataFrame, source: str, hit: Column, n: int, *order: str) -> DataFrame:
    """(source, start, length) of runs of at least ``n`` rows in sequence for which ``hit`` holds."""
    x = numbered(df.withColumn("_h", F.coalesce(hit, F.lit(False))), source, *order)
    w = Window.partitionBy(source, "_h").orderBy("i")
    x = x.withColumn("_g", F.col("i") - F.row_number().over(w)).where("_h")
    return x.groupBy(source, "_g").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= n).drop("_g")


def previous(df: DataFrame, source: str, column: str, out: str, *order: str) -> DataFrame:
    """``df`` with ``out``: ``column`` of the row before in its source; no task holds a source."""
    n = numbered(df, source, *order, out="_at")
    before = n.select(F.col(source).alias("_s"), (F.col("_at") + 1).alias("_p"), F.col(column).alias(out))
    return n.join(before, n[source].eqNullSafe(before["_s"]) & (n["_at"] == before["_p"]), "left").drop("_s", "_p", "_at")


def _digest_before(df: DataFrame, source: str, raw: str, seq: str, out: str) -> DataFrame:
    line = df.withColumn("_digest", F.sha2(F.concat(F.col(raw), F.lit("\n")), 256))
    return previous(line, source, "_digest", out, seq).drop("_digest")


def chain_breaks(df: DataFrame, source: str, raw: str, prev: str, seq: str) -> DataFrame:
    """(source, intact, broken): each record must hold the SHA-256 of the line before it, the first none."""
    x = _digest_before(df, source, raw, seq, "_want").withColumn("_ok", F.col("_want").eqNullSafe(F.col(prev)))
    return x.groupBy(source).agg(F.bool_and("_ok").alias("intact"), F.count_if(~F.col("_ok")).alias("broken"))


def chained(df: DataFrame, source: str, raw: str, seq: str, out: str = "prev_sha256") -> DataFrame:
    """``df`` with the digest of the line before each record."""
    return _digest_before(df, source, raw, seq, out)


def histogram_quantile(df: DataFrame, series: list[str], le: str, cum: str, q: float) -> DataFrame:
    """Quantile of cumulative buckets by linear interpolation from 0."""
    w = Window.partitionBy(*series).orderBy(le)
    x = df.withColumn("_lo", F.coalesce(F.lag(le).over(w), F.lit(0.0))).withColumn("_c", F.coalesce(F.lag(cum).over(w), F.lit(0.0)))
    x = x.withColumn("_t", F.max(cum).over(Window.partitionBy(*series)) * q)
    first = x.where((F.col(cum) >= F.col("_t")) & (F.col("_t") > 0))
    at = F.col("_lo") + (F.col(le) - F.col("_lo")) * F.try_divide(F.col("_t") - F.col("_c"), F.col(cum) - F.col("_c"))
    return first.groupBy(*series).agg(F.min_by(at, le).alias("value"))
