"""Admission gates, orders, probes and agreements: each a column or a join, three-valued where input may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.plans.materialize import materialize
from corvane.plans.ranking import rank_in_group

#: Folders and suffixes that no snapshot takes (fixed values).
EXCLUDED_DIRS = ("benchmarks", "evidence", "env", "__pycache__")
EXCLUDED_SUFFIXES = (".zst", ".parquet", ".pyc", ".html", ".npz", ".safetensors", ".pt", ".bin")
#: Critical value of a chi-squared variable with one degree of freedom at 0.05 / 3 (Bonferroni over three comparisons).
MCNEMAR_CRITICAL = 5.7308
#: Windows that are looked for in one pass over the texts; the driver and each executor hold two hashes of each.
WINDOWS_A_PASS = 1 << 20


# --- filters ------------------------------------------------------------------------------------------


def code_language(language: Column, allowed: tuple[str, ...] = tx.CODE_LANGUAGES) -> Column:
    """Whether a code record is in an allowed language; an unknown one is not."""
    return F.coalesce(F.lower(F.trim(language)).isin(*allowed), F.lit(False))


def card(kind: Column, level: Column, title: Column, kinds: tuple[str, ...], levels: tuple[int, ...], prefix: str) -> Column:
    """Whether a card has one of the types and levels and a title with the prefix; missing values do not."""
    return F.coalesce(kind.isin(*kinds) & level.isin(*levels) & F.startswith(title, F.lit(prefix)), F.lit(False))


def listed(df: DataFrame, name: str, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records whose name is in the list, counts of the others by name); a null name is in no list."""
    names = allowed.select(F.col(name).alias("__n")).distinct()
    inside = df.join(names, F.col(name) == F.col("__n"), "left_semi")
    outside = df.join(names, F.col(name) == F.col("__n"), "left_anti").groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return inside, outside


def in_snapshot(path: Column) -> Column:
    """Whether a relative path belongs to a snapshot: no hidden part, excluded folder or suffix, ``runs``, nor ``data`` at the root."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*EXCLUDED_DIRS) | (p == "runs") | F.startswith(p, F.lit("runs-")))
    suffix = F.exists(F.array(*[F.lit(s) for s in EXCLUDED_SUFFIXES]), lambda s: F.endswith(F.lower(path), s))
    return F.coalesce(~(bad | suffix | (parts[0] == "data")), F.lit(False))


def between(ts: Column, since: Column | None = None, until: Column | None = None) -> Column:
    """``since`` <= ts < ``until``; a null time is outside."""
    ok = ts.isNotNull()
    ok = ok & (ts >= since) if since is not None else ok
    return ok & (ts < until) if until is not None else ok


def every(step: Column, k: int) -> Column:
    return F.coalesce(F.pmod(step, F.lit(k)) == 0, F.lit(False))


def first_records(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` records by ``order``: a bounded scan."""
    return df.orderBy(*order).limit(n)


def queue(df: DataFrame, stake: Column, age: str, *ties: str) -> DataFrame:
    """``df`` with ``place``: by rank of the stake, then the oldest; ranked without one task for all."""
    return rank_in_group(df.withColumn("_stake", stake), None, ["_stake", age, *ties], "place").drop("_stake")


def hidden_fraction(public: Column, hidden: Column) -> Column:
    return F.try_divide(hidden.cast("double"), (public + hidden).cast("double"))


def task_seed(base: Column, source_rank: Column, level_rank: Column, index: Column) -> Column:
    return base * 10_000 + source_rank * 1000 + level_rank * 100 + index


# --- agreements ----------------------------------------------------------------------------------------


def unmet_pins(budgets: DataFrame, pins: DataFrame, key: str, approved: str, met: str) -> DataFrame:
    """(key, violation): approved budgets whose KPI is not met, or is missing."""
    j = budgets.where(F.col(approved)).select(key).join(pins.select(key, met), key, "left")
    return j.select(key, F.when(F.col(met).isNull(), "missing").when(~F.col(met), "unmet").alias("violation")).where("violation IS NOT NULL")


def config_agreement(texts: DataFrame, config: DataFrame, key: str, path: str, text: str, glob: str, pattern: str, value: str) -> DataFrame:
    """(key, verdict): the value a text states against the configured one; exactly one file must match the pattern of paths."""
    hit = texts.where(F.col(path).rlike(glob)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.regexp_extract(text, pattern, 1)).alias("_said"))
    said = F.nullif(F.col("_said"), F.lit(""))
    verdict = (
        F.when(F.col("_n").isNull(), "no file").when(F.col("_n") > 1, "several files").when(said.isNull(), "unverified")
        .when(said == F.col(value).cast("string"), "pass").otherwise("fail")
    )
    return config.select(key, value).join(hit, key, "left").select(key, verdict.alias("verdict"))


def mcnemar(df: DataFrame, group: str, a: Column, b: Column, critical: float = MCNEMAR_CRITICAL) -> DataFrame:
    """(group, only_a, only_b, statistic, different): paired verdicts of two arms, with continuity correction."""
    x = df.groupBy(group).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))
    stat = F.try_divide(F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double"), F.lit(2.0)), (F.col("only_a") + F.col("only_b")).cast("double"))
    return x.withColumn("statistic", F.coalesce(stat, F.lit(0.0))).withColumn("different", F.col("statistic") > critical)


def mean_pass(df: DataFrame, group: str, run: str, passed: Column) -> DataFrame:
    """(group, runs, mean): pass share per run, then the mean over runs."""
    per = df.groupBy(group, run).agg(F.avg(passed.cast("double")).alias("_p"))
    return per.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.avg("_p").alias("mean"))


# --- probes ----------------------------------------------------------------------------------------------


def sensor_probe(pending: Column, contract: Column, chain: Column, declared_seen: Column, age_hours: Column, max_hours: Column, last_status: Column) -> Column:
    """(verdict, reason) of a sensor, the first failure winning; a missing age where one is asked for fails."""
    reason = (
        F.when(pending, "pending").when(~F.coalesce(contract, F.lit(False)), "contract").when(~F.coalesce(chain, F.lit(False)), "chain")
        .when(~F.coalesce(declared_seen, F.lit(True)), "declared").when(max_hours.isNotNull() & age_hours.isNull(), "no time").when(age_hours > max_hours, "stale")
        .when(last_status == "unverified", "last unverified").otherwise("ok")
    )
    verdict = F.when(reason == "ok", "pass").when(reason.isin("pending", "last unverified"), "unverified").otherwise("fail")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def raw_probe(recorded: Column, now: Column) -> Column:
    """Whether the fingerprint of raw data is the recorded one; data that cannot be read are unverified."""
    return F.when(recorded.isNull() | now.isNull(), "unverified").when(recorded == now, "pass").otherwise("fail")


# --- leak check ------------------------------------------------------------------------------------------


def windows(df: DataFrame, key: list[str], tokens: str, n: int) -> DataFrame:
    """(keys, gram): distinct windows of ``n`` tokens of an array column."""
    size = F.size(tokens)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(starts, lambda i: F.slice(F.col(tokens), i, F.lit(n))))
    return df.select(*key, F.explode(grams).alias("gram"))


def stream_chunks(stream: DataFrame, shard: str, pos: str, token: str, n: int, chunk: int = 4096) -> DataFrame:
    """(_w): arrays of consecutive tokens of a token stream (shard, pos, token), none across shards, that hold all its windows of ``n``.

    Tokens are gathered in chunks of positions; the first ``n`` - 1 of a chunk also belong to the one before.
    """
    own = F.floor(F.col(pos) / chunk)
    at = F.pmod(F.col(pos), F.lit(chunk))
    both = F.array_compact(F.array(own, F.when((at < n - 1) & (own > 0), own - 1)))
    c = stream.select(shard, pos, token, F.explode(both).alias("_c")).groupBy(shard, "_c").agg(F.array_sort(F.collect_list(F.struct(pos, token))).alias("_t"))
    return c.select(F.transform("_t", lambda x: x[token]).alias("_w"))


def stream_windows(stream: DataFrame, shard: str, pos: str, token: str, n: int, chunk: int = 4096) -> DataFrame:
    """(gram): distinct windows of a token stream (shard, pos, token), none across shards."""
    return windows(stream_chunks(stream, shard, pos, token, n, chunk), [], "_w", n).distinct()


def pieces(df: DataFrame, key: list[str], tokens: str, n: int, chunk: int = 4096) -> DataFrame:
    """(keys, _p): an array column cut into pieces that together hold each window of ``n`` tokens, so that no row has to hold them all."""
    firsts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1), F.lit(chunk)))
    return df.select(*key, F.explode(F.transform(firsts, lambda i: F.slice(F.col(tokens), i, F.lit(chunk + n - 1)))).alias("_p"))


def hashed(cut: DataFrame, key: list[str], n: int) -> DataFrame:
    """(keys, h, gram): windows of ``n`` tokens of the pieces and their hashes, repeated ones too."""
    grams = F.transform(F.sequence(F.lit(1), F.size("_p") - (n - 1)), lambda i: F.slice(F.col("_p"), i, F.lit(n)))
    return cut.select(*key, F.inline(F.transform(grams, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("gram")))))


def clean_of_texts(candidates: DataFrame, key: str, tokens: str, texts: DataFrame, words: str, n: int = 12, a_pass: int = WINDOWS_A_PASS) -> DataFrame:
    """(key): candidates that share no window of ``n`` tokens with an array of ``texts``; equality is of the tokens, not of hashes.

    Of the candidates only hashes go to all executors, of about ``a_pass`` windows at most at once; more take more passes
    over the texts. A window of a text holds exactly one run of ``n`` - ``step`` + 1 tokens that begins at every ``step``-th
    token: only where a candidate has such a run the windows around it are looked at, and only those met leave their task.
    """
    step = max(1, n // 2)
    run = n - step + 1
    held = pieces(candidates, [], tokens, n).distinct()
    passes = (held.agg(F.sum(F.size("_p") - (n - 1))).first()[0] or 0) // a_pass + 1
    around = lambda i: F.slice("_p", F.greatest(i - (step - 1), F.lit(1)), F.least(i + (n - 1), F.lit(n + step - 1)))
    runs = F.transform(F.sequence(F.lit(1), F.size("_p") - (n - step), F.lit(step)), lambda i: F.struct(F.xxhash64(F.slice("_p", i, F.lit(run))).alias("h"), around(i).alias("_p")))
    seen = None
    for k in range(passes):
        mine = held.where(F.pmod(F.xxhash64("_p"), F.lit(passes)) == k)
        met = pieces(texts, [], words, n).select(F.inline(runs)).join(F.broadcast(hashed(mine, [], run).select("h").distinct()), "h", "left_semi")
        met = hashed(met, [], n).join(F.broadcast(hashed(mine, [], n).select("h").distinct()), "h", "left_semi").select("gram").distinct()
        met = materialize(met, "met") if passes > 1 else met
        seen = met if seen is None else seen.union(met)
    # the planner takes the windows met for far smaller than they are; the hint keeps it from sending them to the driver
    hit = hashed(pieces(candidates, [key], tokens, n), [key], n).join(seen.hint("merge"), "gram", "left_semi")
    return candidates.select(key).join(hit.select(key).distinct(), key, "left_anti")


def clean_of_stream(candidates: DataFrame, key: str, tokens: str, stream: DataFrame, shard: str, pos: str, token: str, n: int = 12) -> DataFrame:
    """(key): candidates that share no window of ``n`` tokens with the stream; equality is of the tokens, not of hashes."""
    return clean_of_texts(candidates, key, tokens, stream_chunks(stream, shard, pos, token, n), "_w", n)


def leak_report(sources: DataFrame, source: str, text: str, evals: DataFrame, key: str, n: int = 12, examples: int = 3, token_sources: tuple[str, ...] = ()) -> DataFrame:
    """(source, docs_overlap, ngram_overlap, examples, verdict): what of the evaluation texts each source holds.

    ``docs_overlap``: a whole evaluation text stands in a text of the source (null for token sources);
    ``ngram_overlap``: share of the evaluation windows found; ``examples``: keys of evaluation records hit, the
    least first; ``verdict``: leak, clean, or empty where there is nothing to compare. A substring meets a text
    through its first window, shorter ones through all their words.
    """
    src = sources.select(F.col(source).alias("src"), tx.words(F.col(text)).alias("w"), tx.normal(F.col(text)).alias("_text"))
    ev = evals.select(key, tx.words(F.col(text)).alias("w"), tx.normal(F.col(text)).alias("_eval")).where(F.size("w") > 0)
    held = windows(ev, [key], "w", n)
    total = held.agg(F.count(F.lit(1)).alias("_total"))
    seen = windows(src.where("src IS NOT NULL"), ["src"], "w", n).join(held.select("gram").distinct(), "gram", "left_semi").distinct()
    hits = seen.join(held, "gram").groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set(key)).alias("_keys"))
    heads = ev.withColumn("_m", F.least(F.size("w"), F.lit(n))).withColumn("gram", F.slice("w", F.lit(1), F.col("_m")))
    whole = None
    for m in sorted(r[0] for r in heads.select("_m").distinct().collect()):
        g = windows(src, ["src", "_text"], "w", m)
        found = g.join(heads.where(F.col("_m") == m).select("gram", "_eval"), "gram").where(F.contains("_text", F.col("_eval"))).select("src")
        whole = found if whole is None else whole.union(found)
    every_src = src.select("src").where("src IS NOT NULL").distinct()
    out = every_src.join(hits, "src", "left").crossJoin(F.broadcast(total))
    out = out.join(whole.distinct().withColumn("_whole", F.lit(True)), "src", "left") if whole is not None else out.withColumn("_whole", F.lit(None).cast("boolean"))
    docs = F.when(F.col("src").isin(*token_sources), F.lit(None).cast("boolean")).otherwise(F.coalesce("_whole", F.lit(False))) if token_sources else F.coalesce("_whole", F.lit(False))
    share = F.coalesce(F.try_divide(F.col("_n").cast("double"), F.col("_total").cast("double")), F.lit(0.0))
    verdict = F.when(F.col("_total") == 0, "empty").when(F.coalesce(docs, F.lit(False)) | (share > 0), "leak").otherwise("clean")
    return out.select("src", docs.alias("docs_overlap"), share.alias("ngram_overlap"), F.slice(F.coalesce("_keys", F.array().cast("array<long>")), 1, examples).alias("examples"), verdict.alias("verdict"))
