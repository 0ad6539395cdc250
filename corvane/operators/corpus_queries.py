"""Queries of corpus filters, deduplication, leakage and mixing over the documents table, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.tables import table
from corvane.operators import dedup, mix

SQL_SOURCE = "lower(trim(coalesce(source, 'none')))"
SQL_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


def source() -> Column:
    return F.lower(F.trim(F.coalesce("source", F.lit("none"))))


def corpus_volume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", source().alias("src")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(tx.approx_tokens(F.col("text"))).alias("approx_tokens")
    )


def volume_shares(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").groupBy(source().alias("src")).agg(F.sum(tx.approx_tokens(F.col("text"))).alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over one row a source
    return v.select("src", "tokens", F.round(100.0 * F.col("tokens") / whole, 6).alias("percent"))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    reason = (
        F.when(t.isNull() | (F.trim(t) == ""), "empty").when(F.length(t) < 32, "too_short").when(F.length(t) > 50000, "too_long")
        .when(tx.denied_path(F.col("path")), "denied_path").when(F.col("int_score") < 2, "quality").when(~tx.all_licensed(F.col("license")), "license").otherwise("kept")
    )
    return table(spark, d, "documents").groupBy(source().alias("src"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def pass_share(spark: SparkSession, d: str) -> DataFrame:
    ok = tx.all_licensed(F.col("license")) & (F.length("text") >= 32)
    return table(spark, d, "documents").groupBy(source().alias("src")).agg(F.count_if(ok).alias("kept"), F.count(F.lit(1)).alias("read"), F.round(F.try_divide(F.count_if(ok), F.count(F.lit(1))), 6).alias("share"))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where((F.col("int_score") >= 4) & F.col("n_chars").between(800, 50000)).select("doc_id", "int_score", "n_chars")


def code_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(source() == "code")
    size = F.octet_length("text")
    state = F.when(size < 256, "too_small").when(size > 100_000, "truncated").otherwise("whole")
    cut = tx.cut_bytes(F.col("text"), 100_000)
    return docs.select("doc_id", size.cast("long").alias("bytes"), state.alias("state"), F.octet_length(cut).cast("long").alias("kept_bytes"))


def test_marked(spark: SparkSession, d: str) -> DataFrame:
    """Documents per test marker, with those that hold none."""
    m = table(spark, d, "documents").select(tx.markers(F.col("text")).alias("found"))
    return m.select(F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit("none")))).alias("marker")).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


def path_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("repo", tx.path_class(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def path_majority(spark: SparkSession, d: str) -> DataFrame:
    c = path_classes(spark, d)
    rank = F.when(F.col("kind") == "docs", 3).when(F.col("kind") == "behaviour", 2).otherwise(1)
    return c.groupBy("repo").agg(F.max_by("kind", F.struct("n", rank)).alias("kind"), (F.countDistinct("kind") > 1).alias("mixed"))


def scrub_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").dropDuplicates(["turn_id"]).select(tx.secret_counts(F.col("content")).alias("c"))
    names = list(tx.SECRETS)
    wide = t.agg(*[F.coalesce(F.sum(f"c.{n}"), F.lit(0)).alias(n) for n in names])
    return wide.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))).alias("rule", "hits"))


def scrubbed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("content IS NOT NULL").dropDuplicates(["turn_id"])
    clean = tx.scrub(F.col("content"))
    return t.where(clean != F.col("content")).select("turn_id", F.length(clean).alias("n"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact(table(spark, d, "documents"), "doc_id", "text")


def exact_dup_rate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(F.sha2(tx.normal(F.col("text")), 256)).alias("n_unique")).select(
        "n_records", (F.col("n_records") - F.col("n_unique")).alias("n_duplicates"), F.round((F.col("n_records") - F.col("n_unique")) / F.col("n_records"), 6).alias("rate"))


def joint_pool_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("pool"), F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "eval_items").select(F.lit("items").alias("pool"), F.col("item_id").alias("id"), "text")
    return dedup.pooled(docs.unionByName(items), ["pool", "id"], "text").groupBy("pool").agg(F.count(F.lit(1)).alias("kept"))


def line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.lines(table(spark, d, "documents"), "doc_id", "text", source())


def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(tx.normal(F.col("text")), 256).alias("fp"), "int_score")
    known, new = docs.where("int_score >= 4"), docs.where("int_score < 4")
    return dedup.merge_candidates(known.select("fp"), new.select("fp"), "fp")


def near_dup_rate(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_rate(table(spark, d, "documents"), "doc_id", "text")


def rededup_is_stable(spark: SparkSession, d: str) -> DataFrame:
    once = dedup.exact(table(spark, d, "documents"), "doc_id", "text")
    again = dedup.exact(once.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "text"), "doc_id", "text")
    return once.select("doc_id").join(again.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))


def _grams(df: DataFrame, key: str, n: int = 12) -> DataFrame:
    w = df.select(key, tx.words(F.col("text")).alias("w"))
    return w.select(key, F.explode(F.array_distinct(tx.ngrams(F.col("w"), n))).alias("gram"))


def ngram_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Per source: share of its items' 12-grams found in documents, and items found whole."""
    items, docs = table(spark, d, "eval_items"), table(spark, d, "documents")
    held = _grams(items, "item_id")
    seen = _grams(docs, "doc_id").join(held.select("gram").distinct(), "gram", "left_semi").select("gram").distinct()
    hit = held.join(seen.withColumn("hit", F.lit(1)), "gram", "left").join(items.select("item_id", "suite"), "item_id")
    return hit.groupBy("suite").agg(F.count(F.lit(1)).alias("grams"), F.count("hit").alias("leaked"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("overlap"))


def ngram_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share no 12-gram with any item."""
    docs = table(spark, d, "documents")
    bad = _grams(docs, "doc_id").join(_grams(table(spark, d, "eval_items"), "item_id").select("gram").distinct(), "gram", "left_semi")
    return docs.select("doc_id").join(bad.select("doc_id").distinct(), "doc_id", "left_anti")


def holdout_sample(spark: SparkSession, d: str) -> DataFrame:
    return mix.holdout(table(spark, d, "documents").where("trim(text) <> ''"), "doc_id", share=0.05, least=10, seed=7)


def ngram_repeat_max(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    g = w.select("doc_id", F.explode(tx.ngrams(F.col("w"), 4)).alias("gram"))
    return g.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("repeat_max"))


def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(source().alias("src"), F.explode(tx.words(F.col("text"))).alias("w")).groupBy("src", "w").agg(F.count(F.lit(1)).alias("n"))
    total = w.groupBy("src").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") <= 2, F.col("n")).otherwise(0)).alias("rare"))
    p = F.col("n") / F.col("total")
    return w.join(total, "src").groupBy("src").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("bits"), F.round(F.max(F.col("rare") / F.col("total")), 6).alias("rare_share"))


def schema_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return mix.fingerprint(table(spark, d, "events").where("props IS NOT NULL"), "props")


def oversampled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", source().alias("src"))
    return mix.oversample(docs, F.when(F.col("src").isin("adr", "kernel_note"), 3).otherwise(1)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def share_capped(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", source().alias("src"), "n_chars")
    return mix.cap_shares(docs, "src", "doc_id", "n_chars", {"trace": 0.05, "skill": 0.10}).select("doc_id", "src")


def token_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", source().alias("src"), "n_chars").where(F.col("src").isin("code", "web"))
    return mix.two_way(docs, "src", "doc_id", "n_chars", "code", 0.15)


def phase_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.phase(spark.range(1000).withColumnRenamed("id", "t"), "t", 1000)


def curriculum(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return mix.context_lengths(docs, "doc_id", "n_chars")


def packed_sequences(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("doc_id", F.transform(F.split(F.substring("text", 1, 1 << 30), ""), lambda c: F.ascii(c)).alias("ids"))
    return mix.pack(ids, "ids", 32).select("doc_id", F.array_join(F.col("inputs").cast("array<string>"), ",").alias("inputs"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


def length_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return mix.length_batches(docs, "doc_id", "n_chars", 8)


def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("int_score IS NOT NULL").select("doc_id", (F.col("int_score") / 5.0).alias("p"))
    return mix.corridor_sample(docs, "doc_id", "p", 20, 3)


def windowed_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return mix.windowed_shuffle(table(spark, d, "documents").select("doc_id"), "doc_id", 64, 5)


def corpus_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", source().alias("src"), "n_chars")
    return mix.sized_sample(docs, "src", "doc_id", "n_chars", 60_000, {"web": 0.85, "code": 0.15}, 1)


def coin_flips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", (tx.coin("task", F.col("item_id"), "salt") < 0.5).alias("heads"))


def plan_shares(spark: SparkSession, d: str) -> DataFrame:
    p = mix.fractions(table(spark, d, "mix_plan").select("plan", "source", "target_share"), "plan", "target_share")
    return p.select("plan", "source", F.round("target_share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (
    plan_shares, corpus_volume, volume_shares, reject_reasons, pass_share, quality_gate, code_gate, test_marked, path_classes, path_majority, scrub_counts, scrubbed, exact_dedup,
    exact_dup_rate, joint_pool_dedup, line_dedup, candidate_merge, near_dup_rate, rededup_is_stable, ngram_leak_report, ngram_clean_documents, holdout_sample,
    ngram_repeat_max, token_entropy, schema_fingerprint, oversampled, share_capped, token_mix, phase_mix, curriculum, packed_sequences, length_batches, weighted_sample,
    windowed_shuffle, corpus_sample, coin_flips,
)}

_LIC = "(" + ", ".join(f"'{x}'" for x in tx.LICENSES) + ")"
_OK_LIC = f"(license IS NOT NULL AND len(license) > 0 AND len(list_filter(license, lambda x: lower(x) NOT IN {_LIC})) = 0)"
_CLASS = "CASE WHEN path IS NULL THEN 'work' WHEN regexp_matches(path, '^(docs|changes|evidence)/|\\.md$') THEN 'docs' WHEN regexp_matches(path, '^(net|env|tools)/.*\\.py$') THEN 'behaviour' ELSE 'work' END"
_COIN = "(('0x' || substr(md5({k}), 1, 12))::BIGINT / 281474976710656.0)"
_DOCW = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)')"


def _gram_sql(name: str, key: str, n: int) -> str:
    return f"(SELECT {key}, array_to_string(w[i:i+{n - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {_DOCW} AS w FROM {name})))"


SQL = {
    "plan_shares": "SELECT plan, source, round(CASE WHEN sum(target_share) OVER (PARTITION BY plan) > 1.5 THEN target_share / 100.0 ELSE target_share END, 6) AS share FROM mix_plan",
    "corpus_volume": f"SELECT lang, {SQL_SOURCE} AS src, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS approx_tokens FROM documents GROUP BY 1, 2",
    "volume_shares": f"SELECT src, tokens, round(100.0 * tokens / sum(tokens) OVER (), 6) AS percent FROM (SELECT {SQL_SOURCE} AS src, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1)",
    "reject_reasons": f"SELECT {SQL_SOURCE} AS src, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 32 THEN 'too_short' WHEN length(text) > 50000 THEN 'too_long' WHEN path IS NOT NULL AND regexp_matches(path, '(^|/)(\\.git|\\.venv|venv|node_modules|__pycache__)(/|$)|\\.(pem|key|p12|pfx|so|bin|exe|png|jpg)$') THEN 'denied_path' WHEN int_score < 2 THEN 'quality' WHEN NOT {_OK_LIC} THEN 'license' ELSE 'kept' END AS reason, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2",
    "pass_share": f"SELECT {SQL_SOURCE} AS src, count(*) FILTER ({_OK_LIC} AND length(text) >= 32) AS kept, count(*) AS read, round(count(*) FILTER ({_OK_LIC} AND length(text) >= 32) / count(*)::DOUBLE, 6) AS share FROM documents GROUP BY 1",
    "quality_gate": "SELECT doc_id, int_score, n_chars FROM documents WHERE int_score >= 4 AND length(text) BETWEEN 800 AND 50000",
    "code_gate": f"SELECT doc_id, strlen(text)::BIGINT AS bytes, CASE WHEN strlen(text) < 256 THEN 'too_small' WHEN strlen(text) > 100000 THEN 'truncated' ELSE 'whole' END AS state, (CASE WHEN strlen(text) <= 100000 THEN strlen(text) ELSE (SELECT max(strlen(left(text, k))) FROM range(0, 100001) r(k) WHERE strlen(left(text, k)) <= 100000) END)::BIGINT AS kept_bytes FROM documents WHERE {SQL_SOURCE} = 'code'",
    "packed_sequences": "WITH f AS (SELECT doc_id, ([1] || list_transform(string_split(text, ''), lambda c: unicode(c))[1:30] || [2] || list_transform(range(32), lambda i: 0))[1:32] AS f FROM documents) SELECT doc_id, array_to_string(f[1:31], ',') AS inputs, array_to_string(f[2:32], ',') AS labels FROM f",
    "test_marked": "SELECT marker, count(*) AS n FROM (SELECT unnest(CASE WHEN len(f) > 0 THEN f ELSE ['none'] END) AS marker FROM (SELECT list_filter(['def test_', 'unittest', 'pytest'], lambda m: contains(text, m)) AS f FROM documents WHERE text IS NOT NULL)) GROUP BY 1",
    "path_classes": f"SELECT repo, {_CLASS} AS kind, count(*) AS n FROM documents GROUP BY 1, 2",
    "path_majority": f"SELECT repo, arg_max(kind, n * 10 + CASE kind WHEN 'docs' THEN 3 WHEN 'behaviour' THEN 2 ELSE 1 END) AS kind, count(DISTINCT kind) > 1 AS mixed FROM (SELECT repo, {_CLASS} AS kind, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1",
    "scrub_counts": "WITH t AS (SELECT DISTINCT ON (turn_id) content FROM turns) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(coalesce(sum(len(regexp_extract_all(content, '{p}'))), 0) AS BIGINT) AS hits FROM t" for k, p in tx.SECRETS.items()),
    "exact_dedup": f"SELECT min(doc_id) AS doc_id, sha256({SQL_NORM}) AS fp, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2",
    "exact_dup_rate": f"SELECT count(*) AS n_records, count(*) - count(DISTINCT sha256({SQL_NORM})) AS n_duplicates, round((count(*) - count(DISTINCT sha256({SQL_NORM}))) / count(*)::DOUBLE, 6) AS rate FROM documents",
    "joint_pool_dedup": f"SELECT pool, count(*) AS kept FROM (SELECT pool, id, row_number() OVER (PARTITION BY sha256({SQL_NORM}) ORDER BY pool, id) AS rn FROM (SELECT 'documents' AS pool, doc_id AS id, text FROM documents UNION ALL SELECT 'items', item_id, text FROM eval_items)) WHERE rn = 1 GROUP BY 1",
    "line_dedup": f"WITH l AS (SELECT doc_id, {SQL_SOURCE} AS src, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), k AS (SELECT line, min(CASE src WHEN 'skill' THEN 0 ELSE 1 END * 1000000000000 + doc_id) AS best FROM l WHERE length(line) >= 40 GROUP BY 1) SELECT src, count(*) AS lines, count(*) FILTER (CASE src WHEN 'skill' THEN 0 ELSE 1 END * 1000000000000 + doc_id <> best) AS repeated FROM l JOIN k USING (line) GROUP BY 1",
    "candidate_merge": f"WITH d AS (SELECT sha256({SQL_NORM}) AS fp, int_score FROM documents), k AS (SELECT DISTINCT fp FROM d WHERE int_score >= 4), n AS (SELECT DISTINCT fp FROM d WHERE int_score < 4) SELECT count(*) FILTER (fp NOT IN (SELECT fp FROM k)) AS added, count(*) FILTER (fp IN (SELECT fp FROM k)) AS skipped FROM n",
    "rededup_is_stable": f"WITH once AS (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY {SQL_NORM}), again AS (SELECT min(doc_id) AS doc_id FROM documents JOIN once USING (doc_id) GROUP BY {SQL_NORM}) SELECT count(*) AS dropped FROM once WHERE doc_id NOT IN (SELECT doc_id FROM again)",
    "ngram_leak_report": f"WITH h AS (SELECT DISTINCT item_id, gram FROM {_gram_sql('eval_items', 'item_id', 12)}), s AS (SELECT DISTINCT gram FROM {_gram_sql('documents', 'doc_id', 12)}) SELECT suite, count(*) AS grams, count(s.gram) AS leaked, round(count(s.gram) / count(*)::DOUBLE, 6) AS overlap FROM h JOIN eval_items USING (item_id) LEFT JOIN s ON h.gram = s.gram GROUP BY 1",
    "ngram_clean_documents": f"WITH h AS (SELECT DISTINCT gram FROM {_gram_sql('eval_items', 'item_id', 12)}), b AS (SELECT DISTINCT doc_id FROM {_gram_sql('documents', 'doc_id', 12)} g SEMI JOIN h USING (gram)) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)",
    "holdout_sample": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('7|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents WHERE trim(text) <> '') WHERE rn <= least(n, greatest(10, ceil(0.05 * n)))",
    "ngram_repeat_max": f"SELECT doc_id, max(n) AS repeat_max FROM (SELECT doc_id, gram, count(*) AS n FROM {_gram_sql('documents', 'doc_id', 4)} GROUP BY 1, 2) GROUP BY 1",
    "token_entropy": f"WITH w AS (SELECT src, w, count(*) AS n FROM (SELECT {SQL_SOURCE} AS src, unnest({_DOCW}) AS w FROM documents) GROUP BY 1, 2), t AS (SELECT src, sum(n) AS total, sum(CASE WHEN n <= 2 THEN n ELSE 0 END) AS rare FROM w GROUP BY 1) SELECT src, round(-sum(n / total * log2(n / total)), 6) AS bits, round(max(rare / total), 6) AS rare_share FROM w JOIN t USING (src) GROUP BY 1",
    "schema_fingerprint": "SELECT count(*) AS fields, sha256(string_agg(k || ':' || ty, chr(10) ORDER BY k)) AS fingerprint FROM (SELECT k, CASE WHEN count(DISTINCT ty) > 1 THEN 'mixed' ELSE min(ty) END AS ty FROM (SELECT k, CASE json_type(props, k) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' ELSE 'null' END AS ty FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) GROUP BY k)",
    "oversampled": f"SELECT {SQL_SOURCE} AS src, CAST(sum(CASE WHEN {SQL_SOURCE} IN ('adr', 'kernel_note') THEN 3 ELSE 1 END) AS BIGINT) AS n FROM documents GROUP BY 1",
    "share_capped": f"WITH d AS (SELECT doc_id, {SQL_SOURCE} AS src, n_chars, sum(n_chars) OVER () AS total, sum(n_chars) OVER (PARTITION BY {SQL_SOURCE} ORDER BY doc_id) AS run FROM documents) SELECT doc_id, src FROM d WHERE run <= CASE src WHEN 'trace' THEN 0.05 WHEN 'skill' THEN 0.10 ELSE 1e9 END * total",
    "token_mix": f"WITH d AS (SELECT doc_id, {SQL_SOURCE} AS src, n_chars // 4 AS tk FROM documents WHERE {SQL_SOURCE} IN ('code', 'web')), t AS (SELECT sum(tk) FILTER (src = 'code') AS c, sum(tk) FILTER (src = 'web') AS w FROM d), m AS (SELECT least(c / 0.15, w / 0.85) AS total FROM t), r AS (SELECT src, doc_id, tk, sum(tk) OVER (PARTITION BY src ORDER BY doc_id) AS run FROM d) SELECT src, count(*) AS records, CAST(sum(tk) AS BIGINT) AS tokens FROM r, m WHERE run <= total * CASE src WHEN 'code' THEN 0.15 ELSE 0.85 END GROUP BY 1",
    "phase_mix": "SELECT t, CASE WHEN ((t + 1) * (t + 2)) // 2000 > (t * (t + 1)) // 2000 THEN 'Q' ELSE 'W' END AS stream FROM range(1000) r(t)",
    "curriculum": "SELECT doc_id, CASE WHEN run - n_chars < 0.9 * total THEN 8192 ELSE 65536 END AS context FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS run, sum(n_chars) OVER () AS total FROM documents)",
    "length_batches": "SELECT doc_id, CAST((rn - 1) // 8 AS BIGINT) AS batch, CAST(max(n_chars) OVER (PARTITION BY (rn - 1) // 8) - n_chars AS BIGINT) AS padding FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS rn FROM documents)",
    "weighted_sample": f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY ln({_COIN.format(k=chr(39) + '3|' + chr(39) + ' || doc_id')}) / (1 - p) DESC, doc_id) AS rn FROM (SELECT doc_id, int_score / 5.0 AS p FROM documents WHERE int_score IS NOT NULL) WHERE p > 0 AND p < 1) WHERE rn <= 20",
    "windowed_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY w, h, doc_id) - 1 AS pos FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS w, sha256('5|' || doc_id) AS h FROM documents)",
    "corpus_sample": f"WITH d AS (SELECT doc_id, {SQL_SOURCE} AS src, n_chars, sum(n_chars) OVER (PARTITION BY {SQL_SOURCE} ORDER BY sha256('1|' || doc_id), doc_id) AS run FROM documents) SELECT doc_id, src FROM d WHERE run <= CASE src WHEN 'web' THEN 0.85 WHEN 'code' THEN 0.15 ELSE 0 END * 60000",
    "coin_flips": f"SELECT item_id, {_COIN.format(k=chr(39) + 'task|' + chr(39) + ' || item_id || ' + chr(39) + '|salt' + chr(39))} < 0.5 AS heads FROM eval_items",
}
