"""Mixing sources to target shares of tokens.

Tokens of every record are counted with a public tokenizer, aggregated per source, and a repetition rate
per source is derived: the largest total for which no source needs more than its cap (water filling over
the ratios available / share), so that every source gets its share exactly in expectation. A record is
emitted floor(rate) times, plus once more with probability equal to the fraction, by a hash of seed, plan
and record. The reached shares are reported from the emitted copies.

If a source has no tokens, or its cap cannot carry its share at any total, the total is set by the
tightest source; ``budget`` may set another total, and sources then stop at their caps.

Defined cases: sources are compared without case and surrounding blanks; a null or blank source is no
source; shares of a plan that add up to more than 1.5 are percent; null texts and texts without tokens are
never emitted; repeated ``doc_id`` rows count once; plans with a null share or cap treat them as 0; plan rows
of one source add up, with the least cap; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenization pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens for texts, from a ``.tiktoken`` rank file or a ``.json`` tokenizer file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): each record once, with its number of tokens of the tokenizer file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": count(b["text"].tolist())})

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.lower(F.trim("source")).alias("source"), "text"
    )
    once = rows.where("source IS NOT NULL AND source <> ''")
    return once.mapInPandas(run, "doc_id long, source string, tokens long").dropDuplicates(["doc_id"])


def shares(plan: DataFrame) -> DataFrame:
    """(plan, source, share, cap) with shares as fractions of 1."""
    p = plan.select(
        "plan", F.lower(F.trim("source")).alias("source"),
        F.coalesce(F.col("target_share"), F.lit(0.0)).alias("raw"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("cap"),
    ).groupBy("plan", "source").agg(F.sum("raw").alias("raw"), F.min("cap").alias("cap"))
    total = p.groupBy("plan").agg(F.sum("raw").alias("total"))
    unit = F.when(F.col("total") > 1.5, 100.0).otherwise(1.0)
    return p.join(total, "plan").select("plan", "source", (F.col("raw") / unit).alias("share"), "cap")


def rates(counts: DataFrame, plan: DataFrame, budget: float | None = None) -> DataFrame:
    """(plan, source, share, cap, available, rate): copies per record of each source."""
    have = counts.groupBy("source").agg(F.sum("tokens").alias("available"))
    p = shares(plan).join(have, "source", "left").fillna(0, ["available"])
    carry = F.when((F.col("share") > 0) & (F.col("available") > 0), F.col("available") * F.col("cap") / F.col("share"))
    most = p.groupBy("plan").agg(F.min(carry).alias("total"))
    total = F.col("total") if budget is None else F.lit(float(budget))
    rate = F.when(F.col("available") > 0, F.least(F.col("cap").cast("double"), F.col("share") * total / F.col("available"))).otherwise(0.0)
    return p.join(most, "plan").select("plan", "source", "share", "cap", "available", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def copies(counts: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """(plan, doc_id, source, tokens, copies) of the emitted records, each by its number of copies."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "plan", "doc_id"), F.lit(1 << 52)) / float(1 << 52)).alias("u")
    whole = F.floor("rate")
    extra = (F.col("u") < F.col("rate") - whole).cast("int")
    joined = counts.join(rated.select("plan", "source", "rate"), "source")
    return joined.withColumn("u", u).withColumn("copies", (whole + extra).cast("int")).where("copies > 0 AND tokens > 0").select(
        "plan", "doc_id", "source", "tokens", "copies"
    )


def emitted(selection: DataFrame) -> DataFrame:
    """One row per copy: (plan, doc_id, copy)."""
    return selection.select("plan", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def report(selection: DataFrame, rated: DataFrame) -> DataFrame:
    """(plan, source, target_share, actual_share, rate, records, copies, tokens)."""
    by = selection.groupBy("plan", "source").agg(
        F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("emitted")
    )
    whole = by.groupBy("plan").agg(F.sum("emitted").alias("total"))
    got = rated.join(by, ["plan", "source"], "left").join(whole, "plan", "left").fillna(0, ["records", "copies", "emitted"])
    return got.select(
        "plan", "source", F.col("share").alias("target_share"),
        F.coalesce(F.try_divide(F.col("emitted").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("actual_share"),
        "rate", "records", "copies", F.col("emitted").alias("tokens"),
    )
