"""Byte-pair statistics and encoding with a given merge list; merges are an input, never trained into a file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx


def pair_counts(docs: DataFrame, text: str) -> DataFrame:
    """(a, b, n): counts of adjacent characters within words, weighted by word frequency."""
    freq = docs.select(F.explode(tx.words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    chars = freq.where(F.length("w") > 1).select("f", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("p"))
    return chars.groupBy(F.substring("p", 1, 1).alias("a"), F.substring("p", 2, 1).alias("b")).agg(F.sum("f").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair, ties by the pair itself."""
    return counts.orderBy(F.desc("n"), "a", "b").limit(1)


def encode(text: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of a word after applying the merges in rank order."""
    s = list(text)
    while len(s) > 1:
        k = min(range(len(s) - 1), key=lambda i: ranks.get((s[i], s[i + 1]), 1 << 60))
        if (s[k], s[k + 1]) not in ranks:
            break
        s[k : k + 2] = [s[k] + s[k + 1]]
    return s


def efficiency(docs: DataFrame, text: str, source: Column, merges: list[tuple[str, str]]) -> DataFrame:
    """(src, chars_per_token, round_trip): size of the encoding and share of words that decode to themselves."""
    ranks = {m: i for i, m in enumerate(merges)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            enc = [encode(w, ranks) for w in b["w"]]
            yield b.assign(tokens=[len(e) for e in enc], same=["".join(e) == w for e, w in zip(enc, b["w"])])

    words = docs.select(source.alias("src"), F.explode(tx.words(F.col(text))).alias("w")).groupBy("src", "w").agg(F.count(F.lit(1)).alias("f"))
    done = words.mapInPandas(run, "src string, w string, f long, tokens long, same boolean")
    return done.groupBy("src").agg(
        F.round(F.sum(F.length("w") * F.col("f")) / F.sum(F.col("tokens") * F.col("f")), 6).alias("chars_per_token"),
        F.avg(F.col("same").cast("double")).alias("round_trip"),
    )


def decoded(symbols: Column) -> Column:
    """Text of a sequence of symbols."""
    return F.array_join(symbols, "")


def vocabulary_hash(vocabulary: DataFrame, symbol: str, rank: str) -> DataFrame:
    """(size, sha256) of a bounded vocabulary: digest over its symbols by rank."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(symbol))))
    return vocabulary.agg(F.count(F.lit(1)).alias("size"), F.sha2(F.array_join(F.transform(rows, lambda x: x[symbol]), "\n"), 256).alias("sha256"))
