"""Array operators: norms, top-k, log-softmax, block quantization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def square_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2(a: Column) -> Column:
    return F.sqrt(square_sum(a))


def rms(a: Column) -> Column:
    return F.sqrt(square_sum(a) / F.size(a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    n = l2(a) + eps
    return F.transform(a, lambda x: x / n)


def swish(a: Column) -> Column:
    return F.transform(a, lambda x: x / (1 + F.exp(-x)))


def log_softmax_at(a: Column, pos: Column) -> Column:
    """Log-softmax of the 1-based position, shifted by the greatest value."""
    top = F.array_max(a).cast("double")
    return F.element_at(a, pos).cast("double") - top - F.ln(_sum(F.transform(a, lambda x: F.exp(x.cast("double") - top))))


def top_k(df: DataFrame, key: str, values: str, k: int) -> DataFrame:
    """(key, pos, score): the ``k`` greatest values of each array, ties by position; NaN and null rank last."""
    clean = F.transform(F.col(values), lambda x, i: F.struct((-F.when(F.isnan(x), float("-inf")).otherwise(x.cast("double"))).alias("n"), i.cast("long").alias("pos")))
    return df.select(key, F.explode(F.slice(F.array_sort(clean), 1, k)).alias("e")).select(key, F.col("e.pos").alias("pos"), (-F.col("e.n")).alias("score"))


def blocks(a: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a), F.lit(width)), lambda i: F.slice(a, i, F.lit(width)))


def quantized(block: Column, levels: float = 448.0) -> Column:
    """Values of a block rounded on a scale that is a power of two and carries the greatest value to ``levels``."""
    top = F.array_max(F.transform(block, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, F.pow(F.lit(2.0), F.ceil(F.log2(top / levels)))).otherwise(F.lit(1.0))
    return F.transform(block, lambda x: F.round(x.cast("double") / scale) * scale)


def quantization_error(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """(key, error): relative L2 error of blockwise quantization."""
    q = F.flatten(F.transform(blocks(F.col(values), width), lambda b: quantized(b)))
    off = F.zip_with(F.col(values), q, lambda x, y: x.cast("double") - y)
    return df.select(key, F.try_divide(l2(off), l2(F.col(values))).alias("error"))


#: Greatest E4M3 value, and the bounds between neighbouring E2M1 magnitudes with the magnitude below (fixed values).
E4M3_MAX = 448.0
E2M1 = ((0.25, 0.0), (0.75, 0.5), (1.25, 1.0), (1.75, 1.5), (2.5, 2.0), (3.5, 3.0), (5.0, 4.0))


def e4m3(x: Column) -> Column:
    """A positive number rounded to three binary digits after the first, half to even, saturated; 0 stays 0."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(x)), F.lit(-6)) - 3)
    return F.when(x > 0, F.least(F.rint(x / unit) * unit, F.lit(E4M3_MAX))).otherwise(F.lit(0.0))


def e2m1(x: Column) -> Column:
    """The nearest E2M1 value, the smaller magnitude where two are as near."""
    a, near = F.abs(x), F.lit(6.0)
    for bound, level in reversed(E2M1):
        near = F.when(a <= bound, F.lit(level)).otherwise(near)
    return F.signum(x) * near


def e2m1_block(block: Column) -> Column:
    """A block quantized to E2M1 under one E4M3 scale that carries its greatest magnitude to 6, and back."""
    scale = F.transform(F.array(e4m3(F.array_max(F.transform(block, lambda x: F.abs(x.cast("double")))) / 6.0)), lambda s: s)
    return F.flatten(F.transform(scale, lambda s: F.transform(block, lambda x: F.when(s > 0, e2m1(x.cast("double") / s) * s).otherwise(F.lit(0.0)))))


def e2m1_error(df: DataFrame, key: str, values: str, width: int = 16) -> DataFrame:
    """(key, error): relative L2 error of blocks of ``width`` in E2M1."""
    q = F.flatten(F.transform(blocks(F.col(values), width), e2m1_block))
    off = F.zip_with(F.col(values), q, lambda x, y: x.cast("double") - y)
    return df.select(key, (l2(off) / (l2(F.col(values)) + 1e-8)).alias("error"))
