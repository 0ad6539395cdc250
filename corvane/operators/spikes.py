"""Implausible readings in measurement series, judged by each source's own behaviour.

A source's readings form a profile matrix: a row a day where the source ran for at least ``DAYS`` days,
else rows of ``PROFILE`` consecutive readings. Robust principal components by alternating projections
split it into low-rank normal behaviour and sparse deviations; the sparse part gives the spikes: farther
than ``LIMIT`` scatters from the normal behaviour, for at most ``LONGEST`` readings in sequence. A check
that the reading also left the levels on both its sides, by half that limit, follows. Constant runs,
impossible values and counter jumps are tested apart.

Series are cut into bounded blocks with a margin on both sides, so a source of any length is spread over
many tasks. The scatter of a source is the median absolute difference of neighbouring readings over all
its readings, as a normal deviation.

Defined cases: null readings are never cases and are skipped as neighbours; NaN, infinite, zero and
negative readings are always cases; a source of fewer than three readings has no spikes; repeated
rows (same ``row_id``) count once; rows with null ``run_id`` form one source; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.grouped import sorted_group_map
from corvane.plans.materialize import materialize
from corvane.plans.ranking import rank_in_group

PROFILE, ROUNDS = 24, 6
LIMIT, LONGEST, STUCK, FAR_STEP = 8.0, 5, 8, 100_000
BLOCK, MARGIN, SIDE = 512, 64, 11
#: A reading is held out of the components from this many scatters off them.
CANDIDATE = 3.0
#: Least days for daily rows, least and greatest readings of a day for them, days a block holds.
DAYS, LEAST_DAILY, MOST_DAILY, DAYS_A_BLOCK = 4, 8, 2048, 8


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    yield from zip(edge[::2], edge[1::2])


def short_deviations(dev: np.ndarray, limit: float, longest: int = LONGEST) -> np.ndarray:
    """Mask of deviations beyond ``limit`` in sequences of one sign of at most ``longest``."""
    out = np.zeros(len(dev), bool)
    for side in (dev > limit, dev < -limit):
        for a, b in _runs(side):
            out[a:b] = b - a <= longest
    return out


def running_median(x: np.ndarray, width: int = 2 * LONGEST + 1) -> np.ndarray:
    """Medians of the readings around each reading, fewer at the ends."""
    pad = np.full(width // 2, np.nan)
    return np.nanmedian(np.lib.stride_tricks.sliding_window_view(np.r_[pad, x, pad], width), axis=1)


def low_rank(x: np.ndarray, scale: float, width: int = PROFILE, rounds: int = ROUNDS, daily: bool = False) -> np.ndarray:
    """Low-rank part of the profile matrix of series ``x`` by alternating projections.

    Short deviations are held out as sparse and filled from the current low-rank part, the rest is projected
    on the principal components that stand out of the noise (singular values above those of a noise matrix
    of this scatter), so lasting levels, trends and profiles belong to the low-rank part and no spike shapes
    it. A held-out reading returns once the components explain it. The last row overlaps the one before
    where the readings do not fill it; a day that is not full goes on like the day before. ``daily`` rows
    start from the median profile of the days.
    """
    given = len(x)
    width = max(1, min(width, given // 3))
    if daily:
        x = np.r_[x, x[given - width : given - width + -given % width]]
    n = len(x)
    start = np.arange(0, n - width + 1, width)
    at = (start if start[-1] + width == n else np.r_[start, n - width])[:, None] + np.arange(width)
    base = running_median(x)
    if daily:
        profile = np.median((x - base)[at], axis=0)
        base[at] = base[at] + profile
    noise = scale * (np.sqrt(at.shape[0]) + np.sqrt(width))
    for _ in range(rounds):
        filled = np.where(short_deviations((x - base) / scale, CANDIDATE), base, x)[at]
        mean = filled.mean(axis=0)
        u, s, v = np.linalg.svd(filled - mean, full_matrices=False)
        r = int((s > noise).sum())
        base = np.empty(n)
        base[at] = mean + (u[:, :r] * s[:r]) @ v[:r]
    return base[:given]


def side_levels(x: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Medians of up to ``side`` readings before and after each reading; NaN where fewer than three."""
    n = len(x)
    pad = np.full(side, np.nan)
    view = np.lib.stride_tricks.sliding_window_view(np.r_[pad, x, pad], side)
    ok = np.sum(~np.isnan(view), axis=1) >= 3
    med = np.full(len(view), np.nan)
    if ok.any():
        med[ok] = np.nanmedian(view[ok], axis=1)
    return med[:n], med[side + 1 : side + 1 + n]


def _off_both(x: np.ndarray, limit: float) -> np.ndarray:
    """Mask of values farther than ``limit`` from both sides' levels, and on the same side of both.

    A steep trend lies between its sides. At the ends of a series, where one side is missing, the value
    must also be off the other side's level carried on along its median slope.
    """
    before, after = side_levels(x)
    half = (SIDE + 1) / 2
    with np.errstate(invalid="ignore"):
        b, a = x - before, x - after
        both = (np.abs(b) > limit) & (np.abs(a) > limit) & (np.sign(b) == np.sign(a))
        d = np.diff(x, prepend=np.nan)
        slope_before, slope_after = side_levels(d)
        only_after = np.isnan(before) & (np.abs(a) > limit) & (np.abs(a + half * np.nan_to_num(slope_after)) > limit)
        only_before = np.isnan(after) & (np.abs(b) > limit) & (np.abs(b - half * np.nan_to_num(slope_before)) > limit)
    return both | only_after | only_before


def spikes(x: np.ndarray, scale: float, width: int = PROFILE, daily: bool = False) -> np.ndarray:
    """Mask of spikes in a series of finite positive readings."""
    if len(x) < 3 or not scale > 0:
        return np.zeros(len(x), bool)
    sparse = short_deviations((x - low_rank(x, scale, width, daily=daily)) / scale, LIMIT)
    return sparse & _off_both(x, LIMIT / 2 * scale) if sparse.any() else sparse


def stuck(x: np.ndarray, least: int = STUCK) -> np.ndarray:
    """Mask of readings in constant runs of at least ``least``."""
    out = np.zeros(len(x), bool)
    if len(x):
        cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(x)]):
            out[a:b] = b - a >= least
    return out


def wrong_steps(x: np.ndarray, far: float = FAR_STEP) -> np.ndarray:
    """Mask of counter values that are negative or far from the values on both sides."""
    clean = np.where(x < 0, np.nan, x)
    return (x < 0) | ~np.isnan(clean) & _off_both(clean, far)


def _profiled(rows: DataFrame) -> DataFrame:
    """Rows with ``width``, the readings of a profile row, and ``daily``, whether that is a day."""
    t = F.unix_micros(F.col("logged_at").cast("timestamp")) / 8.64e10
    of = rows.groupBy(F.col("run_id").alias("__r")).agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("days"))
    a_day = F.round(F.try_divide(F.col("n").cast("double"), F.col("days"))).cast("int")
    daily = F.coalesce((F.col("days") >= DAYS) & a_day.between(LEAST_DAILY, MOST_DAILY), F.lit(False))
    of = of.select("__r", daily.alias("daily"), F.when(daily, a_day).otherwise(PROFILE).alias("width"))
    return rows.join(of, rows["run_id"].eqNullSafe(F.col("__r")), "left").drop("__r", "logged_at")


def _blocks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with their block, those in a margin also in the neighbouring block (``core`` false)."""
    size = F.greatest(F.lit(BLOCK), F.col("width") * DAYS_A_BLOCK)
    own = F.floor(F.col("idx") / size)
    at = F.col("idx") % size
    near = F.array_compact(
        F.array(own, F.when((at < MARGIN) & (own > 0), own - 1), F.when(at >= size - MARGIN, own + 1))
    )
    return rows.withColumn("own", own).withColumn("block", F.explode(near)).select(
        "run_id", "block", (F.col("block") == F.col("own")).alias("core"), "idx", "row_id", "width", "daily", *fields
    )


def _groups(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
    run = g["run_id"].astype(object).where(g["run_id"].notna(), None).to_numpy()
    blk = g["block"].to_numpy()
    start = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (blk[1:] != blk[:-1])])
    for a, b in zip(start, np.r_[start[1:], len(g)]):
        yield g.iloc[a:b]


def _valid(v: np.ndarray) -> np.ndarray:
    return np.isfinite(v) & (v > 0)


def found(metrics: DataFrame, fields: tuple[str, ...] = ("loss", "tokens_per_sec"), counter: str = "step") -> DataFrame:
    """(row_id, field) of each wrong reading."""
    cols = [*fields, counter]
    rows = metrics.select("run_id", "segment", "logged_at", "row_id", *cols).dropDuplicates(["run_id", "segment", "logged_at", "row_id", counter])
    # null and NaN readings look alike to pandas: nulls are marked before
    rows = rows.select("*", *[F.col(c).isNull().alias(f"{c}_null") for c in cols])
    rows = rank_in_group(rows, "run_id", ["segment", "logged_at", "row_id"]).drop("segment")
    kept = [*cols, *(f"{c}_null" for c in cols)]
    blocks = materialize(_blocks(_profiled(rows), kept), "blocks")

    def moves(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in _groups(g):
            for f in fields:
                v = b[f].to_numpy(float)
                ok = _valid(v)
                d = np.abs(np.diff(v[ok]))[b["core"].to_numpy()[ok][1:]]
                out.append(pd.DataFrame({"run_id": b["run_id"].iloc[0], "field": f, "move": d}))
        return pd.concat(out, ignore_index=True)

    order = ["idx"]
    moved = sorted_group_map(blocks, ["run_id", "block"], order, moves, "run_id string, field string, move double")
    # zero moves of stuck stretches say nothing about scatter
    scale = (
        moved.where("move > 0").groupBy("run_id").pivot("field", list(fields)).agg(F.percentile_approx("move", 0.5, 10_000) / 0.9539)
        .select("run_id", *[F.col(f"`{f}`").alias(f"{f}_scale") for f in fields])
    )
    joined = blocks.join(scale.withColumnRenamed("run_id", "__r"), blocks["run_id"].eqNullSafe(F.col("__r")), "left").drop("__r")

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        ids: list[np.ndarray] = []
        names: list[str] = []
        for b in _groups(g):
            core, row = b["core"].to_numpy(), b["row_id"].to_numpy()
            for f in fields:
                v, null = b[f].to_numpy(float), b[f"{f}_null"].to_numpy(bool)
                ok = _valid(v)
                bad = ~ok & ~null
                scale = float(b[f"{f}_scale"].iloc[0])
                part = np.flatnonzero(ok)
                hit = spikes(v[ok], scale, int(b["width"].iloc[0]), bool(b["daily"].iloc[0]))
                # rows in sequence: a null or impossible reading between does not end a sequence of spikes
                bad[part[hit]] = True
                there = np.flatnonzero(~null)
                bad[there[stuck(np.where(np.isnan(v[there]), np.arange(len(there)) * -1.5 - 0.25, v[there]))]] = True
                ids.append(row[bad & core])
                names += [f] * int((bad & core).sum())
            s, null = b[counter].to_numpy(float), b[f"{counter}_null"].to_numpy(bool)
            there = np.flatnonzero(~null)
            bad = np.zeros(len(b), bool)
            bad[there[wrong_steps(s[there])]] = True
            ids.append(row[bad & core])
            names += [counter] * int((bad & core).sum())
        flat = np.concatenate(ids) if ids else np.empty(0)
        return pd.DataFrame({"row_id": pd.array(flat, dtype="Int64"), "field": pd.Series(names, dtype=object)})

    return sorted_group_map(joined, ["run_id", "block"], order, judge, "row_id long, field string").where("row_id IS NOT NULL")
