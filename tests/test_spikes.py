import math
import os

import numpy as np
import pandas as pd
import pytest

from corvane.operators import spikes

SCHEMA = "row_id long, run_id string, segment int, step long, loss double, tokens_per_sec double, logged_at timestamp"


def frame(spark, rows):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    return spark.createDataFrame([(i, run, seg, step, loss, tps, t0 + timedelta(seconds=10 * i)) for i, run, seg, step, loss, tps in rows], SCHEMA)


def series(n, level=2.0, scatter=0.02, seed=0):
    return (level + scatter * np.random.default_rng(seed).standard_normal(n)).tolist()


def run(spark, loss, tps=None, steps=None, name="r"):
    n = len(loss)
    tps = tps or series(n, 100.0, 1.0, 1)
    steps = steps or list(range(n))
    return frame(spark, [(i, name, 0, steps[i], loss[i], tps[i]) for i in range(n)])


def found(df):
    return {(r["row_id"], r["field"]) for r in spikes.found(df).collect()}


def test_planted_cases(spark):
    loss, tps, steps = series(1300), series(1300, 100.0, 1.0, 1), list(range(1300))
    loss[100] = 5.0
    loss[500:505] = [0.5] * 2 + [0.6] * 3
    loss[511], loss[700], loss[701] = float("nan"), float("inf"), -1.0
    tps[200:209] = [101.25] * 9
    tps[900:] = [x + 40 for x in tps[900:]]
    steps[300], steps[1000] = -1, 10_000_000
    loss[50] = None
    want = {(i, "loss") for i in (100, 500, 501, 502, 503, 504, 511, 700, 701)} | {(i, "tokens_per_sec") for i in range(200, 209)} | {(300, "step"), (1000, "step")}
    assert found(run(spark, loss, tps, steps)) == want


def test_clean_trend_and_restart_give_nothing(spark):
    loss = [8 * math.exp(-i / 60) + 2 + x for i, x in enumerate(series(600, 0.0, 0.02))]
    steps = list(range(300)) + list(range(250, 550))
    assert found(run(spark, loss, None, steps)) == set()


def test_long_plateau_is_a_level(spark):
    loss = series(300)
    loss[100:120] = [x + 1 for x in loss[100:120]]
    assert found(run(spark, loss)) == set()


def test_redelivered_rows_and_blocks_do_not_matter(spark):
    loss = series(1100)
    loss[511] = loss[512] = 9.0
    df = run(spark, loss)
    assert found(df.union(df)) == {(511, "loss"), (512, "loss")}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_and_empty(spark, n):
    assert found(run(spark, series(n)) if n else spark.createDataFrame([], SCHEMA)) == set()


def test_nulls_everywhere_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (None, "x", 0, 1, float("nan"), 1.0, None)], SCHEMA)
    assert found(df.selectExpr("*", "'v' AS value", "1 AS idx", "2 AS block")) == set()


def test_stuck_needs_eight():
    assert not spikes.stuck(np.array([1.0] * 7 + [2.0])).any()
    assert spikes.stuck(np.array([0.0] + [1.0] * 8)).sum() == 8


def test_components_decide(monkeypatch):
    """Readings that leave the levels on both sides, but not the normal behaviour, are no spikes."""
    rng = np.random.default_rng(4)
    days = np.tile(np.r_[np.zeros(20), [-12.0] * 3, [0.0]], 30)
    x = 100 + days + rng.standard_normal(len(days))
    x[331] += 30
    hit = spikes.spikes(x, 1.0, 24, daily=True)
    assert np.flatnonzero(hit).tolist() == [331]
    monkeypatch.setattr(spikes, "low_rank", lambda x, *a, **k: np.full(len(x), np.median(x)))
    assert spikes.spikes(x, 1.0, 24, daily=True).sum() > 60


def test_without_components_other_rows(monkeypatch):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    m = pd.read_parquet(f"{folder}/metrics.parquet").drop_duplicates("row_id").sort_values(["run_id", "segment", "logged_at", "row_id"])
    series = [v[np.isfinite(v) & (v > 0)] for _, g in m.groupby("run_id") for v in (g["loss"].to_numpy(float), g["tokens_per_sec"].to_numpy(float))]
    scale = [float(np.median(d[d > 0])) / 0.9539 for d in (np.abs(np.diff(v)) for v in series)]
    total = lambda: sum(int(spikes.spikes(v, s).sum()) for v, s in zip(series, scale))
    real = total()
    monkeypatch.setattr(spikes, "short_deviations", lambda d, *a: np.ones(len(d), bool))
    assert total() > real > 0


def test_step_in_a_row_and_neighbours_of_a_spike():
    rng = np.random.default_rng(5)
    x = 100 + rng.standard_normal(700)
    x[333:] += 40
    x[500:505] -= 50
    x[499] = x[505] = 143.5
    assert np.flatnonzero(spikes.spikes(x, 1.0)).tolist() == [500, 501, 502, 503, 504]


def test_daily_rows_in_the_table(spark):
    from datetime import datetime, timedelta

    days = np.tile(np.r_[np.zeros(20), [-30.0] * 3, [0.0]], 40)
    x = 100 + days + np.random.default_rng(6).standard_normal(len(days))
    x[400] += 40
    rows = [(i, "d", 0, i, 2.0 + 0.02 * math.sin(i * 7.1), float(v), datetime(2026, 1, 1) + timedelta(hours=i)) for i, v in enumerate(x)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {(400, "tokens_per_sec")}
