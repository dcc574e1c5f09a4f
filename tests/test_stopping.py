"""Early stopping over many blocks against the sequential rule."""
import math
import random

import numpy as np
import pytest

from gridcast.operators import history, stopping
from pyspark.sql import functions as F


def plain(values, lag, delta):
    """(index at which it stops or None, best by then)"""
    best, bad = None, 0
    for i, v in enumerate(values):
        if v is not None and not math.isnan(v) and (best is None or best - v > delta):
            best, bad = v, 0
        elif best is not None:
            bad += 1
            if bad >= lag:
                return i, best
    return None, best


def series(rnd, kind, n):
    falls = {"falling": 1e-3, "slowly": 3e-6, "flat": 0.0}
    if kind in falls:
        return [1.0 - falls[kind] * i for i in range(n)]
    if kind == "steps":
        return [round(5 - (i // 7) * 0.1 + rnd.random() * 0.3, 2) for i in range(n)]
    return [rnd.choice([rnd.random(), rnd.random() * 1e-5, None, float("nan")]) for _ in range(n)]


@pytest.mark.parametrize("lag", [1, 3, 10, 40])
@pytest.mark.parametrize("seed", range(6))
def test_composed_blocks_equal_the_rule(lag, seed):
    rnd = random.Random(seed)
    for kind in ("falling", "slowly", "flat", "steps", "wild"):
        for delta in (1e-5, 0.0, 0.2):
            values = series(rnd, kind, 300)
            cuts = sorted({0, 300, *(rnd.randrange(300) for _ in range(12))})
            courses, low = [], None
            for a, b in zip(cuts, cuts[1:]):
                rows = [(v, i) for i, v in enumerate(values[a:b], a) if v is not None and not math.isnan(v) and (low is None or v < low)]
                if rows:
                    v, p = map(np.array, zip(*rows))
                    courses.append(stopping.course_of(v, p, low, lag, delta))
                    low = min(v.min(), low if low is not None else np.inf)
            # in two levels
            halves = [stopping.composed(courses[i:i + 4], lag, delta) for i in range(0, len(courses), 4)]
            f = stopping.composed(halves, lag, delta)
            stop = int(f.stop[0]) if f.stop[0] >= 0 else int(f.at[0]) + lag
            want = plain(values, lag, delta)
            assert (stop if stop < 300 else None, f.best[0]) == want


@pytest.mark.parametrize("n_blocks", [1, 40])
def test_runs_of_any_length(spark, n_blocks):
    rnd = random.Random(5)
    runs = {k: series(rnd, kind, n) for k, (kind, n) in enumerate([("falling", 3000), ("slowly", 3000), ("steps", 2000), ("wild", 900), ("flat", 50), ("steps", 1), ("falling", 12)])}
    runs[None] = series(rnd, "steps", 100)
    runs[99] = [None] * 30
    rows = [(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run int, epoch int, value double")
    got = {r.run: (r.stop_epoch, r.best_value) for r in history.early_stops(df, ["run"], "epoch", "value", n_blocks=n_blocks).collect()}
    assert got == {k: plain(vs, 10, 1e-5) for k, vs in runs.items()}


def test_largest_wins_and_no_keys(spark):
    df = spark.createDataFrame([(i, float(min(i, 20))) for i in range(60)], "epoch int, value double")
    assert [tuple(r) for r in history.early_stops(df, [], "epoch", "value", 5, "max", n_blocks=7).collect()] == [(25, 20.0)]
    assert history.early_stops(df.limit(0), [], "epoch", "value").count() == 0


def test_a_long_falling_series(spark):
    """No block falls back to its rows: a function has one step where rows fall by more than min_delta."""
    df = spark.range(2_000_000).select(F.col("id").alias("epoch"), (-F.col("id").cast("double")).alias("value"))
    assert [tuple(r) for r in history.early_stops(df, [], "epoch", "value", n_blocks=70).collect()] == [(None, -1_999_999.0)]
