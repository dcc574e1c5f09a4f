"""Ordered operators against loops, with one hot key and with more blocks than keys."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import history, ordered, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """600 rows: key 0 holds two thirds, many values repeat, one key is NULL."""
    rows = []
    rng = np.random.default_rng(5)
    for i in range(600):
        key = 0 if i % 3 else [1, 2, None][i // 3 % 3]
        rows.append((key, i, float(rng.integers(0, 8)), float(rng.normal())))
    return spark.createDataFrame(rows, "k int, i int, v double, x double").repartition(5), rows


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("blocks", [1, 7])
def test_rank(skewed, blocks):
    df, rows = skewed
    got = {r["i"]: r["rank"] for r in ordered.ordinal_rank(df, ["k"], ["v", "i"], n_blocks=blocks).collect()}
    for part in groups(rows).values():
        for n, r in enumerate(sorted(part, key=lambda r: (r[2], r[1]))):
            assert got[r[1]] == n


def test_global_rank_is_dense(skewed):
    df, rows = skewed
    got = sorted(r["rank"] for r in ordered.ordinal_rank(df, [], ["v", "i"], n_blocks=6).collect())
    assert got == list(range(len(rows)))


@pytest.mark.parametrize("decay", [0.5, 0.999, 1e-9])
def test_moving_average(skewed, decay):
    df, rows = skewed
    got = {r["i"]: r["ema"] for r in ordered.moving_average(df, ["k"], ["i"], "x", decay).collect()}
    for part in groups(rows).values():
        state = None
        for r in sorted(part, key=lambda r: r[1]):
            state = r[3] if state is None else decay * state + (1 - decay) * r[3]
            assert got[r[1]] == pytest.approx(state, abs=1e-12)


def test_moving_average_halves(spark):
    df = spark.createDataFrame([(0, 8.0), (1, 0.0)], "t int, x double")
    assert [r["ema"] for r in ordered.moving_average(df, [], ["t"], "x", 0.5).orderBy("t").collect()] == [8.0, 4.0]
    with pytest.raises(ValueError):
        ordered.moving_average(df, [], ["t"], "x", 1.0)


def test_running_sums_and_previous(skewed):
    df, rows = skewed
    sums = {r["i"]: r["running_x"] for r in ordered.running_sums(df, ["k"], ["i"], ["x"]).collect()}
    lags = {r["i"]: r["previous"] for r in ordered.previous_row(df, ["k"], ["i"], "x").collect()}
    for part in groups(rows).values():
        total, last = 0.0, None
        for r in sorted(part, key=lambda r: r[1]):
            total += r[3]
            assert sums[r[1]] == pytest.approx(total)
            assert lags[r[1]] == last
            last = r[3]


def test_percentile_and_order_statistics(skewed):
    df, rows = skewed
    got = {r["k"]: r["p"] for r in ordered.percentile_linear(df, ["k"], "v", 0.95, "p").collect()}
    for key, part in groups(rows).items():
        assert got[key] == pytest.approx(np.percentile([r[2] for r in part], 95))
    overall = ordered.percentile_linear(df, [], "x", 0.3, "p").first()["p"]
    assert overall == pytest.approx(np.percentile([r[3] for r in rows], 30))
    at = ordered.value_at_rank(df, ["k"], "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "out": F.col("n")})
    for r in at.collect():
        values = sorted(v[2] for v in groups(rows)[r["k"]])
        assert (r["n"], r["low"], r["mid"], r["out"]) == (len(values), values[0], values[len(values) // 2], None)


def test_first_per_group(skewed):
    df, rows = skewed
    got = ordered.first_per_group(df, ["k"], ["v", "i"], 5).collect()
    for key, part in groups(rows).items():
        want = sorted((r[2], r[1]) for r in part)[:5]
        assert sorted((r["v"], r["i"]) for r in got if r["k"] == key) == want


def brute_stop(values, patience, mode, delta):
    best, bad = None, 0
    for i, v in enumerate(values):
        if best is None:
            best = v
            continue
        gain = best - v if mode == "min" else v - best
        if gain > delta:
            best, bad = v, 0
        else:
            bad += 1
            if bad >= patience:
                return i, best
    return None, best


@pytest.mark.parametrize("patience,mode,delta", [(1, "min", 1e-5), (4, "min", 1e-5), (5, "max", 1e-5), (3, "min", 0.5), (400, "min", 0.0)])
def test_early_stop(skewed, patience, mode, delta):
    df, rows = skewed
    out = history.early_stops(df, ["k"], "i", "x", patience, mode, delta).collect()
    assert len(out) == 4
    got = {r["k"]: (r["stop_epoch"], r["best_value"]) for r in out}
    for key, part in groups(rows).items():
        part = sorted(part, key=lambda r: r[1])
        at, best = brute_stop([r[3] for r in part], patience, mode, delta)
        assert got[key][0] == (None if at is None else part[at][1])
        assert got[key][1] == pytest.approx(best)


def test_early_stop_steady_descent(spark):
    rows = [(i, 100.0 - i * 1e-6) for i in range(50)]
    out = history.early_stops(spark.createDataFrame(rows, "e int, v double"), [], "e", "v", 10).first()
    assert tuple(out) == brute_stop([v for _, v in rows], 10, "min", 1e-5)


def test_best_and_latest(spark):
    rows = [("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 2.0), ("b", 2, None)]
    df = spark.createDataFrame(rows, "r string, e int, v double")
    assert {tuple(r) for r in history.best_epochs(df, ["r"], "e", "v").collect()} == {("a", 2, 1.0), ("b", 1, 2.0)}
    assert {tuple(r)[1] for r in history.best_epochs(df, ["r"], "e", "v", "max").collect()} == {1}
    assert {(r["r"], r["e"]) for r in history.latest_epochs(df, ["r"], "e", 2).collect()} == {("a", 3), ("a", 2), ("b", 1), ("b", 2)}


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    got = {r["i"]: r["batch_id"] for r in sampling.batches(df, ["i"], 4).collect()}
    assert got == {i: i // 4 for i in range(10)}
    assert sampling.batches(df, ["i"], 4, drop_last=True).count() == 8
    with pytest.raises(ValueError):
        sampling.batches(df, ["i"], 0)
