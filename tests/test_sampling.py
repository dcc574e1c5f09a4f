import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import augment, sampling, stats


def test_weighted_draws_follow_the_weights(spark):
    df = spark.range(40).select(F.col("id").alias("uid"), (1 + F.col("id") % 4).cast("double").alias("weight"))
    out = sampling.weighted_draws(df, 100_000, seed=1).collect()
    assert sum(r["draws"] for r in out) == 100_000
    by_weight = np.zeros(5)
    for r in out:
        by_weight[int(r["weight"])] += r["draws"]
    np.testing.assert_allclose(by_weight[1:] / 100_000, np.array([1, 2, 3, 4]) / 10, atol=0.01)
    again = sampling.weighted_draws(df.repartition(3), 100_000, seed=1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    assert sorted(map(tuple, sampling.weighted_draws(df, 100_000, seed=2).collect())) != sorted(map(tuple, out))


def test_weighted_draws_edges(spark):
    one = spark.createDataFrame([(1, 0.0), (2, 5.0)], "uid int, weight double")
    assert [tuple(r) for r in sampling.weighted_draws(one, 7, 0).collect()] == [(2, 5.0, 7)]
    with pytest.raises(ValueError):
        sampling.weighted_draws(one.where("uid = 1"), 7, 0)
    assert sampling.expand_draws(sampling.weighted_draws(one, 7, 0)).count() == 7


def test_scene_weights(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 3.0]), (2, [float("nan"), 1.0]), (3, [-5.0, -1.0]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "uid int, target array<double>")
    got = {r["uid"]: r["weight"] for r in sampling.scene_weights(df, 3.0).collect()}
    assert got == pytest.approx({0: 1.0, 1: 1 + 3 * np.log1p(3), 2: 1.0, 3: 1.0, 4: 1.0})


def test_strategies(spark):
    df = spark.range(20).select(F.col("id").alias("uid"), F.array(F.col("id").cast("float")).alias("target"), F.col("id").alias("row_idx"))
    uniform = [r["uid"] for r in sampling.ordered_rows(df, "Uniform", 3).collect()]
    assert sorted(uniform) == list(range(20)) and uniform != list(range(20))
    assert uniform == [r["uid"] for r in sampling.ordered_rows(df.repartition(7), "random", 3).collect()]
    assert [r["uid"] for r in sampling.ordered_rows(df, "sequential").collect()] == list(range(20))
    assert sampling.ordered_rows(df, "precip_stratified", 3).count() == 20
    with pytest.raises(ValueError):
        sampling.ordered_rows(df, "newest")


def test_file_sample_counts_listings(spark):
    rows = [(f"u{i}", "goes", 0, "same.tif" if i < 6 else f"f{i}.tif") for i in range(12)] + [("z", "goes", 1, None)]
    df = spark.createDataFrame(rows, "uid string, sensor string, t int, filename string")
    assert stats.sample_files(df, 100).count() == 12
    assert stats.sample_files(df, 5).count() == 5


def test_augmentation_applies_alike(spark):
    grid = [float(i) for i in range(9)]
    rows = [(i, grid, grid + [v + 100 for v in grid]) for i in range(60)]
    df = spark.createDataFrame(rows, "uid int, target array<double>, features array<double>")
    out = augment.augment(df, augment.PROFILES["base"], 1, {"target": (1, 3, 3), "features": (2, 3, 3)}).collect()
    assert len({tuple(r["target"]) for r in out}) == 8  # all turns and flips of a square
    for r in out:
        assert r["features"][:9] == r["target"] and r["features"][9:] == [v + 100 for v in r["target"]]
    none = augment.augment(df, augment.PROFILES["none"], 1, {"target": (1, 3, 3)}).collect()
    assert all(r["target"] == grid for r in none)


def test_noise_is_standard_normal(spark):
    df = spark.range(50).select(F.col("id").alias("uid"), F.array_repeat(F.lit(0.0), 100).alias("x"))
    noisy = augment.Augmentation(noise_enabled=True, noise_sigma=2.0)
    values = np.array([r["x"] for r in augment.augment(df, noisy, 5, {}, noisy=("x",)).collect()]).ravel()
    assert abs(values.mean()) < 0.1 and abs(values.std() - 2.0) < 0.1
    flat = np.sort(values.reshape(-1) / 2.0)
    assert all(abs((flat < z).mean() - q) < 0.02 for z, q in ((-1.0, 0.1587), (0.0, 0.5), (1.0, 0.8413)))
    assert len(np.unique(values)) == values.size
    again = augment.augment(df.repartition(7), noisy, 5, {}, noisy=("x",)).orderBy("uid").collect()
    assert (np.array([r["x"] for r in again]).ravel() == values).all()
    quiet = augment.augment(df, augment.PROFILES["full"], 5, {}, noisy=("x",)).collect()
    assert all(set(r["x"]) == {0.0} for r in quiet)


def test_noise_keeps_nulls_and_any_length(spark):
    rows = [(1, [1.0, None, 3.0]), (2, None), (3, []), (None, [5.0])]
    df = spark.createDataFrame(rows, "uid int, x array<double>").coalesce(1)
    noisy = augment.Augmentation(noise_enabled=True, noise_sigma=1.0)
    out = [r["x"] for r in augment.augment(df, noisy, 5, {}, noisy=("x",)).collect()]
    assert out[0][1] is None and out[0][0] != 1.0 and out[1] is None and out[2] == [] and len(out[3]) == 1
    # a position's noise depends on the row's key and the position alone
    alone = augment.augment(spark.createDataFrame([(1, [0.0, 0.0, 3.0])], "uid int, x array<double>"), noisy, 5, {}, noisy=("x",)).first()["x"]
    assert alone[2] == out[0][2]
