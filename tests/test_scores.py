"""Verification and losses on hand-worked values."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.operators import ensemble, losses, profiles, scoring, verify

GRIDS = [
    (0, 0, 0, [0.0, 1.0, 3.0, 8.0], [0.0, 0.5, 3.0, 8.0]),
    (1, 1, 0, [0.0, 0.0, 1.0, 6.0], [0.0, 0.1, 2.0, 6.0]),
]


@pytest.fixture(scope="module")
def pairs(spark):
    df = spark.createDataFrame(GRIDS, "uid int, sensor_id int, site_id int, pred array<float>, target array<float>")
    return verify.pair_pixels(df.select("uid", "pred"), df.select("uid", "sensor_id", "site_id", "target"))


def test_hand_values(pairs):
    rows = {(r["scope"], r["sensor_id"], r["site_id"]): r for r in verify.full_report(pairs, ["uid", "pixel"], heavy=5.0, kind="float").collect()}
    assert set(rows) == {("all", None, None), ("sensor", 0, None), ("sensor", 1, None), ("site", None, 0)}
    r = rows[("all", None, None)]
    assert r["mse"] == pytest.approx(0.1575) and r["mae"] == pytest.approx(0.2) and r["bias"] == pytest.approx(-0.075)
    # 0.1 stored as FLOAT is no rain: no miss
    assert (r["csi"], r["pod"], r["far"], r["rain_accuracy"], r["rain_f1"]) == (1.0, 1.0, 0.0, 1.0, 1.0)
    assert r["heavy_f1"] == 1.0 and r["heavy_rmse"] == 0.0
    p, t = (np.array([v for g in GRIDS for v in g[i]]) for i in (3, 4))
    assert r["pearson"] == pytest.approx(np.corrcoef(p, t)[0, 1], rel=1e-6)
    assert r["r2"] == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rel=1e-6)
    ranks = lambda x: np.argsort(np.argsort(x, kind="stable"), kind="stable")
    assert r["spearman"] == pytest.approx(np.corrcoef(ranks(p), ranks(t))[0, 1])


def test_float_threshold(pairs):
    as_double = verify.report(pairs.select("sensor_id", "site_id", F.col("pred").cast("double"), F.col("target").cast("double")), heavy=5.0)
    assert as_double.where("scope = 'all'").first()["pod"] == pytest.approx(5 / 6)


def test_perfect_constant_and_empty(spark, pairs):
    same = pairs.withColumn("pred", F.col("target"))
    r = verify.report(same).where("scope = 'all'").first()
    assert (r["rmse"], r["mae"], r["bias"]) == (0.0, 0.0, 0.0) and r["r2"] == 1.0
    flat = verify.full_report(pairs.withColumn("pred", F.lit(0.3)).withColumn("target", F.lit(0.3)), ["uid", "pixel"]).where("scope = 'all'").first()
    assert (flat["r2"], flat["pearson"]) == (0.0, 0.0) and flat["ets"] == 0.0 and flat["heavy_rmse"] == 0.0
    assert verify.full_report(pairs.limit(0), ["uid", "pixel"]).count() == 0
    zero = verify.report(pairs.withColumn("pred", F.lit(0.0)).withColumn("target", F.lit(0.0))).first()
    assert (zero["csi"], zero["pod"], zero["far"], zero["rain_f1"]) == (0.0, 0.0, 0.0, 0.0)


def test_large_offsets_do_not_cancel(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 3).cast("int").alias("sensor_id"), (F.col("id") % 17).alias("site_id"),
        (F.lit(1e9) + F.col("id") % 7).alias("pred"), (F.lit(1e9) + F.col("id") % 5).alias("target"),
    )
    r = verify.report(rows).where("scope = 'all'").first()
    p, t = np.arange(4000) % 7, np.arange(4000) % 5
    assert r["pearson"] == pytest.approx(np.corrcoef(p, t)[0, 1], abs=1e-6)
    assert r["r2"] == pytest.approx(1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rel=1e-6)


def test_cells_meet_in_parts(spark):
    """5,000 sites far from zero: every scope as from its own pixels, and no exchange by scope alone before the parts."""
    rng = np.random.default_rng(4)
    site = np.repeat(np.arange(5000), 4)
    truth = 1e6 + site + rng.normal(0, 40, len(site))
    pred = truth + rng.normal(3, 25, len(site))
    df = spark.createDataFrame([(int(s % 3), int(s), float(p), float(t)) for s, p, t in zip(site, pred, truth)], "sensor_id int, site_id long, pred double, target double")
    cells = verify.cell_sums(df)
    out = verify.scores(verify.roll_up(cells))
    rows = {(r["scope"], r["sensor_id"], r["site_id"]): r for r in out.where("scope <> 'site' OR site_id < 20").collect()}
    assert len(rows) == 4 + 20
    for (_, sensor, at), r in rows.items():
        mine = (site % 3 == sensor if sensor is not None else True) & (site == at if at is not None else site >= 0)
        p, t = pred[mine], truth[mine]
        assert r["n"] == mine.sum() and r["bias"] == pytest.approx((p - t).mean(), rel=1e-9)
        assert r["pearson"] == pytest.approx(np.corrcoef(p, t)[0, 1], rel=1e-6)
        assert r["r2"] == pytest.approx(1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rel=1e-6)
    whole = verify.roll_up(cells).where("scope = 'all'")
    assert "_part" in whole._jdf.queryExecution().optimizedPlan().toString() and whole.count() == 1


def test_shape_mismatch(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "uid int, pred array<double>")
    b = spark.createDataFrame([(1, 0, 0, [1.0])], "uid int, sensor_id int, site_id int, target array<double>")
    with pytest.raises(Exception, match="shape mismatch"):
        verify.pair_pixels(a, b).collect()


# ---- losses ---------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(0)
    rows = []
    for uid, valid in ((0, 1.0), (1, 0.0), (2, 1.0)):
        for _ in range(6):
            raw = float(max(rng.normal(), 0) * 3)
            rows.append((uid, valid, float(rng.normal()), float(rng.normal()), float(rng.normal()), math.log1p(raw), float(raw > 0.1)))
    return spark.createDataFrame(rows, "uid int, has_data double, mean double, rain_logit double, log_var double, y double, rain_mask double"), rows


def masked(rows, f):
    means = {}
    for r in rows:
        means.setdefault((r[0], r[1]), []).append(f(*r[2:]))
    total = sum(np.mean(v) * valid for (_, valid), v in means.items())
    return total / max(sum(valid for _, valid in means), 1.0)


def test_composite(pixels):
    df, rows = pixels
    weights = losses.LossWeights(mse_weight=1, mae_weight=0.5, smooth_l1_weight=0.25, huber_weight=0.125, huber_delta=0.3, bce_weight=2, focal_gamma=1.5, nll_weight=0.1)
    out = losses.composite(df, weights).first()
    w = lambda y: 1 + 3 * max(y, 0)
    want = {
        "mse": masked(rows, lambda m, z, lv, y, k: w(y) * (m - y) ** 2),
        "mae": masked(rows, lambda m, z, lv, y, k: w(y) * abs(m - y)),
        "smooth_l1": masked(rows, lambda m, z, lv, y, k: (m - y) ** 2 / 2 if abs(m - y) < 1 else abs(m - y) - 0.5),
        "huber": masked(rows, lambda m, z, lv, y, k: (m - y) ** 2 / 2 if abs(m - y) <= 0.3 else 0.3 * (abs(m - y) - 0.15)),
        "nll": masked(rows, lambda m, z, lv, y, k: 0.5 * (lv + (m - y) ** 2 / math.exp(lv))),
    }

    def focal(m, z, lv, y, k):
        p = 1 / (1 + math.exp(-z))
        pt = p if k == 1 else 1 - p
        return -math.log(pt) * (1 - pt) ** 1.5

    want["bce"] = masked(rows, focal)
    for name, value in want.items():
        assert out[name] == pytest.approx(value, rel=1e-9), name
    factors = {"mse": 1, "mae": 0.5, "smooth_l1": 0.25, "huber": 0.125, "bce": 2, "nll": 0.1}
    assert out["total"] == pytest.approx(sum(want[n] * f for n, f in factors.items()))


def test_composite_switches(spark, pixels):
    df, rows = pixels
    off = losses.LossWeights.of({"mse_weight": 0, "bce_weight": 0, "no_such_key": 4})
    assert losses.composite(df, off).first().asDict() == {"total": 0.0}
    no_variance = losses.composite(df.drop("log_var"), losses.LossWeights(nll_weight=1.0))
    assert "nll" not in no_variance.columns
    plain = losses.composite(df, losses.LossWeights(mask_missing_frames=False, rain_weighted=False, bce_weight=0)).first()
    assert plain["mse"] == pytest.approx(np.mean([(r[2] - r[5]) ** 2 for r in rows]))
    all_missing = losses.composite(df.withColumn("has_data", F.lit(0.0))).first()
    assert all_missing["total"] == 0.0
    with pytest.raises(ValueError):
        losses.composite(df, losses.LossWeights(ssim_weight=1.0))


def test_structural_terms_join_by_sample(spark, pixels):
    df, _ = pixels
    grids = spark.createDataFrame([(u, [float(i) for i in range(9)], [float(i * u) for i in range(9)]) for u in range(3)], "uid int, pred array<double>, target array<double>")
    out = losses.composite(df, losses.LossWeights(gradient_weight=1.0, ssim_weight=1.0), grids=grids, shape=(3, 3)).first()
    scored = {r["uid"]: r for r in losses.grid_losses(grids, (3, 3)).collect()}
    assert out["gradient"] == pytest.approx((scored[0]["gradient"] + scored[2]["gradient"]) / 2)
    assert out["ssim"] == pytest.approx((scored[0]["ssim"] + scored[2]["ssim"]) / 2)


# ---- ensemble, scoring, profiles ------------------------------------------------------------------
def test_run_weights():
    assert ensemble.run_weights(["b", "a"], {"a": 3.0}) == {"a": 0.75, "b": 0.25}
    with pytest.raises(ValueError):
        ensemble.run_weights(["a"])


def test_combine_grids(spark):
    rows = [("a", "f", [80.0, 0.1]), ("b", "f", [60.0, 0.1])]
    df = spark.createDataFrame(rows, "run string, filename string, rate array<float>")
    assert ensemble.combine_grids(df, {"a": 0.5, "b": 0.5}).first()["rate"] == [60.0, 0.0]
    for broken in (df.where("run = 'a'"), df.union(df.where("run = 'a'"))):
        with pytest.raises(Exception, match="do not cover"):
            ensemble.combine_grids(broken, {"a": 0.5, "b": 0.5}).collect()


def test_score_and_registry(spark):
    def flat_model(sat, aux):
        return {"mean": sat[:, 0] - 1.0, "rain_logit": sat[:, 1], "log_var": sat[:, 0] * 100}

    row = [1.0, 2.0, 0.5, 3.0, -5.0, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(7, row, [0.0])], "uid int, features array<float>, aux array<float>")
    out = scoring.score(df, flat_model, (2, 2, 2), ["uid"]).first()
    assert out["rate"] == pytest.approx([0.0, math.expm1(1.0), 0.0, math.expm1(2.0)], rel=1e-6)
    both = scoring.score(df, flat_model, (2, 2, 2), ["uid"], mirrored=True).first()
    assert both["rate"] == pytest.approx(out["rate"], rel=1e-6)  # the model treats pixels alone
    raw = scoring.score(df, flat_model, (2, 2, 2), ["uid"], raw=True).first()
    assert raw["log_var"] == [5.0, 5.0, 5.0, 5.0]
    scoring.register_model("flat", flat_model)
    assert scoring.score(df, "flat", (2, 2, 2), ["uid"]).count() == 1
    with pytest.raises(ValueError):
        scoring.score(df, "other", (2, 2, 2), ["uid"])


def test_profile_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 3, 10)], "v double")
    r = profiles.predictions(df, "v").first()
    assert (r["mean"], r["nonzero_pct"], r["max"], r["min"]) == (2.8, 60.0, 10.0, 0.0)
    assert r["p95"] == pytest.approx(np.percentile([0, 0, 1, 3, 10], 95))
    assert profiles.rain_distribution(df.where("v = 0"), "v").first()["skew_raw"] is None
