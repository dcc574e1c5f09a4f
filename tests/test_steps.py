"""The transform step of the feature records, and models that a worker makes once."""
import os

import numpy as np
import pytest

from gridcast.functions.kernels import orient
from gridcast.operators import augment, features as ft, scoring
from gridcast.plans.storage import SIZES, TARGET, built_store, norm_stats_of
from gridcast.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return store.read_store(spark, built_store(spark, SF)), norm_stats_of(spark, SF), ft.FeatureConfig(image_size=2, sizes=SIZES)


def records(inputs, transform=None):
    rows = ft.feature_records(*inputs, transform=transform, target_size=TARGET).collect()
    return {r.uid: r for r in rows}


def test_features_masks_and_target_turn_together(spark, inputs):
    plain, turned = records(inputs), records(inputs, augment.transform_of(augment.PROFILES["base"], 7))
    drawn = augment.draw_orientation(inputs[0].select("uid"), augment.PROFILES["base"], 7).collect()
    assert plain.keys() == turned.keys() and {(r.flip_x, r.turns) for r in drawn} > {(True, 0)}
    for d in drawn:
        a, b, how = plain[d.uid], turned[d.uid], (d.flip_x, d.flip_y, d.turns)
        for name, shape in (("features", (-1, 2, 2)), ("target", TARGET), ("target_log", TARGET), ("rain_mask", TARGET)):
            one, two = (np.array(getattr(r, name), np.float32).reshape(shape) for r in (a, b))
            assert (orient(one, *how) == two).all()


def test_profiles(inputs):
    plain = records(inputs)
    assert records(inputs, augment.transform_of(augment.PROFILES["none"], 7)) == plain
    noisy = augment.transform_of(augment.Augmentation(noise_enabled=True, noise_sigma=0.5), 7)
    first, again = records(inputs, noisy), records(inputs, noisy)
    assert first == again
    moved = np.concatenate([np.array(first[u].features) - np.array(plain[u].features) for u in plain])
    assert abs(moved.std() - 0.5) < 0.02 and all(first[u].target == plain[u].target for u in plain)


def test_a_transform_must_keep_shapes(inputs):
    with pytest.raises(Exception, match="changed shapes"):
        records(inputs, lambda f, t, uid: (f[:1], t))
    with pytest.raises(ValueError, match="uid and target"):
        ft.image_features(*inputs, ["uid"], lambda f, t, uid: (f, t))


def test_a_worker_makes_its_model_once(spark, tmp_path):
    log = str(tmp_path / "made")

    def make():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda sat, aux: {"mean": sat[:, 0], "rain_logit": sat[:, 0] * 0 + 5}

    rows = spark.range(500).selectExpr("id", "array_repeat(cast(id as float) / 1000, 4) AS features", "array(1f) AS aux").repartition(50)
    for _ in range(2):
        out = scoring.score(rows, scoring.factory(make), (1, 2, 2), ["id"]).collect()
    assert len(out) == 500 and all(r.rate[0] == pytest.approx(np.expm1(r.id / 1000), abs=1e-5) for r in out)
    made = open(log).read().split()
    assert len(made) == len(set(made)) <= 2 * spark.sparkContext.defaultParallelism


def test_ensemble_mean_moves_pixels_once(spark):
    from gridcast.plans.verification import ensemble_mean

    plan = ensemble_mean(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ranks_carry_no_column_that_is_not_needed(spark, monkeypatch):
    from gridcast.operators import verify

    blocks, made = verify.ordered_blocks, []
    monkeypatch.setattr(verify, "ordered_blocks", lambda *a, **k: made.append(blocks(*a, **k)) or made[-1])
    rows = [(i, 0 if i % 3 else None, i % 5, float(i % 7), float(i % 4)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "uid long, sensor_id int, site_id long, pred double, target double")
    got = {(r.scope, r.sensor_id, r.site_id): round(r.spearman, 9) for r in verify.rank_report(pairs, ["uid"]).collect()}
    assert "pred" not in made[0].columns and not {"uid", "target"} & set(made[1].columns)

    def rho(part):
        rank = lambda c: {r[0]: i for i, r in enumerate(sorted(part, key=lambda r: (r[c], r[0])))}
        p, t, n = rank(3), rank(4), len(part)
        return round(1 - 6 * sum((p[u] - t[u]) ** 2 for u in p) / (n * (n * n - 1)), 9)

    assert got[("all", None, None)] == rho(rows) and got[("sensor", None, None)] == rho([r for r in rows if r[1] is None])
    assert all(got[("site", None, s)] == rho([r for r in rows if r[2] == s]) for s in range(5))
