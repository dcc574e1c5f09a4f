"""Verification, losses and ensembles."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions import columns as fx
from gridcast.functions.rows import unpack
from gridcast.operators import ensemble, losses, ordered, verify
from gridcast.plans.registry import query, rounded, rounds
from gridcast.plans.views import GRID, GRIDS_SQL, PAIRS_SQL, POSITION, RING_SQL, cells, following, grids, neighbours, pixel_pairs, table

HEAVY = 3.0

SCORE_SQL = f"""
flags AS (
  SELECT *, pred - target AS d, pred > 0.1::DOUBLE AS wp, target > 0.1::DOUBLE AS wt,
         pred > {HEAVY}::DOUBLE AS hp, target > {HEAVY}::DOUBLE AS ht FROM pairs),
sums AS (
  SELECT CASE WHEN GROUPING(sensor_id) = 0 THEN 'sensor' WHEN GROUPING(site_id) = 0 THEN 'site' ELSE 'all' END AS scope,
         CAST(sensor_id AS INTEGER) AS sensor_id, CAST(site_id AS BIGINT) AS site_id,
         COUNT(*) AS n, AVG(d) AS bias, AVG(ABS(d)) AS mae, AVG(d * d) AS mse,
         VAR_POP(target) AS vt, VAR_POP(pred) AS vp, COVAR_POP(pred, target) AS cpt,
         CAST(COUNT(*) FILTER (WHERE wp AND wt) AS DOUBLE) AS tp,
         CAST(COUNT(*) FILTER (WHERE wp AND NOT wt) AS DOUBLE) AS fp,
         CAST(COUNT(*) FILTER (WHERE NOT wp AND wt) AS DOUBLE) AS fn,
         CAST(COUNT(*) FILTER (WHERE hp AND ht) AS DOUBLE) AS htp,
         CAST(COUNT(*) FILTER (WHERE hp AND NOT ht) AS DOUBLE) AS hfp,
         CAST(COUNT(*) FILTER (WHERE NOT hp AND ht) AS DOUBLE) AS hfn,
         SQRT(AVG(d * d) FILTER (WHERE ht)) AS hr
  FROM flags GROUP BY GROUPING SETS ((), (sensor_id), (site_id))),
scored AS (
  SELECT scope, sensor_id, site_id, n, SQRT(mse) AS rmse, mae, mse, bias,
         CASE WHEN vt * n < 1e-12 THEN 0 ELSE 1 - mse / vt END AS r2,
         CASE WHEN SQRT(vt * vp) * n < 1e-12 THEN 0 ELSE cpt / SQRT(vt * vp) END AS pearson,
         COALESCE(tp / NULLIF(tp + fp + fn, 0), 0) AS csi, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS pod,
         COALESCE(fp / NULLIF(tp + fp, 0), 0) AS far,
         COALESCE((tp - (tp + fp) * (tp + fn) / n) / NULLIF(tp + fp + fn - (tp + fp) * (tp + fn) / n, 0), 0) AS ets,
         COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS rain_f1, (n - fp - fn) / n AS rain_accuracy,
         COALESCE(2 * htp / NULLIF(2 * htp + hfp + hfn, 0), 0) AS heavy_f1, COALESCE(hr, 0) AS heavy_rmse
  FROM sums)"""
SCORE_SELECT = f"SELECT scope, sensor_id, site_id, n, {rounds(*verify.SCORES)} FROM scored"
SPREAD_SQL = """spread AS (
  SELECT 'all' AS scope, CAST(NULL AS INTEGER) AS sensor_id, CAST(NULL AS BIGINT) AS site_id, uid, line, part, site_id AS pos, pred, target FROM pairs
  UNION ALL SELECT 'sensor', sensor_id, NULL, uid, line, part, site_id, pred, target FROM pairs
  UNION ALL SELECT 'site', NULL, site_id, uid, line, part, site_id, pred, target FROM pairs),
ranked AS (
  SELECT scope, sensor_id, site_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY scope, sensor_id, site_id ORDER BY pred, uid, line, part, pos) - 1 AS DOUBLE) AS rp,
         CAST(ROW_NUMBER() OVER (PARTITION BY scope, sensor_id, site_id ORDER BY target, uid, line, part, pos) - 1 AS DOUBLE) AS rt
  FROM spread),
rho AS (SELECT scope, sensor_id, site_id, COALESCE(COVAR_POP(rp, rt) / NULLIF(SQRT(VAR_POP(rp) * VAR_POP(rt)), 0), 0) AS spearman
        FROM ranked GROUP BY ALL)"""


@query("verify_report", f"WITH {PAIRS_SQL}, {SCORE_SQL} {SCORE_SELECT}")
def verify_report(spark, sf_dir):
    return rounded(verify.report(pixel_pairs(spark, sf_dir), heavy=HEAVY), *verify.SCORES)


@query(
    "verify_flat",
    f"WITH {PAIRS_SQL}, {SCORE_SQL}, {SPREAD_SQL}, full_scores AS (SELECT s.*, r.spearman FROM scored s JOIN rho r ON s.scope = r.scope "
    "AND s.sensor_id IS NOT DISTINCT FROM r.sensor_id AND s.site_id IS NOT DISTINCT FROM r.site_id), "
    "p AS (SELECT CASE scope WHEN 'sensor' THEN 'sat' || CAST(sensor_id AS VARCHAR) || '/' WHEN 'site' THEN 'loc' || CAST(site_id AS VARCHAR) || '/' ELSE '' END AS p, * FROM full_scores) "
    + " UNION ALL ".join(f"SELECT p || '{m}' AS metric, ROUND({m}, 6) AS value FROM p" for m in (*verify.SCORES, "spearman")),
)
def verify_flat(spark, sf_dir):
    """The full report as flat metric names."""
    pairs = pixel_pairs(spark, sf_dir).withColumn("pos", F.col("site_id"))
    return rounded(verify.flat_metrics(verify.full_report(pairs, ["uid", "line", "part", "pos"], heavy=HEAVY)), "value")


@query("verify_spearman", f"WITH {PAIRS_SQL}, {SPREAD_SQL} SELECT scope, sensor_id, site_id, {rounds('spearman')} FROM rho")
def verify_spearman(spark, sf_dir):
    pairs = pixel_pairs(spark, sf_dir).withColumn("pos", F.col("site_id"))
    return rounded(verify.rank_report(pairs, ["uid", "line", "part", "pos"]), "spearman")


@query(
    "verify_full",
    f"WITH {PAIRS_SQL}, {SCORE_SQL}, {SPREAD_SQL} SELECT s.scope, s.sensor_id, s.site_id, n, {rounds(*verify.SCORES, 'spearman')} "
    "FROM scored s JOIN rho r ON s.scope = r.scope AND s.sensor_id IS NOT DISTINCT FROM r.sensor_id AND s.site_id IS NOT DISTINCT FROM r.site_id",
)
def verify_full(spark, sf_dir):
    pairs = pixel_pairs(spark, sf_dir).withColumn("pos", F.col("site_id"))
    return rounded(verify.full_report(pairs, ["uid", "line", "part", "pos"], heavy=HEAVY), *verify.SCORES, "spearman")


@query(
    "verify_grids",
    f"WITH {RING_SQL}, pairs AS (SELECT uid, CAST(label AS BIGINT) AS site_id, sensor_id, GREATEST(p * 20, 0) AS pred, GREATEST(t * 20, 0) AS target FROM pc), "
    f"{SCORE_SQL} {SCORE_SELECT}",
)
def verify_grids(spark, sf_dir):
    """Forecast grids against truth grids, joined on the sample."""
    rate = lambda c: F.transform(c, lambda v: F.greatest(v.cast("double") * 20, F.lit(0.0)))
    base = grids(spark, sf_dir)
    pred = base.select("uid", "sensor_id", F.col("label").cast("long").alias("site_id"), rate("grid").alias("pred"))
    truth = following(base.select("uid", rate("grid").alias("rate")), "rate")
    return rounded(verify.report(verify.pair_pixels(pred, truth), heavy=HEAVY), *verify.SCORES)


@query(
    "forecast_transform",
    """WITH f AS (SELECT l_orderkey AS uid, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
         l_tax * 20 - 0.1::DOUBLE AS mean, (l_discount - 0.09::DOUBLE) * 40 AS logit, (l_discount - 0.05::DOUBLE) * 300 AS log_var FROM lineitem),
    g AS (SELECT *, CASE WHEN mean > 0 THEN EXP(mean) - 1 ELSE 0 END AS mm, 1 / (1 + EXP(-logit)) AS p FROM f)
    SELECT uid, line, part, supp, ROUND(mm, 6) AS rate, ROUND(p, 6) AS prob,
           ROUND(CASE WHEN p > 0.15::DOUBLE THEN mm ELSE 0 END, 6) AS rate_inference,
           ROUND(CASE WHEN p > 0.5::DOUBLE THEN mm ELSE 0 END, 6) AS rate_validation,
           ROUND(GREATEST(LEAST(log_var, 5), -10), 6) AS log_var FROM g""",
)
def forecast_transform(spark, sf_dir):
    mean, logit = F.col("l_tax") * 20 - 0.1, (F.col("l_discount") - 0.09) * 40
    out = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        fx.inverse_target(mean).alias("rate"), fx.sigmoid(logit).alias("prob"),
        fx.gated_rate(mean, logit, 0.15).alias("rate_inference"), fx.gated_rate(mean, logit, 0.5).alias("rate_validation"),
        fx.clamp_log_var((F.col("l_discount") - 0.05) * 300).alias("log_var"),
    )
    return rounded(out, "rate", "prob", "rate_inference", "rate_validation", "log_var")


@query("batch_rmse", f"WITH {PAIRS_SQL} SELECT uid // 64 AS batch_id, ROUND(SQRT(AVG((pred - target) * (pred - target))), 6) AS rmse FROM pairs GROUP BY 1")
def batch_rmse(spark, sf_dir):
    pairs = pixel_pairs(spark, sf_dir).withColumn("batch_id", F.floor(F.col("uid") / 64).cast("long"))
    return rounded(verify.batch_rmse(pairs, "batch_id"), "rmse")


@query(
    "ordinal_rank",
    f"WITH {PAIRS_SQL} SELECT uid, line, part, site_id, sensor_id, ROW_NUMBER() OVER (PARTITION BY sensor_id ORDER BY target, uid, line, part, site_id) - 1 AS rank FROM pairs",
)
def ordinal_rank(spark, sf_dir):
    rows = pixel_pairs(spark, sf_dir).select(*POSITION, "sensor_id", "target")
    return ordered.ordinal_rank(rows, ["sensor_id"], ["target", *POSITION]).drop("target")


@query("error_map", f"WITH {RING_SQL} SELECT uid, y, x, ROUND(p - t, 6) AS error, ROUND(ABS(p - t), 6) AS abs_error FROM pc")
def error_map(spark, sf_dir):
    rows = neighbours(spark, sf_dir)
    wide = lambda c: F.transform(c, lambda v: v.cast("double"))
    both = F.arrays_zip(
        fx.error_map(wide("pred"), wide("target")).alias("e"), fx.error_map(wide("pred"), wide("target"), True).alias("a")
    )
    out = unpack(rows, ["uid"], both, "i", "_p")
    return out.select(
        "uid", (F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"),
        F.round(F.col("_p")["e"], 6).alias("error"), F.round(F.col("_p")["a"], 6).alias("abs_error"),
    )


# ---- losses ---------------------------------------------------------------------------------------
LOSS_SQL = f"""{PAIRS_SQL}, px AS (
  SELECT uid, sensor_id, CASE WHEN o_orderstatus <> 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_data,
         pred AS mean, LN(1 + GREATEST(target, 0)) AS y, (pred - 1.5::DOUBLE) AS z, CASE WHEN target > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m,
         LEAST(GREATEST(pred - 2, -10), 5) AS lv
  FROM pairs JOIN orders ON uid = o_orderkey),
terms AS (
  SELECT *, mean - y AS d, ABS(mean - y) AS a, 1 + 3 * GREATEST(y, 0) AS w, 1 / (1 + EXP(-z)) AS p,
         GREATEST(z, 0) - z * m + LN(1 + EXP(-ABS(z))) AS bce FROM px),
samples AS (
  SELECT uid, sensor_id, has_data, AVG(w * d * d) AS mse, AVG(w * a) AS mae,
         AVG(CASE WHEN a < 1 THEN d * d / 2 ELSE a - 0.5::DOUBLE END) AS smooth_l1,
         AVG(CASE WHEN a <= 0.5::DOUBLE THEN d * d / 2 ELSE 0.5::DOUBLE * (a - 0.25::DOUBLE) END) AS huber,
         AVG(bce) AS bce, AVG(bce * POW(CASE WHEN m = 1 THEN 1 - p ELSE p END, 2)) AS focal,
         AVG(0.5::DOUBLE * (lv + d * d / EXP(lv))) AS nll,
         1 - (2 * SUM(p * m) + 1) / (SUM(p + m) + 1) AS dice
  FROM terms GROUP BY uid, sensor_id, has_data)"""
LOSS_NAMES = ("mse", "mae", "smooth_l1", "huber", "bce", "focal", "nll", "dice")


def _mask(names):
    return ", ".join(f"SUM({n} * has_data) / GREATEST(SUM(has_data), 1) AS {n}" for n in names)


def loss_pixels(spark, sf_dir):
    pairs = pixel_pairs(spark, sf_dir)
    valid = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uid"), (F.col("o_orderstatus") != "P").cast("double").alias("has_data")
    )
    pixels = pairs.select(
        "uid", "sensor_id", F.col("pred").alias("mean"), fx.log_target(F.col("target")).alias("y"),
        (F.col("pred") - 1.5).alias("rain_logit"), fx.rain_mask(F.col("target")).cast("double").alias("rain_mask"),
        fx.clamp_log_var(F.col("pred") - 2).alias("log_var"),
    )
    return pixels, valid


def _sample_terms():
    mean, y, z, m = F.col("mean"), F.col("y"), F.col("rain_logit"), F.col("rain_mask")
    weight = fx.pixel_weight(y)
    return {
        "mse": losses.squared(mean, y, weight), "mae": losses.absolute(mean, y, weight),
        "smooth_l1": losses.smooth_l1(mean, y), "huber": losses.huber(mean, y, 0.5),
        "bce": losses.logit_entropy(z, m), "focal": losses.logit_entropy(z, m, 2.0),
        "nll": losses.gaussian_nll(mean, F.col("log_var"), y),
    }


@query("loss_table", f"WITH {LOSS_SQL}, r AS (SELECT sensor_id, {_mask(LOSS_NAMES[:-1])} FROM samples GROUP BY sensor_id) SELECT sensor_id, {rounds(*LOSS_NAMES[:-1])} FROM r")
def loss_table(spark, sf_dir):
    """Samples collapse on the map side and in the grouping; validity joins what is left of them."""
    pixels, valid = loss_pixels(spark, sf_dir)
    samples = losses.sample_means(pixels, _sample_terms(), "uid", ("sensor_id",)).join(valid, "uid")
    return rounded(losses.masked_mean(samples, list(LOSS_NAMES[:-1]), "has_data", ("sensor_id",)), *LOSS_NAMES[:-1])


@query("loss_unmasked", f"WITH {LOSS_SQL}, r AS (SELECT AVG(w * d * d) AS mse, AVG(w * a) AS mae, AVG(bce) AS bce FROM terms) SELECT {rounds('mse', 'mae', 'bce')} FROM r")
def loss_unmasked(spark, sf_dir):
    pixels, _ = loss_pixels(spark, sf_dir)
    terms = {k: v for k, v in _sample_terms().items() if k in ("mse", "mae", "bce")}
    return rounded(losses.pixel_loss(pixels, terms), "mse", "mae", "bce")


@query("loss_dice", f"WITH {LOSS_SQL}, r AS (SELECT sensor_id, {_mask(['dice'])} FROM samples GROUP BY sensor_id) SELECT sensor_id, {rounds('dice')} FROM r")
def loss_dice(spark, sf_dir):
    pixels, valid = loss_pixels(spark, sf_dir)
    joined = pixels.join(valid, "uid")
    out = losses.dice(joined, fx.sigmoid(F.col("rain_logit")), F.col("rain_mask"), valid="has_data", by=("sensor_id",))
    return rounded(out, "dice")


COMPOSITE = losses.LossWeights.of(
    {"mse_weight": 1.0, "mae_weight": 0.2, "smooth_l1_weight": 0.3, "huber_weight": 0.4, "huber_delta": 0.5, "bce_weight": 0.5, "nll_weight": 0.1, "dice_weight": 0.7, "unknown_key": 1}
)
COMPOSITE_NAMES = ("mse", "mae", "smooth_l1", "huber", "bce", "nll", "dice")


@query(
    "loss_composite",
    f"""WITH {LOSS_SQL}, whole AS (
      SELECT uid, has_data, AVG(w * d * d) AS mse, AVG(w * a) AS mae,
             AVG(CASE WHEN a < 1 THEN d * d / 2 ELSE a - 0.5::DOUBLE END) AS smooth_l1,
             AVG(CASE WHEN a <= 0.5::DOUBLE THEN d * d / 2 ELSE 0.5::DOUBLE * (a - 0.25::DOUBLE) END) AS huber,
             AVG(bce) AS bce, AVG(0.5::DOUBLE * (lv + d * d / EXP(lv))) AS nll,
             1 - (2 * SUM(p * m) + 1) / (SUM(p + m) + 1) AS dice
      FROM terms GROUP BY uid, has_data),
    r AS (SELECT {_mask(COMPOSITE_NAMES)} FROM whole),
    s AS (SELECT *, mse + 0.2::DOUBLE * mae + 0.3::DOUBLE * smooth_l1 + 0.4::DOUBLE * huber + 0.5::DOUBLE * bce + 0.1::DOUBLE * nll + 0.7::DOUBLE * dice AS total FROM r)
    SELECT {rounds(*COMPOSITE_NAMES, 'total')} FROM s""",
)
def loss_composite(spark, sf_dir):
    pixels, valid = loss_pixels(spark, sf_dir)
    return rounded(losses.composite(pixels.join(valid, "uid"), COMPOSITE), *COMPOSITE_NAMES, "total")


@query(
    "loss_gradient",
    f"""WITH {RING_SQL},
    k AS (SELECT dy, dx FROM (SELECT UNNEST([-1, 0, 1]) AS dy), (SELECT UNNEST([-1, 0, 1]) AS dx)),
    g AS (SELECT c.uid, c.y, c.x, SUM(k.dx * (2 - ABS(k.dy)) * COALESCE(n.p, 0)) AS xp, SUM(k.dy * (2 - ABS(k.dx)) * COALESCE(n.p, 0)) AS yp,
                 SUM(k.dx * (2 - ABS(k.dy)) * COALESCE(n.t, 0)) AS xt, SUM(k.dy * (2 - ABS(k.dx)) * COALESCE(n.t, 0)) AS yt
          FROM pc c CROSS JOIN k LEFT JOIN pc n ON n.uid = c.uid AND n.y = c.y + k.dy AND n.x = c.x + k.dx GROUP BY ALL)
    SELECT uid, ROUND(AVG(ABS(xp - xt) + ABS(yp - yt)), 6) AS gradient FROM g GROUP BY uid""",
)
def loss_gradient(spark, sf_dir):
    return rounded(losses.grid_losses(neighbours(spark, sf_dir), GRID).select("uid", "gradient"), "gradient")


@query(
    "loss_ssim",
    f"""WITH {RING_SQL},
    b AS (SELECT c.uid, c.y, c.x, SUM(n.p) / 49 AS mp, SUM(n.t) / 49 AS mt, SUM(n.p * n.p) / 49 AS pp, SUM(n.t * n.t) / 49 AS tt, SUM(n.p * n.t) / 49 AS pt
          FROM pc c JOIN pc n ON n.uid = c.uid AND ABS(n.y - c.y) <= 3 AND ABS(n.x - c.x) <= 3 GROUP BY ALL),
    s AS (SELECT uid, (2 * mp * mt + 1e-4) * (2 * (pt - mp * mt) + 9e-4)
                 / GREATEST((mp * mp + mt * mt + 1e-4) * (pp - mp * mp + tt - mt * mt + 9e-4), 1e-8) AS q FROM b)
    SELECT uid, ROUND(AVG(1 - GREATEST(LEAST(q, 1), -1)), 6) AS ssim FROM s GROUP BY uid""",
)
def loss_ssim(spark, sf_dir):
    return rounded(losses.grid_losses(neighbours(spark, sf_dir), GRID).select("uid", "ssim"), "ssim")


STRUCTURAL = losses.LossWeights(mse_weight=1.0, mae_weight=0.2, rain_weighted=False, bce_weight=0.0, gradient_weight=0.3, ssim_weight=0.4)
STRUCTURAL_NAMES = ("mse", "mae", "gradient", "ssim")


@query(
    "loss_structural",
    f"""WITH {RING_SQL},
    k AS (SELECT dy, dx FROM (SELECT UNNEST([-1, 0, 1]) AS dy), (SELECT UNNEST([-1, 0, 1]) AS dx)),
    e AS (SELECT c.uid, c.y, c.x, SUM(k.dx * (2 - ABS(k.dy)) * COALESCE(n.p, 0)) AS xp, SUM(k.dy * (2 - ABS(k.dx)) * COALESCE(n.p, 0)) AS yp,
                 SUM(k.dx * (2 - ABS(k.dy)) * COALESCE(n.t, 0)) AS xt, SUM(k.dy * (2 - ABS(k.dx)) * COALESCE(n.t, 0)) AS yt
          FROM pc c CROSS JOIN k LEFT JOIN pc n ON n.uid = c.uid AND n.y = c.y + k.dy AND n.x = c.x + k.dx GROUP BY ALL),
    b AS (SELECT c.uid, c.y, c.x, SUM(n.p) / 49 AS mp, SUM(n.t) / 49 AS mt, SUM(n.p * n.p) / 49 AS pp, SUM(n.t * n.t) / 49 AS tt, SUM(n.p * n.t) / 49 AS pt
          FROM pc c JOIN pc n ON n.uid = c.uid AND ABS(n.y - c.y) <= 3 AND ABS(n.x - c.x) <= 3 GROUP BY ALL),
    q AS (SELECT uid, (2 * mp * mt + 1e-4) * (2 * (pt - mp * mt) + 9e-4)
                 / GREATEST((mp * mp + mt * mt + 1e-4) * (pp - mp * mp + tt - mt * mt + 9e-4), 1e-8) AS q FROM b),
    whole AS (
      SELECT uid, sensor_id, CASE WHEN uid % 4 = 0 THEN 0 ELSE 1 END AS has_data, mse, mae, gradient, ssim
      FROM (SELECT uid, ANY_VALUE(sensor_id) AS sensor_id, AVG((p - t) * (p - t)) AS mse, AVG(ABS(p - t)) AS mae FROM pc GROUP BY uid)
      JOIN (SELECT uid, AVG(ABS(xp - xt) + ABS(yp - yt)) AS gradient FROM e GROUP BY uid) USING (uid)
      JOIN (SELECT uid, AVG(1 - GREATEST(LEAST(q, 1), -1)) AS ssim FROM q GROUP BY uid) USING (uid)),
    r AS (SELECT sensor_id, {_mask(STRUCTURAL_NAMES)} FROM whole GROUP BY sensor_id),
    s AS (SELECT *, mse + 0.2::DOUBLE * mae + 0.3::DOUBLE * gradient + 0.4::DOUBLE * ssim AS total FROM r)
    SELECT sensor_id, {rounds(*STRUCTURAL_NAMES, 'total')} FROM s""",
)
def loss_structural(spark, sf_dir):
    """The composite with its gradient and SSIM terms, per sensor."""
    rows = neighbours(spark, sf_dir)
    pixels = unpack(rows.select("uid", "sensor_id", "pred", "target"), ["uid", "sensor_id"], F.arrays_zip("pred", "target"), "i", "_p")
    pixels = pixels.select(
        "uid", "sensor_id", F.col("_p")["pred"].cast("double").alias("mean"), F.col("_p")["target"].cast("double").alias("y"),
        F.when(F.col("uid") % 4 == 0, 0.0).otherwise(1.0).alias("has_data"),
    )
    out = losses.composite(pixels, STRUCTURAL, by=("sensor_id",), grids=rows.select("uid", "pred", "target"), shape=GRID)
    return rounded(out, *STRUCTURAL_NAMES, "total")


# ---- ensemble -------------------------------------------------------------------------------------
RUNS = {"a": 1.0, "b": 2.0}  # run c is not listed and counts 1
RUNS_SQL = f"""{PAIRS_SQL}, runs AS (
  SELECT 'a' AS run, uid, line, part, site_id, pred AS rate FROM pairs
  UNION ALL SELECT 'b', uid, line, part, site_id, pred * 1.1::DOUBLE FROM pairs
  UNION ALL SELECT 'c', uid, line, part, site_id, target * 30 FROM pairs)"""


def run_rows(spark, sf_dir):
    pairs = pixel_pairs(spark, sf_dir)
    runs = F.array(
        F.struct(F.lit("a").alias("run"), F.col("pred").alias("rate")),
        F.struct(F.lit("b").alias("run"), (F.col("pred") * 1.1).alias("rate")),
        F.struct(F.lit("c").alias("run"), (F.col("target") * 30).alias("rate")),
    )
    return pairs.select(*POSITION, F.explode(runs).alias("_r")).select(*POSITION, "_r.*")


@query(
    "ensemble_mean",
    f"""WITH {RUNS_SQL}, one AS (SELECT uid, line, part, site_id, run, MAX(rate) AS rate FROM runs GROUP BY ALL), m AS (
      SELECT uid, line, part, site_id, SUM(CASE run WHEN 'b' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END * rate) AS v FROM one GROUP BY ALL),
    c AS (SELECT uid, line, part, site_id, LEAST(GREATEST(v, 0), 60) AS v FROM m)
    SELECT uid, line, part, site_id, ROUND(CASE WHEN v < 0.15::DOUBLE THEN 0 ELSE v END, 6) AS rate FROM c""",
)
def ensemble_mean(spark, sf_dir):
    """A few line items share their position: of these the largest rate counts, as a run has one value per pixel."""
    weights = ensemble.run_weights(["a", "b", "c"], RUNS)
    # both groupings need a pixel's rows together: moved once, by pixel
    rows = run_rows(spark, sf_dir).repartition(*POSITION).groupBy(*POSITION, "run").agg(F.max("rate").alias("rate"))
    return rounded(ensemble.combine_pixels(rows, POSITION, weights), "rate")


@query(
    "ensemble_grids",
    f"""WITH {GRIDS_SQL}, r AS (
      SELECT uid, i, GREATEST(v * 200, 0) AS a, GREATEST(v * 100, 0) AS b, CASE WHEN y < 4 THEN 10.0::DOUBLE ELSE 0.1::DOUBLE END AS c FROM cells),
    m AS (SELECT uid, i, LEAST(GREATEST(0.25::DOUBLE * a + 0.5::DOUBLE * b + 0.25::DOUBLE * c, 0), 60) AS v FROM r)
    SELECT uid, CAST(i AS INTEGER) AS i, ROUND(CAST(CAST(CASE WHEN v < 0.15::DOUBLE THEN 0 ELSE v END AS FLOAT) AS DOUBLE), 4) AS rate FROM m""",
)
def ensemble_grids(spark, sf_dir):
    base = grids(spark, sf_dir)
    step = F.transform("grid", lambda v, i: F.when(i < 32, 10.0).otherwise(0.1))
    scaled = lambda k: F.transform("grid", lambda v: F.greatest(v.cast("double") * k, F.lit(0.0)))
    runs = F.array(
        F.struct(F.lit("a").alias("run"), scaled(200).alias("rate")), F.struct(F.lit("b").alias("run"), scaled(100).alias("rate")),
        F.struct(F.lit("c").alias("run"), step.alias("rate")),
    )
    rows = base.select(F.col("uid").alias("filename"), F.explode(runs).alias("_r")).select("filename", "_r.*")
    out = ensemble.combine_grids(rows, ensemble.run_weights(["a", "b", "c"], RUNS))
    long = unpack(out, ["filename"], "rate", "i", "rate")
    return long.select(F.col("filename").alias("uid"), "i", F.round(F.col("rate").cast("double"), 4).alias("rate"))


COVER_SQL = """files AS (
  SELECT 'a' AS run, l_orderkey AS filename FROM lineitem UNION ALL
  SELECT 'b', l_orderkey FROM lineitem WHERE l_linenumber > 1 UNION ALL
  SELECT 'c', l_orderkey FROM lineitem WHERE l_discount > 0.02::DOUBLE)"""


@query("ensemble_coverage", f"WITH {COVER_SQL}, u AS (SELECT DISTINCT run, filename FROM files), c AS (SELECT filename, COUNT(*) AS n_runs FROM u GROUP BY 1) SELECT filename, n_runs FROM c WHERE n_runs <> 3")
def ensemble_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    flags = F.array(
        F.lit("a"), F.when(F.col("l_linenumber") > 1, "b"), F.when(F.col("l_discount") > 0.02, "c")
    )
    files = items.select(F.col("l_orderkey").alias("filename"), F.explode(F.array_compact(flags)).alias("run")).distinct()
    return ensemble.coverage_gaps(files, 3).select("filename", "n_runs")
