"""Weights, draws, shuffles and batches."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import manifest as mf, sampling, stats, verify
from gridcast.plans.manifests import manifest
from gridcast.plans.registry import query, rounded
from gridcast.plans.views import GRIDS_SQL, MANIFEST_SQL, PAIRS_SQL, grids, pixel_pairs

RATE_SQL = "GREATEST(v * 10, 0)"


def _rates(spark, sf_dir):
    rate = F.transform("grid", lambda v: F.greatest(v.cast("double") * 10, F.lit(0.0)))
    return grids(spark, sf_dir).select("uid", rate.alias("target"))


@query("scene_weight", f"WITH {GRIDS_SQL} SELECT uid, ROUND(1 + 3 * LN(1 + MAX({RATE_SQL})), 6) AS weight FROM cells GROUP BY uid")
def scene_weight(spark, sf_dir):
    return rounded(sampling.scene_weights(_rates(spark, sf_dir)), "weight")


@query("scene_max", f"WITH {PAIRS_SQL} SELECT uid, MAX(target) AS scene_max FROM pairs GROUP BY uid")
def scene_max(spark, sf_dir):
    return pixel_pairs(spark, sf_dir).groupBy("uid").agg(F.max("target").alias("scene_max"))


@query(
    "pixel_weight",
    f"WITH {PAIRS_SQL} SELECT uid, line, part, site_id, ROUND(1 + 3 * GREATEST(LN(1 + target), 0), 6) AS weight FROM pairs",
)
def pixel_weight(spark, sf_dir):
    from gridcast.functions import columns as fx

    return pixel_pairs(spark, sf_dir).select(
        "uid", "line", "part", "site_id", F.round(fx.pixel_weight(fx.log_target(F.col("target"))), 6).alias("weight")
    )


@query(
    "weighted_draws",
    f"""WITH {GRIDS_SQL}, w AS (SELECT uid, 1 + 3 * LN(1 + MAX({RATE_SQL})) AS weight FROM cells GROUP BY uid),
    q AS (SELECT uid, weight, GREATEST(CAST(FLOOR(weight / (SELECT MAX(weight) FROM w) * 1073741824) AS BIGINT), 1) AS q FROM w),
    c AS (SELECT uid, weight, CAST(SUM(q) OVER (ORDER BY uid) AS BIGINT) - q AS lo, CAST(SUM(q) OVER (ORDER BY uid) AS BIGINT) AS hi, CAST(SUM(q) OVER () AS BIGINT) AS total FROM q),
    p AS (SELECT CAST('0x' || SUBSTR(MD5('11:draw:' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % (SELECT MAX(total) FROM c) AS spot FROM (SELECT UNNEST(range((SELECT COUNT(*) FROM grids))) AS i))
    SELECT uid, ROUND(weight, 6) AS weight, COUNT(*) AS draws FROM c JOIN p ON spot >= lo AND spot < hi GROUP BY uid, weight""",
)
def weighted_draws(spark, sf_dir):
    """As many draws as samples, with replacement."""
    rows = _rates(spark, sf_dir)
    return rounded(sampling.weighted_draws(sampling.scene_weights(rows), rows.count(), seed=11), "weight")


@query("weighted_draw_count", f"WITH {GRIDS_SQL} SELECT COUNT(*) AS n_draws, TRUE AS all_known FROM grids")
def weighted_draw_count(spark, sf_dir):
    """The draws add up exactly and name samples only."""
    rows = _rates(spark, sf_dir)
    drawn = sampling.expand_draws(sampling.weighted_draws(sampling.scene_weights(rows), rows.count(), seed=11))
    known = drawn.join(rows.select("uid", F.lit(True).alias("_known")), "uid", "left")
    return known.agg(F.count(F.lit(1)).alias("n_draws"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("all_known"))


@query(
    "sample_files",
    f"""WITH {MANIFEST_SQL}, d AS (SELECT uid, sensor, t, filename, MD5('5:' || sensor || ':' || filename || ':' || uid || ':' || CAST(t AS VARCHAR)) AS h FROM slots WHERE filename IS NOT NULL)
    SELECT uid, sensor, t, filename FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sensor ORDER BY h, uid, t) AS rn FROM d) WHERE rn <= 500""",
)
def sample_files(spark, sf_dir):
    return stats.sample_files(mf.explode_slots(manifest(spark, sf_dir)), 500, seed=5).select("uid", "sensor", "t", "filename")


@query("shuffle", f"WITH {MANIFEST_SQL} SELECT uid, ROW_NUMBER() OVER (ORDER BY MD5('9:' || uid), uid) - 1 AS position FROM manifest")
def shuffle(spark, sf_dir):
    return sampling.shuffled_positions(manifest(spark, sf_dir).select("uid"), 9, ["uid"])


@query("sequential", f"WITH {MANIFEST_SQL} SELECT uid, row_idx FROM manifest ORDER BY row_idx")
def sequential(spark, sf_dir):
    return sampling.ordered_rows(manifest(spark, sf_dir).select("uid", "row_idx"), "sequential", key=["row_idx"])


@query("batches", f"WITH {MANIFEST_SQL}, p AS (SELECT uid, ROW_NUMBER() OVER (ORDER BY row_idx) - 1 AS i, COUNT(*) OVER () AS n FROM manifest) SELECT uid, i // 64 AS batch_id FROM p WHERE i < n - n % 64")
def batches(spark, sf_dir):
    rows = manifest(spark, sf_dir).select("uid", "row_idx")
    return sampling.batches(rows, ["row_idx"], 64, drop_last=True).drop("row_idx")


@query("audit_sample", f"WITH {MANIFEST_SQL} SELECT target_file AS filename FROM manifest WHERE target_file IS NOT NULL ORDER BY MD5('0:' || target_file), target_file LIMIT 25")
def audit_sample(spark, sf_dir):
    outputs = manifest(spark, sf_dir).where(F.col("target_file").isNotNull()).select(F.col("target_file").alias("filename"))
    return sampling.audit_sample(outputs, 25)


@query(
    "verify_spearman_by_sensor",
    f"""WITH {PAIRS_SQL}, r AS (SELECT sensor_id, CAST(ROW_NUMBER() OVER (PARTITION BY sensor_id ORDER BY pred, uid, line, part, site_id) AS DOUBLE) AS rp,
                 CAST(ROW_NUMBER() OVER (PARTITION BY sensor_id ORDER BY target, uid, line, part, site_id) AS DOUBLE) AS rt FROM pairs)
    SELECT sensor_id, ROUND(COVAR_POP(rp, rt) / SQRT(VAR_POP(rp) * VAR_POP(rt)), 6) AS spearman FROM r GROUP BY 1""",
)
def verify_spearman_by_sensor(spark, sf_dir):
    """The rank correlation per sensor, over all its pairs."""
    out = verify.rank_correlation(pixel_pairs(spark, sf_dir), ["sensor_id"], ["uid", "line", "part", "site_id"])
    return rounded(out, "spearman")
