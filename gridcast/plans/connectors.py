"""The archive data source, the committed raster sink, the ensemble from folders to a folder, and feature records with a
transform step."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.rows import unpack
from gridcast.operators import augment, ensemble, features as ft
from gridcast.plans.registry import SQL, query
from gridcast.plans.storage import FILES_SQL, FRAMES_SQL, PREDICTED_SQL, SIZES, TARGET, _frame_rows, archive_folder, built_store, norm_stats_of, predictions
from gridcast.scratch import scratch_path
from gridcast.sources import rasters, store
from gridcast.sources.archive_source import read_archives
from gridcast.sources.raster_writer import save_predictions

RUNS = {"first": 1.0, "second": 2.0, "third": 0.5}  # factors of the forecast
WEIGHTS = {"third": 2.0}


def _times(factor: float):
    return lambda v: (v.cast("double") * factor).cast("float")


def _totals(rows):
    return rows.select("filename", F.round(F.aggregate("rate", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("archive_source", FRAMES_SQL)
def archive_source(spark, sf_dir):
    """Frames from archives through the data source; the filter on the name is pushed into the reader."""
    members = read_archives(spark, archive_folder(spark, sf_dir), range_bytes=1 << 20).where(F.col("filename").startswith("f_"))
    return _frame_rows(rasters.decode_frames(members, SIZES))


@query("archive_source_sensor", f"WITH {FILES_SQL} SELECT sensor, COUNT(*) AS n, COUNT(*) FILTER (WHERE error IS NULL) AS n_good FROM frame_files WHERE sensor IN ('goes', 'meteosat') GROUP BY 1")
def archive_source_sensor(spark, sf_dir):
    """Two sensors of the archives."""
    members = read_archives(spark, archive_folder(spark, sf_dir)).where(F.col("sensor").isin("goes", "meteosat"))
    frames = rasters.decode_frames(members, SIZES)
    return frames.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("n_good"))


@query("predictions_committed", PREDICTED_SQL)
def predictions_committed(spark, sf_dir):
    """One raster per manifest row, all moved into place at the end, read back."""
    path = scratch_path(spark, "committed")
    preds, names = predictions(spark, sf_dir)
    save_predictions(preds, names, path, TARGET)
    return _totals(rasters.read_targets(spark, path, TARGET))


@query(
    "ensemble_runs",
    f"""WITH {FILES_SQL}, m AS (SELECT uid, LEAST(0.25 * r + 0.25 * CAST(CAST(r * 2 AS FLOAT) AS DOUBLE) + 0.5 * CAST(CAST(r * 0.5 AS FLOAT) AS DOUBLE), 60) AS m FROM tq)
    SELECT 'p_' || CAST(uid AS VARCHAR) || '.tif' AS filename, ROUND(SUM(CASE WHEN m < 0.15 THEN 0 ELSE CAST(CAST(m AS FLOAT) AS DOUBLE) END), 4) AS total FROM m GROUP BY uid""",
)
def ensemble_runs(spark, sf_dir):
    """Three run folders to one folder."""
    root = scratch_path(spark, "runs")
    preds, names = predictions(spark, sf_dir)
    for run, factor in RUNS.items():
        scaled = preds.select("uid", F.transform("rate", _times(factor)).alias("rate"))
        save_predictions(scaled, names, f"{root}/{run}", TARGET)
    ensemble.combine_runs(spark, {r: f"{root}/{r}" for r in RUNS}, f"{root}/mean", WEIGHTS, TARGET)
    return _totals(rasters.read_targets(spark, f"{root}/mean", TARGET))


def _draw_sql(op: str) -> str:
    return f"CAST('0x' || SUBSTR(MD5('7:{op}:' || uid), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(
    "feature_augmented",
    f"""WITH plain AS ({SQL["feature_records"]}),
    profiles AS (SELECT * FROM (VALUES ('none', 0.0::DOUBLE), ('base', 0.5::DOUBLE), ('full', 0.5::DOUBLE)) p(profile, p)),
    d AS (SELECT profile, uid, {_draw_sql('flip_x')} < p AS fx, {_draw_sql('flip_y')} < p AS fy,
        CASE WHEN {_draw_sql('rotate')} < p THEN CAST(FLOOR({_draw_sql('turns')} * 3) AS INTEGER) + 1 ELSE 0 END AS k
      FROM (SELECT DISTINCT uid FROM plain), profiles),
    f AS (SELECT profile, r.uid, pos // 4 AS c, k, value, CASE WHEN fy THEN 1 - pos % 4 // 2 ELSE pos % 4 // 2 END AS y, CASE WHEN fx THEN 1 - pos % 2 ELSE pos % 2 END AS x
      FROM plain r JOIN d ON d.uid = r.uid)
    SELECT profile, uid, CAST(c * 4 + 2 * CASE k WHEN 0 THEN y WHEN 1 THEN 1 - x WHEN 2 THEN 1 - y ELSE x END + CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 1 - x ELSE 1 - y END AS INTEGER) AS pos, value
    FROM f""",
)
def feature_augmented(spark, sf_dir):
    """Records under the profiles none, base and full: features and raw target turned inside the record's own pass."""
    known, config = norm_stats_of(spark, sf_dir), ft.FeatureConfig(image_size=2, sizes=SIZES)
    samples, out = store.read_store(spark, built_store(spark, sf_dir)), None
    for name in ("none", "base", "full"):
        step = augment.transform_of(augment.PROFILES[name], 7)
        rows = ft.feature_records(samples, known, config, transform=step, target_size=TARGET).select(F.lit(name).alias("profile"), "uid", "features")
        out = rows if out is None else out.unionByName(rows)
    return unpack(out, ["profile", "uid"], "features", "pos", "value").withColumn("value", F.round(F.col("value").cast("double"), 3))
