"""Rasters, archives, the sample store, statistics files, predictions, streams.

Rasters are written by Spark from the embeddings: 64 values are 16 bands of 2x2 pixels or one 8x8 target.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridcast import dims
from gridcast.functions import columns as fx
from gridcast.functions.rows import unpack
from gridcast.operators import ensemble, features as ft, sampling, stats
from gridcast.plans.registry import query, rounded, rounds
from gridcast.plans.verification import HEAVY, SCORE_SELECT, SCORE_SQL
from gridcast.plans.views import GRIDS_SQL, PAIRS_SQL, SCALE, grids, pixel_pairs, sensor_of, table
from gridcast.operators import verify
from gridcast.scratch import BUILT, materialise, scratch_path
from gridcast.sources import archive, norm_stats, rasters, store
from gridcast.streaming import ingest, verification as live

SIZES = {s: (2, 2) for s in dims.SENSORS}
TARGET = (8, 8)

FILES_SQL = f"""{GRIDS_SQL},
q AS (SELECT uid, i, CAST(LEAST(GREATEST(FLOOR((v + 0.5::DOUBLE) * 255), 0), 255) AS INTEGER) AS q FROM cells),
frame_files AS (
  SELECT uid, CASE uid % 3 WHEN 0 THEN 'himawari' WHEN 1 THEN 'goes' ELSE 'meteosat' END AS sensor, 'f_' || CAST(uid AS VARCHAR) || '.tif' AS filename,
         CASE WHEN uid % 17 = 0 THEN 'RasterError: not a TIFF file' WHEN uid % 19 = 0 THEN 'RasterError: expected 16 bands, got 4' END AS error FROM grids),
target_files AS (
  SELECT uid, 't_' || CAST(uid AS VARCHAR) || '.tif' AS filename, CASE WHEN uid % 11 = 0 THEN 'RasterError: non-finite values' END AS error FROM grids),
tq AS (SELECT uid, i, CAST(CAST(GREATEST(v * 10, 0) AS FLOAT) AS DOUBLE) AS r FROM cells)"""


def quantised(grid) -> F.col:
    level = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")
    return F.transform(grid, level)


def raster_folder(spark, sf_dir) -> str:
    """Write every raster once per application and return the root."""
    key = (spark.sparkContext.applicationId, sf_dir, "folder")
    if key not in BUILT:
        root = scratch_path(spark, "rasters")
        rows = grids(spark, sf_dir)
        uid = F.col("uid")
        junk = F.lit("not a raster").cast("binary")
        level = quantised(F.col("grid"))
        frame = (
            F.when(uid % 17 == 0, junk)
            .when(uid % 19 == 0, rasters.encode_column((4, 4), "uint8", 4)(level))
            .otherwise(rasters.encode_column((2, 2), "uint8", 16)(level))
        )
        name = F.concat(sensor_of(uid % 3), F.lit("/f_"), uid.cast("string"), F.lit(".tif"))
        frames = rows.select(name.alias("filename"), frame.alias("content"))
        rate = F.transform("grid", lambda v, i: F.when((uid % 11 == 0) & (i == 0), F.lit(float("nan"))).otherwise(F.greatest(v.cast("double") * 10, F.lit(0.0))))
        target_name = F.concat(F.lit(f"{dims.TARGET_SUBDIR}/t_"), uid.cast("string"), F.lit(".tif"))
        targets = rows.select(target_name.alias("filename"), rasters.encode_column(TARGET)(rate).alias("content"))
        rasters.write_files(frames.unionByName(targets), root)
        BUILT[key] = root
    return BUILT[key]


def frame_folders(spark, sf_dir) -> list[str]:
    root = raster_folder(spark, sf_dir)
    return [f"{root}/{s}" for s in dims.SENSORS]


def archive_folder(spark, sf_dir) -> str:
    """The same rasters in ZIP archives, one per task, some members deflated, some present twice."""
    key = (spark.sparkContext.applicationId, sf_dir, "archives")
    if key not in BUILT:
        root = scratch_path(spark, "archives")
        files = rasters.binary_files(spark, raster_folder(spark, sf_dir)).select("filename", "sensor", "content")

        def pack(batches):
            import io
            import zipfile

            from pyspark import TaskContext

            from gridcast.sources.files import write_atomic

            body = io.BytesIO()
            with zipfile.ZipFile(body, "w") as z:
                z.writestr("train_dataset.csv", "a file at the top level is no raster")
                z.writestr("train_dataset/", b"")
                n = 0
                for batch in batches:
                    for name, sensor, content in zip(*(batch[c].to_pylist() for c in ("filename", "sensor", "content"))):
                        if n % 5 == 0:
                            z.writestr(f"train_dataset/{sensor}/old/{name}", b"an earlier member of the same name")
                        z.writestr(f"train_dataset/{sensor}/{name}", content, zipfile.ZIP_DEFLATED if n % 2 else zipfile.ZIP_STORED)
                        n += 1
            write_atomic(f"{root}/part-{TaskContext.get().partitionId()}.zip", body.getvalue())
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32())})

        # an archive is packed in memory: as many archives as rasters ask for
        n = max(4, -(-grids(spark, sf_dir).count() // 5000))
        materialise(files.repartition(n, "filename").mapInArrow(pack, "n int"), "packed")
        BUILT[key] = root
    return BUILT[key]


# ---- readers --------------------------------------------------------------------------------------
FRAMES_SQL = f"""WITH {FILES_SQL}, s AS (SELECT uid, SUM(q) AS total FROM q GROUP BY 1)
SELECT filename, sensor, CASE WHEN error IS NULL THEN 2 END AS height, CASE WHEN error IS NULL THEN 2 END AS width, CASE WHEN error IS NULL THEN 16 END AS n_bands,
       CASE WHEN error IS NULL THEN CAST(total AS BIGINT) END AS total, error FROM frame_files f JOIN s ON f.uid = s.uid"""


def _frame_rows(frames):
    sums = stats.sums_column()("pixels", "n_bands", "height", "width")
    total = F.aggregate(sums, F.lit(0).cast("long"), lambda a, s: a + s["s"])
    return frames.select("filename", "sensor", "height", "width", "n_bands", total.alias("total"), "error")


@query("frames_read", FRAMES_SQL)
def frames_read(spark, sf_dir):
    return _frame_rows(rasters.read_frames(spark, frame_folders(spark, sf_dir), SIZES))


@query("frames_from_archives", FRAMES_SQL)
def frames_from_archives(spark, sf_dir):
    index = archive.archive_index(spark, archive_folder(spark, sf_dir)).where(F.col("filename").startswith("f_"))
    return _frame_rows(rasters.decode_frames(archive.read_members(index), SIZES))


@query(
    "targets_read",
    f"WITH {FILES_SQL}, s AS (SELECT uid, SUM(r) AS total, MAX(r) AS top FROM tq GROUP BY 1) "
    "SELECT filename, CASE WHEN error IS NULL THEN ROUND(total, 4) END AS total, CASE WHEN error IS NULL THEN ROUND(top, 5) END AS top, error FROM target_files f JOIN s ON f.uid = s.uid",
)
def targets_read(spark, sf_dir):
    rows = rasters.read_targets(spark, f"{raster_folder(spark, sf_dir)}/{dims.TARGET_SUBDIR}", TARGET)
    total = F.aggregate("rate", F.lit(0.0), lambda a, v: a + v)
    return rows.select("filename", F.round(total, 4).alias("total"), F.round(F.array_max("rate").cast("double"), 5).alias("top"), "error")


@query("root_glob", f"WITH {FILES_SQL} SELECT COUNT(*) AS n_targets, COUNT(*) FILTER (WHERE error IS NOT NULL) AS n_bad FROM target_files")
def root_glob(spark, sf_dir):
    """The target folder found by a prefix."""
    rows = rasters.read_targets(spark, f"{raster_folder(spark, sf_dir)}/gpm*", TARGET)
    return rows.agg(F.count(F.lit(1)).alias("n_targets"), F.count("error").alias("n_bad"))


@query(
    "raster_headers",
    f"""WITH {FILES_SQL} SELECT filename, sensor, CASE WHEN uid % 17 = 0 THEN NULL WHEN uid % 19 = 0 THEN 4 ELSE 2 END AS height,
    CASE WHEN uid % 17 = 0 THEN NULL WHEN uid % 19 = 0 THEN 4 ELSE 16 END AS n_bands, CASE WHEN uid % 17 <> 0 THEN 'uint8' END AS dtype,
    CASE WHEN uid % 17 = 0 THEN error WHEN uid % 19 = 0 THEN 'expected size (2, 2), got (4, 4)' END AS error FROM frame_files""",
)
def raster_headers(spark, sf_dir):
    files = rasters.binary_files(spark, frame_folders(spark, sf_dir))
    return rasters.read_headers(files, SIZES).select("filename", "sensor", "height", "n_bands", "dtype", "error")


@query("contract_violations", f"WITH {FILES_SQL} SELECT sensor, error AS violation, COUNT(*) AS n FROM frame_files WHERE error IS NOT NULL GROUP BY 1, 2")
def contract_violations(spark, sf_dir):
    frames = rasters.read_frames(spark, frame_folders(spark, sf_dir), SIZES)
    return frames.where(F.col("error").isNotNull()).groupBy("sensor", F.col("error").alias("violation")).agg(F.count(F.lit(1)).alias("n"))


# ---- statistics -----------------------------------------------------------------------------------
FRAME_STATS_SQL = f"""{FILES_SQL},
frame_stats AS (SELECT sensor, CAST(i // 4 AS INTEGER) AS band, AVG(q) AS mean, CASE WHEN STDDEV_POP(q) <= 1e-6 THEN 1 ELSE STDDEV_POP(q) END AS std, COUNT(*) AS n_pixels
  FROM q JOIN frame_files f ON q.uid = f.uid WHERE error IS NULL GROUP BY 1, 2)"""


def _measured(spark, sf_dir):
    return stats.frame_stats(rasters.read_frames(spark, frame_folders(spark, sf_dir), SIZES))


@query("frame_stats", f"WITH {FRAME_STATS_SQL} SELECT sensor, band, n_pixels, {rounds('mean', 'std')} FROM frame_stats")
def frame_stats(spark, sf_dir):
    return rounded(_measured(spark, sf_dir), "mean", "std")


@query("norm_stats_json", f"WITH {FRAME_STATS_SQL} SELECT sensor, band, n_pixels, {rounds('mean', 'std')} FROM frame_stats")
def norm_stats_json(spark, sf_dir):
    path = scratch_path(spark, "norm")
    norm_stats.write_norm_stats(_measured(spark, sf_dir), path)
    return rounded(norm_stats.read_norm_stats(spark, path), "mean", "std")


ALL_STATS_SQL = f"""WITH {FRAME_STATS_SQL},
listed AS (SELECT CASE g.uid % 3 WHEN 0 THEN 'himawari' WHEN 1 THEN 'goes' ELSE 'meteosat' END AS sensor, g.uid + 3 * t AS file_uid
  FROM grids g, (SELECT UNNEST(range(3)) AS t) WHERE t < g.uid % 4),
good AS (SELECT l.sensor, l.file_uid FROM listed l JOIN frame_files f ON f.uid = l.file_uid WHERE f.error IS NULL)
SELECT sensor, CAST(i // 4 AS INTEGER) AS band, COUNT(*) AS n_pixels, ROUND(AVG(q), 6) AS mean, ROUND(STDDEV_POP(q), 6) AS std FROM good JOIN q ON q.uid = file_uid GROUP BY 1, 2"""


@query("norm_stats_all", ALL_STATS_SQL)
def norm_stats_all(spark, sf_dir):
    """Every listed frame, every pixel."""
    return rounded(norm_stats.from_folders(_listed(spark, sf_dir), raster_folder(spark, sf_dir), sizes=SIZES), "mean", "std")


SAMPLED_STATS_SQL = f"""WITH {FILES_SQL},
listed AS (
  SELECT CAST(g.uid AS VARCHAR) AS uid, CASE g.uid % 3 WHEN 0 THEN 'himawari' WHEN 1 THEN 'goes' ELSE 'meteosat' END AS sensor, CAST(t AS INTEGER) AS t,
         g.uid + 3 * t AS file_uid, 'f_' || CAST(g.uid + 3 * t AS VARCHAR) || '.tif' AS filename FROM grids g, (SELECT UNNEST(range(3)) AS t) WHERE t < g.uid % 4 {{present}}),
drawn AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sensor ORDER BY MD5('2:' || sensor || ':' || filename || ':' || uid || ':' || CAST(t AS VARCHAR)), uid, t) AS rn FROM listed) WHERE rn <= 40),
good AS (SELECT d.sensor, d.file_uid FROM drawn d JOIN frame_files f ON f.uid = d.file_uid WHERE f.error IS NULL)
SELECT sensor, CAST(i // 4 AS INTEGER) AS band, COUNT(*) AS n_pixels, ROUND(AVG(q), 6) AS mean, ROUND(STDDEV_POP(q), 6) AS std FROM good JOIN q ON q.uid = file_uid GROUP BY 1, 2"""


def _listed(spark, sf_dir):
    rows = store_manifest(spark, sf_dir)
    return unpack(rows, ["uid", "sensor"], "slots", "t", "filename")


@query("norm_stats_sampled", SAMPLED_STATS_SQL.format(present=""))
def norm_stats_sampled(spark, sf_dir):
    """40 drawn listings per sensor; only those files are opened."""
    found = norm_stats.from_folders(_listed(spark, sf_dir), raster_folder(spark, sf_dir), 40, 1, 2, SIZES)
    return rounded(found, "mean", "std")


@query("norm_stats_archives", SAMPLED_STATS_SQL.format(present="AND g.uid + 3 * t IN (SELECT uid FROM frame_files)"))
def norm_stats_archives(spark, sf_dir):
    """The same from archives, where names without a member are no candidates."""
    index = materialise(archive.archive_index(spark, archive_folder(spark, sf_dir)), "index")
    return rounded(norm_stats.from_archives(_listed(spark, sf_dir), index, 40, 1, 2, SIZES), "mean", "std")


# ---- the sample store -----------------------------------------------------------------------------
STORE_SQL = f"""{FRAME_STATS_SQL}, samples AS (
  SELECT uid, CASE uid % 3 WHEN 0 THEN 'himawari' WHEN 1 THEN 'goes' ELSE 'meteosat' END AS sensor, CASE uid % 3 WHEN 2 THEN 8 ELSE 6 END AS split,
         uid % 4 AS n_frames, uid % 7 <> 0 AS has_target FROM grids),
slots AS (
  SELECT s.uid, s.sensor, s.split, CAST(t AS INTEGER) AS t, s.uid + 3 * t AS file_uid,
         CASE WHEN t >= n_frames THEN 'missing' WHEN f.uid IS NULL OR f.error IS NOT NULL THEN 'corrupt' ELSE 'ok' END AS outcome
  FROM samples s CROSS JOIN (SELECT UNNEST(range(3)) AS t) LEFT JOIN frame_files f ON f.uid = s.uid + 3 * t),
slot_sums AS (
  SELECT s.uid, s.t, s.outcome, CASE WHEN outcome = 'ok' THEN (SELECT SUM(q) FROM q WHERE q.uid = s.file_uid AND i // 4 >= s.split) ELSE 0 END AS total FROM slots s),
target_sums AS (
  SELECT s.uid, has_target AND uid % 11 = 0 AS target_missing,
         CASE WHEN has_target AND uid % 11 <> 0 THEN (SELECT SUM(r) FROM tq WHERE tq.uid = s.uid) ELSE 0 END AS target_total FROM samples s)"""
STORE_ROWS_SQL = f"""WITH {STORE_SQL} SELECT CAST(t.uid AS VARCHAR) AS uid, s.sensor, p.t, p.outcome, CAST(p.total AS BIGINT) AS total, t.target_missing, ROUND(t.target_total, 4) AS target_total
FROM target_sums t JOIN slot_sums p ON p.uid = t.uid JOIN samples s ON s.uid = t.uid"""


def store_manifest(spark, sf_dir):
    """One sample per embedding: up to three frames of its sensor, some names without a file."""
    uid = F.col("uid")
    names = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: F.when(t < uid % 4, F.concat(F.lit("f_"), (uid + t * 3).cast("string"), F.lit(".tif"))))
    return grids(spark, sf_dir).select(
        uid.alias("row_idx"), uid.cast("string").alias("uid"), F.concat(F.lit("site-"), F.col("label").cast("string")).alias("site"),
        sensor_of(uid % 3).alias("sensor"), F.to_timestamp_ntz(F.lit("2024-01-01 06:30:00")).alias("ts"), names.alias("slots"),
        F.when(uid % 7 != 0, F.concat(F.lit("t_"), uid.cast("string"), F.lit(".tif"))).alias("target_file"),
    )


def built_store(spark, sf_dir) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, "store")
    if key not in BUILT:
        path = scratch_path(spark, "store")
        store.build_from_folders(store_manifest(spark, sf_dir), raster_folder(spark, sf_dir), path, "ir_only", sizes=SIZES, target_size=TARGET)
        BUILT[key] = path
    return BUILT[key]


def pixel_totals():
    """Arrow function BINARY -> the sum of its bytes."""

    @F.arrow_udf("bigint")
    def run(pixels: pa.Array) -> pa.Array:
        return pa.array([int(np.frombuffer(p.as_buffer(), np.uint8).sum(dtype=np.int64)) for p in pixels], pa.int64())

    return run


def _store_rows(rows):
    target = F.aggregate("target", F.lit(0.0), lambda a, v: a + v)
    slots = rows.select("uid", "sensor", "target_missing", F.round(target, 4).alias("target_total"), F.explode("frames").alias("_f"))
    return slots.select("uid", "sensor", F.col("_f.t").alias("t"), F.col("_f.outcome").alias("outcome"), pixel_totals()("_f.pixels").alias("total"), "target_missing", "target_total")


@query("store_from_folders", STORE_ROWS_SQL)
def store_from_folders(spark, sf_dir):
    """Built from rasters in folders, read back."""
    path = scratch_path(spark, "store")
    store.build_from_folders(store_manifest(spark, sf_dir), raster_folder(spark, sf_dir), path, "ir_only", sizes=SIZES, target_size=TARGET)
    return _store_rows(store.read_store(spark, path))


@query("store_from_archives", STORE_ROWS_SQL)
def store_from_archives(spark, sf_dir):
    """Built from archives: only names and offsets are joined."""
    path = scratch_path(spark, "store")
    index = materialise(archive.archive_index(spark, archive_folder(spark, sf_dir)), "index")
    store.build_from_archives(store_manifest(spark, sf_dir), index, path, "ir_only", sizes=SIZES, target_size=TARGET)
    return _store_rows(store.read_store(spark, path))


@query("store_without_targets", f"WITH {STORE_SQL} SELECT sensor, COUNT(*) AS n, 0.0::DOUBLE AS target_total, 0::BIGINT AS targets_missing FROM samples GROUP BY 1")
def store_without_targets(spark, sf_dir):
    """Evaluation builds carry zero targets."""
    located = store.locate_in_folders(store_manifest(spark, sf_dir), raster_folder(spark, sf_dir), load_targets=False)
    rows = store.load_samples(located, "ir_only", sizes=SIZES, target_size=TARGET)
    total = F.aggregate("target", F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("target_total"), F.count_if("target_missing").alias("targets_missing"))


@query("store_read", STORE_ROWS_SQL + " WHERE s.sensor = 'goes' AND t.uid IN (SELECT l_orderkey FROM lineitem)")
def store_read(spark, sf_dir):
    """One sensor's partition, wanted ids only."""
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("uid"))
    return _store_rows(store.read_store(spark, built_store(spark, sf_dir), "goes", wanted))


@query(
    "store_counters",
    f"""WITH {STORE_SQL}, o AS (SELECT s.sensor, COUNT(*) FILTER (WHERE p.outcome = 'missing') AS missing, COUNT(*) FILTER (WHERE p.outcome = 'corrupt') AS corrupt
      FROM slot_sums p JOIN samples s ON s.uid = p.uid GROUP BY 1),
    t AS (SELECT s.sensor, COUNT(*) AS samples, COUNT(*) FILTER (WHERE target_missing) AS targets_missing FROM target_sums x JOIN samples s ON s.uid = x.uid GROUP BY 1)
    SELECT o.sensor, samples, missing, corrupt, targets_missing FROM o JOIN t ON o.sensor = t.sensor""",
)
def store_counters(spark, sf_dir):
    return store.store_counters(store.read_store(spark, built_store(spark, sf_dir)))


@query(
    "store_audit",
    f"WITH {STORE_SQL} SELECT sensor, COUNT(*) AS expected, COUNT(*) AS stored, CAST((16 - split) * 4 AS INTEGER) AS min_length, CAST((16 - split) * 4 AS INTEGER) AS max_length, TRUE AS complete FROM samples GROUP BY sensor, split",
)
def store_audit(spark, sf_dir):
    rows = store.read_store(spark, built_store(spark, sf_dir))
    return store.audit_store(rows, store_manifest(spark, sf_dir), "ir_only", SIZES, TARGET)


@query("store_rebuild", f"WITH {GRIDS_SQL} SELECT FALSE AS built_again, COUNT(*) AS samples FROM grids")
def store_rebuild(spark, sf_dir):
    """A finished store is left alone."""
    path = built_store(spark, sf_dir)
    again = store.build_from_folders(store_manifest(spark, sf_dir), raster_folder(spark, sf_dir), path, "ir_only", sizes=SIZES, target_size=TARGET)
    return store.read_store(spark, path).agg(F.lit(again).alias("built_again"), F.count(F.lit(1)).alias("samples"))


# ---- features from the store ----------------------------------------------------------------------
@query(
    "feature_records",
    f"""WITH {STORE_SQL}, pick AS (
      SELECT a.uid, a.sensor, a.split, a.t, a.outcome,
             COALESCE(MAX(b.t) FILTER (WHERE b.outcome = 'ok' AND b.t <= a.t), MIN(b.t) FILTER (WHERE b.outcome = 'ok')) AS src
      FROM slots a JOIN slots b ON a.uid = b.uid GROUP BY ALL),
    bands AS (SELECT sensor, split, band, n_c, c FROM (SELECT DISTINCT sensor, split, 16 - split AS n_c FROM samples), (SELECT UNNEST(range(16)) AS band), LATERAL (SELECT band - split AS c) WHERE band >= split),
    z AS (SELECT p.uid, p.t, b.c, b.n_c, k, (CAST(COALESCE(q.q, 0) AS FLOAT) - CAST(m.mean AS FLOAT)) / CAST(m.std AS FLOAT) AS v
      FROM pick p JOIN bands b ON b.sensor = p.sensor CROSS JOIN (SELECT UNNEST(range(4)) AS k)
      JOIN frame_stats m ON m.sensor = p.sensor AND m.band = b.band
      LEFT JOIN q ON q.uid = p.uid + 3 * p.src AND q.i = b.band * 4 + k),
    d AS (SELECT a.uid, a.t + 3 AS t, a.c, a.n_c, a.k, b.v - a.v AS v FROM z a JOIN z b ON a.uid = b.uid AND a.c = b.c AND a.k = b.k AND b.t = a.t + 1),
    f AS (SELECT uid, (t * n_c + c) * 4 + k AS pos, v FROM (SELECT * FROM z UNION ALL SELECT * FROM d)),
    pad AS (SELECT uid, UNNEST(range(5 * (16 - split) * 4, 200)) AS pos, CAST(0 AS FLOAT) AS v FROM samples)
    SELECT CAST(uid AS VARCHAR) AS uid, CAST(pos AS INTEGER) AS pos, 50 AS channels, ROUND(CAST(v AS DOUBLE), 3) AS value FROM (SELECT * FROM f UNION ALL SELECT * FROM pad)""",
)
def feature_records(spark, sf_dir):
    """Band selection, fill, z-score, steps, flattening and padding from the store."""
    known = norm_stats_of(spark, sf_dir)
    config = ft.FeatureConfig(image_size=2, sizes=SIZES)
    rows = ft.image_features(store.read_store(spark, built_store(spark, sf_dir)), known, config, ["uid"])
    out = unpack(rows, ["uid", "channels"], "features", "pos", "value")
    return out.withColumn("value", F.round(F.col("value").cast("double"), 3))


def norm_stats_of(spark, sf_dir):
    return _measured(spark, sf_dir)


@query(
    "feature_targets",
    f"""WITH {STORE_SQL}, s AS (SELECT uid, sensor, n_frames, has_target FROM samples),
    o AS (SELECT uid, BOOL_OR(outcome = 'ok') AS has_data, COUNT(*) FILTER (WHERE outcome = 'ok') AS n_valid FROM slots GROUP BY 1),
    t AS (SELECT s.uid, CASE WHEN has_target AND s.uid % 11 <> 0 THEN r ELSE 0 END AS r FROM s JOIN tq ON tq.uid = s.uid),
    g AS (SELECT uid, SUM(LN(1 + r)) AS log_total, CAST(COUNT(*) FILTER (WHERE CAST(r AS FLOAT) > CAST(0.1 AS FLOAT)) AS DOUBLE) AS rain_pixels FROM t GROUP BY 1)
    SELECT CAST(s.uid AS VARCHAR) AS uid, CAST(s.uid % 3 AS INTEGER) AS sensor_id, CAST(has_data AS FLOAT) AS has_data, CAST(n_valid AS DOUBLE) AS n_valid, ROUND(log_total, 3) AS log_total, rain_pixels
    FROM s JOIN o ON o.uid = s.uid JOIN g ON g.uid = s.uid""",
)
def feature_targets(spark, sf_dir):
    """The other columns of the training record."""
    config = ft.FeatureConfig(image_size=3, sizes=SIZES)
    rows = ft.feature_records(store.read_store(spark, built_store(spark, sf_dir)), norm_stats_of(spark, sf_dir), config)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rows.select("uid", "sensor_id", "has_data", total("valid_mask").alias("n_valid"), F.round(total("target_log"), 3).alias("log_total"), total("rain_mask").alias("rain_pixels"))


# ---- predictions ----------------------------------------------------------------------------------
def predictions(spark, sf_dir):
    rate = F.transform("grid", lambda v: F.greatest(v.cast("double") * 10, F.lit(0.0)).cast("float"))
    rows = grids(spark, sf_dir).select(F.col("uid").cast("string").alias("uid"), rate.alias("rate"))
    return rows, rows.select("uid", F.concat(F.lit("p_"), "uid", F.lit(".tif")).alias("target_file"))


PREDICTED_SQL = f"WITH {FILES_SQL} SELECT 'p_' || CAST(uid AS VARCHAR) || '.tif' AS filename, ROUND(SUM(r), 4) AS total FROM tq GROUP BY uid"


@query("predictions_written", PREDICTED_SQL)
def predictions_written(spark, sf_dir):
    """One raster per manifest row, read back."""
    path = scratch_path(spark, "predictions")
    preds, names = predictions(spark, sf_dir)
    rasters.write_predictions(preds, names, path, TARGET)
    back = rasters.read_targets(spark, path, TARGET)
    return back.select("filename", F.round(F.aggregate("rate", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("bundle_written", f"WITH {FILES_SQL}, n AS (SELECT COUNT(*) AS n FROM grids) SELECT n AS n_rasters, n AS n_rows, n AS n_matched FROM n")
def bundle_written(spark, sf_dir):
    """Rasters and the manifest copy agree."""
    path = scratch_path(spark, "bundle")
    preds, names = predictions(spark, sf_dir)
    raw = store_manifest(spark, sf_dir).select(F.col("uid").alias("unique_id"), F.concat(F.lit("p_"), "uid", F.lit(".tif")).alias("gpm_imerg_filename"))
    rasters.write_bundle(preds, names, raw, path, TARGET)
    files = rasters.read_targets(spark, f"{path}/test_files", TARGET).select("filename", F.lit(1).alias("f"))
    rows = spark.read.option("header", True).csv(f"{path}/evaluation_target").select(F.col("gpm_imerg_filename").alias("filename"), F.lit(1).alias("r"))
    both = files.join(rows, "filename", "full")
    return both.agg(F.count("f").alias("n_rasters"), F.count("r").alias("n_rows"), F.count(F.col("f") + F.col("r")).alias("n_matched"))


@query(
    "prediction_match",
    f"""WITH {GRIDS_SQL} SELECT CAST(uid AS VARCHAR) AS uid, CASE WHEN uid % 13 = 0 THEN 'no prediction' WHEN uid % 29 = 0 THEN 'not in manifest'
      WHEN uid % 31 = 0 THEN 'repeated id' WHEN uid % 37 = 0 THEN 'wrong shape' ELSE 'non-finite' END AS fault
    FROM grids WHERE (uid % 13 = 0 AND uid % 29 <> 0) OR (uid % 13 <> 0 AND (uid % 29 = 0 OR uid % 31 = 0 OR uid % 37 = 0 OR uid % 41 = 0))""",
)
def prediction_match(spark, sf_dir):
    """Every reason not to write."""
    preds, names = predictions(spark, sf_dir)
    uid = F.col("uid").cast("long")
    rate = F.when(uid % 37 == 0, F.slice("rate", 1, 60)).when(uid % 41 == 0, F.concat(F.slice("rate", 1, 63), F.array(F.lit(float("inf")).cast("float")))).otherwise(F.col("rate"))
    faulty = preds.where(uid % 13 != 0).withColumn("rate", rate)
    faulty = faulty.unionByName(faulty.where(uid % 31 == 0))
    return rasters.prediction_faults(faulty, names.where(uid % 29 != 0), TARGET)


@query("missing_outputs", f"WITH {GRIDS_SQL} SELECT CAST(uid AS VARCHAR) AS uid, 'p_' || CAST(uid AS VARCHAR) || '.tif' AS filename FROM grids WHERE label = 3")
def missing_outputs(spark, sf_dir):
    _, names = predictions(spark, sf_dir)
    names = names.withColumnRenamed("target_file", "filename")
    done = grids(spark, sf_dir).where(F.col("label") != 3).select(F.concat(F.lit("p_"), F.col("uid").cast("string"), F.lit(".tif")).alias("filename"))
    return ensemble.missing_outputs(names, done)


@query(
    "outputs_audit",
    f"""WITH {FILES_SQL}, drawn AS (SELECT * FROM target_files ORDER BY MD5('0:' || filename), filename LIMIT 25)
    SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE error IS NULL) AS n_conform FROM drawn""",
)
def outputs_audit(spark, sf_dir):
    """How many of 25 random target rasters keep the contract; some hold values that are not finite. Only the drawn
    files are opened."""
    root = raster_folder(spark, sf_dir)
    names = grids(spark, sf_dir).select(F.concat(F.lit("t_"), F.col("uid").cast("string"), F.lit(".tif")).alias("filename"))
    chosen = sampling.audit_sample(names, 25)
    files = rasters.open_files(chosen.select(fx.target_path(root, F.col("filename")).alias("path"), "filename", F.lit(None).cast("string").alias("sensor")))
    return rasters.decode_targets(files, TARGET).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("n_conform"))


# ---- streams --------------------------------------------------------------------------------------
@query("verify_stream", f"WITH {PAIRS_SQL}, {SCORE_SQL} {SCORE_SELECT}")
def verify_stream(spark, sf_dir):
    """The verification report from a stream of pixel pairs."""
    batch = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    pairs = stream.select(
        F.col("l_suppkey").alias("site_id"), (F.col("l_linenumber") % 3).cast("int").alias("sensor_id"),
        (F.col("l_quantity") * F.col("l_discount") * SCALE).alias("target"), (F.col("l_quantity") * F.col("l_tax") * SCALE).alias("pred"),
    )
    state = scratch_path(spark, "checkpoint")
    live.start_cells(pairs, state, heavy=HEAVY).awaitTermination()
    return rounded(live.current_report(spark, state), *verify.SCORES)


@query(
    "ingest_stream",
    f"WITH {FILES_SQL} SELECT sensor, COUNT(*) AS n, COUNT(DISTINCT filename) AS n_files, COUNT(error) AS n_bad FROM frame_files GROUP BY 1",
)
def ingest_stream(spark, sf_dir):
    """Started twice over the same files: each is decoded once."""
    output, state = scratch_path(spark, "ingested"), scratch_path(spark, "checkpoint")
    root = f"{raster_folder(spark, sf_dir)}/{{{','.join(dims.SENSORS)}}}"
    for _ in range(2):
        ingest.start_ingest(spark, root, output, state, SIZES).awaitTermination()
    rows = spark.read.schema(StructType.fromDDL(rasters.FRAME_SCHEMA)).parquet(output)
    return rows.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("filename").alias("n_files"), F.count("error").alias("n_bad"))
