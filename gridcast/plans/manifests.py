"""Manifests: reading, splitting, counting, positions, set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridcast import dims
from gridcast.functions import columns as fx
from gridcast.functions.rows import unpack
from gridcast.operators import manifest as mf, samples
from gridcast.plans.registry import query, rounded
from gridcast.plans.views import MANIFEST_SQL, raw_manifest, table
from gridcast.scratch import scratch_path

HOLDOUT = ("France", "PERU", "china", "Kenya")
HOLDOUT_SQL = "LOWER(site) IN ('france', 'peru', 'china', 'kenya')"


def manifest(spark, sf_dir):
    return mf.parse_manifest(raw_manifest(spark, sf_dir))


@query(
    "manifest_csv",
    f"""WITH {MANIFEST_SQL}, p AS (SELECT uid, MAX(filename) FILTER (WHERE t = 0) AS slot0, MAX(filename) FILTER (WHERE t = 1) AS slot1,
        MAX(filename) FILTER (WHERE t = 2) AS slot2 FROM slots GROUP BY uid)
    SELECT m.uid, site, sensor, sensor_id, ts, n_frames, slot0, slot1, slot2, target_file FROM manifest m JOIN p ON m.uid = p.uid""",
)
def manifest_csv(spark, sf_dir):
    """Written as a CSV manifest, then read, checked and parsed."""
    path = scratch_path(spark, "manifest")
    raw = raw_manifest(spark, sf_dir).drop("row_idx")
    raw.withColumn("datetime", F.col("datetime").cast("string")).write.option("header", True).csv(path)
    rows = mf.parse_manifest(mf.read_manifest(spark, path))
    return rows.select(
        "uid", "site", "sensor", "sensor_id", "ts", F.size("frames").alias("n_frames"),
        *[F.get("slots", F.lit(t)).alias(f"slot{t}") for t in range(3)], "target_file",
    )


@query("frame_list", f"WITH {MANIFEST_SQL} SELECT uid, n_frames, t, 'f_' || CAST(row_idx - row_idx % 4 AS VARCHAR) || '_' || CAST(t AS VARCHAR) || '.tif' AS filename FROM (SELECT *, CAST(UNNEST(range(n_frames)) AS INTEGER) AS t FROM manifest)")
def frame_list(spark, sf_dir):
    """List and tuple literals alternate; both parse to the same names."""
    cell = F.col("last_30_minutes_observation_filename")
    as_tuple = F.concat(F.lit("("), F.substring(cell, 2, F.length(cell) - 2), F.lit(",)"))
    mixed = F.when((F.col("row_idx") % 2 == 1) & (cell != "[]"), as_tuple).otherwise(cell)
    rows = raw_manifest(spark, sf_dir).select(F.col("unique_id").alias("uid"), fx.frame_list(mixed).alias("frames"))
    return unpack(rows.withColumn("n_frames", F.size("frames")), ["uid", "n_frames"], "frames", "t", "filename")


@query("frame_slots", f"WITH {MANIFEST_SQL} SELECT uid, t, filename FROM slots")
def frame_slots(spark, sf_dir):
    return mf.explode_slots(manifest(spark, sf_dir)).select("uid", "t", "filename")


@query(
    "frame_paths",
    f"WITH {MANIFEST_SQL} SELECT uid, t, '/data/' || sensor || '/' || filename AS path, filename AS name, sensor AS folder FROM slots WHERE filename IS NOT NULL",
)
def frame_paths(spark, sf_dir):
    """Names to paths and back."""
    rows = mf.explode_slots(manifest(spark, sf_dir)).where(F.col("filename").isNotNull())
    rows = rows.withColumn("path", fx.frame_path("/data/", F.col("sensor"), F.col("filename")))
    return rows.select("uid", "t", "path", fx.path_filename(F.col("path")).alias("name"), fx.path_subdir(F.col("path")).alias("folder"))


@query("sensor_names", f"WITH {MANIFEST_SQL} SELECT uid, sensor, sensor_id, sensor AS back FROM manifest")
def sensor_names(spark, sf_dir):
    raw = raw_manifest(spark, sf_dir).select(F.col("unique_id").alias("uid"), fx.known_sensor(F.col("satellite_target")).alias("sensor"))
    named = raw.withColumn("sensor_id", fx.sensor_id(F.col("sensor")))
    return named.withColumn("back", fx.sensor_name(F.col("sensor_id")))


@query(
    "sensor_counts",
    f"WITH {MANIFEST_SQL}, s AS (SELECT * FROM (VALUES ('himawari', 0), ('goes', 1), ('meteosat', 2)) v(sensor, sensor_id)) "
    "SELECT s.sensor, s.sensor_id, COUNT(m.uid) AS n FROM s LEFT JOIN (SELECT * FROM manifest WHERE sensor <> 'goes') m ON s.sensor = m.sensor GROUP BY ALL",
)
def sensor_counts(spark, sf_dir):
    """A sensor without rows is listed with zero."""
    return mf.sensor_counts(manifest(spark, sf_dir).where(F.col("sensor") != "goes"))


@query("sensor_positions", f"WITH {MANIFEST_SQL} SELECT uid, sensor, ROW_NUMBER() OVER (PARTITION BY sensor ORDER BY row_idx) - 1 AS local_idx FROM manifest")
def sensor_positions(spark, sf_dir):
    rows = manifest(spark, sf_dir).select("uid", "sensor", "row_idx")
    return mf.sensor_positions(rows, ["row_idx"]).drop("row_idx")


@query("row_numbers", f"WITH {MANIFEST_SQL} SELECT uid, ROW_NUMBER() OVER (ORDER BY row_idx) - 1 AS row_number FROM manifest")
def row_numbers(spark, sf_dir):
    return mf.with_row_number(manifest(spark, sf_dir).select("uid", "row_idx"), ["row_idx"]).drop("row_idx")


@query(
    "stored_positions",
    f"""WITH {MANIFEST_SQL}, p AS (SELECT uid, sensor, ROW_NUMBER() OVER (PARTITION BY sensor ORDER BY row_idx) - 1 AS local_idx FROM manifest)
    SELECT o.o_orderkey AS wanted, p.sensor, p.local_idx FROM orders o JOIN p ON p.uid = 'o-' || CAST(o.o_orderkey AS VARCHAR) WHERE o.o_orderstatus = 'F'""",
)
def stored_positions(spark, sf_dir):
    """Wanted samples to their place in the per-sensor store."""
    placed = mf.sensor_positions(manifest(spark, sf_dir).select("uid", "sensor", "row_idx"), ["row_idx"])
    wanted = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("wanted"), F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("uid")
    )
    return wanted.join(placed, "uid").select("wanted", "sensor", "local_idx")


@query("site_ids", f"WITH {MANIFEST_SQL}, d AS (SELECT DISTINCT site FROM manifest), i AS (SELECT site, ROW_NUMBER() OVER (ORDER BY site) - 1 AS site_id FROM d) SELECT uid, m.site, site_id FROM manifest m JOIN i ON m.site = i.site")
def site_ids(spark, sf_dir):
    return mf.with_site_ids(manifest(spark, sf_dir).select("uid", "site")).select("uid", "site", "site_id")


@query(
    "sample_dims",
    f"""WITH {MANIFEST_SQL}, d AS (SELECT DISTINCT site FROM manifest), i AS (SELECT site, ROW_NUMBER() OVER (ORDER BY site) - 1 AS site_id FROM d),
    s AS (SELECT * FROM (VALUES ('himawari', 81, 81), ('goes', 141, 141), ('meteosat', 144, 144)) v(sensor, height, width))
    SELECT uid, site_id, m.sensor, height, width FROM manifest m JOIN i ON m.site = i.site JOIN s ON s.sensor = m.sensor""",
)
def sample_dims(spark, sf_dir):
    """Samples with their site id and their sensor's raster size."""
    rows = mf.with_site_ids(manifest(spark, sf_dir).select("uid", "site", "sensor"))
    return rows.join(dims.sensors(spark), "sensor").select("uid", "site_id", "sensor", "height", "width")


@query("split_holdout", f"WITH {MANIFEST_SQL} SELECT uid, site, CASE WHEN {HOLDOUT_SQL} THEN 'val' ELSE 'train' END AS part FROM manifest")
def split_holdout(spark, sf_dir):
    train, val = mf.split_by_site(manifest(spark, sf_dir).select("uid", "site"), HOLDOUT)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query("split_disjoint", f"WITH {MANIFEST_SQL} SELECT (SELECT COUNT(*) FROM (SELECT site FROM manifest WHERE {HOLDOUT_SQL} INTERSECT SELECT site FROM manifest WHERE NOT {HOLDOUT_SQL})) AS shared, COUNT(DISTINCT site) AS n_sites FROM manifest")
def split_disjoint(spark, sf_dir):
    """The two parts share no site."""
    rows = manifest(spark, sf_dir).select("uid", "site")
    train, val = mf.split_by_site(rows, HOLDOUT)
    shared = train.select("site").intersect(val.select("site")).agg(F.count(F.lit(1)).alias("shared"))
    n = rows.agg(F.count_distinct("site").alias("n_sites"))
    return shared.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("sensor_filter", f"WITH {MANIFEST_SQL} SELECT uid, site FROM manifest WHERE sensor = 'himawari'")
def sensor_filter(spark, sf_dir):
    raw = raw_manifest(spark, sf_dir)
    return mf.for_sensor(raw, "himawari", "satellite_target").select(F.col("unique_id").alias("uid"), F.col("name_location").alias("site"))


@query("row_subset", f"WITH {MANIFEST_SQL} SELECT uid, site FROM manifest WHERE row_idx IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def row_subset(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("row_idx"))
    return mf.keep_rows(manifest(spark, sf_dir), wanted, "row_idx").select("uid", "site")


@query("first_rows", f"WITH {MANIFEST_SQL} SELECT uid, row_idx FROM manifest ORDER BY row_idx LIMIT 100")
def first_rows(spark, sf_dir):
    return mf.first_rows(manifest(spark, sf_dir), 100, ["row_idx"]).select("uid", "row_idx")


@query("first_per_sensor", f"WITH {MANIFEST_SQL} SELECT uid, sensor FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sensor ORDER BY row_idx) AS rn FROM manifest) WHERE rn <= 120")
def first_per_sensor(spark, sf_dir):
    return mf.first_per_sensor(manifest(spark, sf_dir), 120, ["row_idx"]).select("uid", "sensor")


@query(
    "strata_union",
    f"WITH {MANIFEST_SQL}, h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sensor ORDER BY row_idx) AS rn FROM manifest) "
    "SELECT uid, sensor FROM h WHERE sensor = 'himawari' AND rn <= 50 UNION ALL SELECT uid, sensor FROM h WHERE sensor = 'goes' AND rn <= 50",
)
def strata_union(spark, sf_dir):
    rows = manifest(spark, sf_dir).select("uid", "sensor", "row_idx")
    parts = [mf.first_rows(mf.for_sensor(rows, s), 50, ["row_idx"]) for s in ("himawari", "goes")]
    return parts[0].unionByName(parts[1]).drop("row_idx")


@query("distinct_sites", f"WITH {MANIFEST_SQL} SELECT DISTINCT site FROM manifest ORDER BY site")
def distinct_sites(spark, sf_dir):
    return manifest(spark, sf_dir).select("site").distinct().orderBy("site")


@query(
    "manifest_profile",
    f"""WITH {MANIFEST_SQL} SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE sensor = 'himawari') AS n_himawari, COUNT(*) FILTER (WHERE sensor = 'goes') AS n_goes,
        COUNT(*) FILTER (WHERE sensor = 'meteosat') AS n_meteosat, COUNT(DISTINCT site) AS n_sites, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM manifest""",
)
def manifest_profile(spark, sf_dir):
    return mf.profile(manifest(spark, sf_dir))


@query("time_order", f"WITH {MANIFEST_SQL}, l AS (SELECT uid, ts, LAG(ts) OVER (ORDER BY row_idx) AS previous_ts FROM manifest) SELECT uid, ts, previous_ts FROM l WHERE ts < previous_ts")
def time_order(spark, sf_dir):
    rows = manifest(spark, sf_dir).select("uid", "row_idx", "ts")
    return mf.order_violations(rows, ["row_idx"]).select("uid", "ts", "previous_ts")


@query("duplicate_ids", "SELECT 's-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_orderkey AS VARCHAR) AS uid, COUNT(*) AS n FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1")
def duplicate_ids(spark, sf_dir):
    key = F.concat(F.lit("s-"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_orderkey").cast("string"))
    return mf.duplicate_ids(table(spark, sf_dir, "lineitem").select(key.alias("uid")))


# ---- slots and files ------------------------------------------------------------------------------
FRAME_FILES_SQL = """frame_files AS (
  SELECT CASE (o_orderkey + t) % 3 WHEN 0 THEN 'himawari' WHEN 1 THEN 'goes' ELSE 'meteosat' END AS sensor,
         'f_' || CAST(o_orderkey AS VARCHAR) || '_' || CAST(t AS VARCHAR) || '.tif' AS filename,
         CASE WHEN o_custkey % 10 = 0 THEN 'damaged' END AS error, o_totalprice AS level
  FROM orders, (SELECT UNNEST(range(3)) AS t))"""


def frame_files(spark, sf_dir):
    """Three frames per order, each in one sensor's folder, some damaged."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"))
    return rows.select(
        F.array(*[F.lit(s) for s in dims.SENSORS])[((F.col("o_orderkey") + F.col("t")) % 3).cast("int")].alias("sensor"),
        F.concat(F.lit("f_"), F.col("o_orderkey").cast("string"), F.lit("_"), F.col("t").cast("string"), F.lit(".tif")).alias("filename"),
        F.when(F.col("o_custkey") % 10 == 0, "damaged").alias("error"), F.col("o_totalprice").alias("level"),
    )


OUTCOME_SQL = f"""{MANIFEST_SQL}, {FRAME_FILES_SQL}, matched AS (
  SELECT s.uid, s.sensor, s.t, CASE WHEN s.filename IS NULL THEN 'missing' WHEN f.filename IS NULL OR f.error IS NOT NULL THEN 'corrupt' ELSE 'ok' END AS outcome, f.level
  FROM slots s LEFT JOIN frame_files f ON s.filename = f.filename AND s.sensor = f.sensor)"""


@query("slot_join", f"WITH {OUTCOME_SQL} SELECT uid, t, outcome, CASE WHEN outcome = 'ok' THEN level END AS level FROM matched")
def slot_join(spark, sf_dir):
    slots = mf.explode_slots(manifest(spark, sf_dir))
    return samples.match_slots(slots, frame_files(spark, sf_dir), ["level"]).select("uid", "t", "outcome", "level")


@query(
    "slot_outcomes",
    f"""WITH {OUTCOME_SQL} SELECT sensor, COUNT(*) FILTER (WHERE outcome = 'missing') AS missing, COUNT(*) FILTER (WHERE outcome = 'corrupt') AS corrupt,
        COUNT(*) FILTER (WHERE outcome = 'ok') AS ok FROM matched GROUP BY sensor""",
)
def slot_outcomes(spark, sf_dir):
    slots = mf.explode_slots(manifest(spark, sf_dir))
    return samples.outcome_counts(samples.match_slots(slots, frame_files(spark, sf_dir), []), ("sensor",))


@query(
    "target_join",
    f"""WITH {MANIFEST_SQL}, files AS (SELECT 't_' || CAST(l_orderkey AS VARCHAR) || '.tif' AS target_file, MAX(l_quantity) AS q, MAX(l_linenumber) AS n FROM lineitem GROUP BY 1)
    SELECT uid, CASE WHEN f.target_file IS NOT NULL AND n < 6 THEN q ELSE 0 END AS first_value,
           m.target_file IS NOT NULL AND NOT COALESCE(n < 6, FALSE) AS target_missing
    FROM manifest m LEFT JOIN files f ON m.target_file = f.target_file""",
)
def target_join(spark, sf_dir):
    """Targets exist for orders with items and are unreadable for some; the rest are zeros."""
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_linenumber").alias("n"))
    targets = files.select(
        F.concat(F.lit("t_"), F.col("l_orderkey").cast("string"), F.lit(".tif")).alias("filename"),
        F.array(F.col("q").cast("float")).alias("rate"), F.when(F.col("n") >= 6, "damaged").alias("error"),
    )
    out = samples.match_targets(manifest(spark, sf_dir).select("uid", "target_file"), targets, 1)
    return out.select("uid", F.col("target")[0].cast("double").alias("first_value"), "target_missing")


@query("archive_membership", f"WITH {MANIFEST_SQL}, {FRAME_FILES_SQL} SELECT uid, t, filename FROM slots WHERE filename IN (SELECT filename FROM frame_files WHERE error IS NULL)")
def archive_membership(spark, sf_dir):
    members = frame_files(spark, sf_dir).where(F.col("error").isNull())
    return samples.archive_members(mf.explode_slots(manifest(spark, sf_dir)), members).select("uid", "t", "filename")


@query(
    "file_gaps",
    f"""WITH {MANIFEST_SQL}, {FRAME_FILES_SQL}, w AS (SELECT DISTINCT filename FROM slots WHERE filename IS NOT NULL), h AS (SELECT DISTINCT filename FROM frame_files WHERE error IS NULL)
    SELECT filename, 'absent' AS side FROM w WHERE filename NOT IN (SELECT filename FROM h) UNION ALL SELECT filename, 'extra' FROM h WHERE filename NOT IN (SELECT filename FROM w)""",
)
def file_gaps(spark, sf_dir):
    want = mf.explode_slots(manifest(spark, sf_dir)).where(F.col("filename").isNotNull())
    return samples.file_gaps(want, frame_files(spark, sf_dir).where(F.col("error").isNull()))


@query(
    "file_difference",
    f"""WITH {MANIFEST_SQL}, {FRAME_FILES_SQL} SELECT 'manifest' AS only_in, filename FROM (SELECT filename FROM slots WHERE filename IS NOT NULL EXCEPT SELECT filename FROM frame_files)
    UNION ALL SELECT 'disk', filename FROM (SELECT filename FROM frame_files EXCEPT SELECT filename FROM slots WHERE filename IS NOT NULL)""",
)
def file_difference(spark, sf_dir):
    want = mf.explode_slots(manifest(spark, sf_dir)).where(F.col("filename").isNotNull()).select("filename")
    have = frame_files(spark, sf_dir).select("filename")
    return want.subtract(have).select(F.lit("manifest").alias("only_in"), "filename").unionByName(
        have.subtract(want).select(F.lit("disk").alias("only_in"), "filename")
    )


# ---- time -----------------------------------------------------------------------------------------
@query(
    "cyclic_time",
    """WITH h AS (SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM events)
    SELECT event_id, ROUND(COS(2 * PI() * (h - 12) / 24), 6) AS daylight, ROUND(SIN(2 * PI() * h / 24), 6) AS sin_hour, ROUND(COS(2 * PI() * h / 24), 6) AS cos_hour FROM h""",
)
def cyclic_time(spark, sf_dir):
    parts = fx.cyclic_time(F.col("ts"))
    out = table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])
    return rounded(out, *parts)


@query(
    "aux_vector",
    """WITH h AS (SELECT event_id, user_id % 3 AS s, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM events),
    v AS (SELECT event_id, [CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN s = 1 THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN s = 2 THEN 1.0::DOUBLE ELSE 0 END,
          COS(2 * PI() * (h - 12) / 24), SIN(2 * PI() * h / 24), COS(2 * PI() * h / 24)] AS a FROM h)
    SELECT event_id, CAST(i AS INTEGER) AS i, ROUND(CAST(CAST(a[i + 1] AS FLOAT) AS DOUBLE), 5) AS value FROM v, (SELECT UNNEST(range(6)) AS i)""",
)
def aux_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", fx.aux_vector(F.col("user_id") % 3, F.col("ts")).alias("a"))
    out = unpack(rows, ["event_id"], "a", "i", "value")
    return out.withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("hour_class", "SELECT event_id, CASE WHEN hour(ts) BETWEEN 14 AND 22 THEN 'night' WHEN hour(ts) BETWEEN 2 AND 7 THEN 'day' END AS hour_class FROM events")
def hour_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fx.hour_class(F.col("ts")).alias("hour_class"))
