"""Views of the given tables that play the part of pixels, grids, samples and manifests."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.dims import SENSORS
from gridcast.functions.rows import unpack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The tables hold values of two decimals, whose means can fall exactly between two rounded results. Rates are
# scaled by a factor without a short decimal form, so that rounding is never a matter of the last bit.
SCALE = 1.3678794411714423

# ---- pixel pairs: one row per line item -----------------------------------------------------------
POSITION = ["uid", "line", "part", "site_id"]
PAIRS_SQL = f"""pairs AS (
  SELECT l_orderkey AS uid, l_linenumber AS line, l_partkey AS part, l_suppkey AS site_id,
         CAST(l_linenumber % 3 AS INTEGER) AS sensor_id,
         l_quantity * l_discount * {SCALE}::DOUBLE AS target, l_quantity * l_tax * {SCALE}::DOUBLE AS pred
  FROM lineitem)"""


def pixel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("site_id"), (F.col("l_linenumber") % 3).cast("int").alias("sensor_id"),
        (F.col("l_quantity") * F.col("l_discount") * SCALE).alias("target"),
        (F.col("l_quantity") * F.col("l_tax") * SCALE).alias("pred"),
    )


# ---- grids: one 8x8 grid per embedding ------------------------------------------------------------
GRID = (8, 8)
GRIDS_SQL = """grids AS (
  SELECT vec_id AS uid, label, CAST(label % 3 AS INTEGER) AS sensor_id, embedding FROM embeddings),
cells AS (
  SELECT uid, label, sensor_id, CAST(i AS INTEGER) AS i, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM grids, (SELECT UNNEST(range(64)) AS i))"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"), "label", (F.col("label") % 3).cast("int").alias("sensor_id"),
        F.col("embedding").alias("grid"),
    )


def cells(grid_rows: DataFrame, column: str, keep: list[str], width: int) -> DataFrame:
    """Long form of row-major grids."""
    out = unpack(grid_rows, keep, column, "i", "v")
    return out.select(*keep, (F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def following(rows: DataFrame, column: str) -> DataFrame:
    """(uid, target): ``column`` of the next id, of the first one for the last."""
    first, last = rows.agg(F.min("uid"), F.max("uid")).first()
    return rows.select(F.when(F.col("uid") == first, F.lit(last)).otherwise(F.col("uid") - 1).alias("uid"), F.col(column).alias("target"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, label, sensor_id, pred, target): each grid against the grid of the next id, around the end."""
    rows = grids(spark, sf_dir)
    return rows.withColumnRenamed("grid", "pred").join(following(rows, "grid"), "uid")


# the same pairs by cell: shifted before the lists are unnested, so that cells need no join
RING_SQL = """ring AS (
  SELECT vec_id AS uid, label, CAST(label % 3 AS INTEGER) AS sensor_id, embedding,
         COALESCE(LEAD(embedding) OVER (ORDER BY vec_id), FIRST_VALUE(embedding) OVER (ORDER BY vec_id)) AS following FROM embeddings),
pc AS (
  SELECT uid, label, sensor_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS p, CAST(following[i + 1] AS DOUBLE) AS t
  FROM ring, (SELECT UNNEST(range(64)) AS i))"""


# ---- manifest: one sample per order ---------------------------------------------------------------
SENSOR_TEXT = [" Himawari ", "GOES", "meteosat"]
MANIFEST_SQL = """manifest AS (
  SELECT o_orderkey AS row_idx, 'o-' || CAST(o_orderkey AS VARCHAR) AS uid, n_name AS site,
         CASE o_orderkey % 3 WHEN 0 THEN 'himawari' WHEN 1 THEN 'goes' ELSE 'meteosat' END AS sensor,
         CAST(o_orderkey % 3 AS INTEGER) AS sensor_id,
         o_orderdate + to_minutes(CAST((o_orderkey * 30) % 1440 AS BIGINT)) AS ts,
         CAST(o_orderkey % 5 AS INTEGER) AS n_frames,
         CASE WHEN o_orderkey % 7 <> 0 THEN 't_' || CAST(o_orderkey AS VARCHAR) || '.tif' END AS target_file
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
slots AS (
  SELECT row_idx, uid, sensor, CAST(t AS INTEGER) AS t,
         CASE WHEN t < n_frames THEN 'f_' || CAST(row_idx - row_idx % 4 AS VARCHAR) || '_' || CAST(t AS VARCHAR) || '.tif' END AS filename
  FROM manifest, (SELECT UNNEST(range(3)) AS t))"""


def raw_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells as a manifest file holds them. Four samples in a row name the same frames; a sample names
    zero to four; some have no target."""
    key = F.col("o_orderkey")
    site = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders").join(site, F.col("o_custkey") == F.col("c_custkey"))
    name = lambda t: F.concat(F.lit("'f_"), (key - key % 4).cast("string"), F.lit("_"), t.cast("string"), F.lit(".tif'"))
    names = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), (key % 5).cast("int") - 1), name)
    )
    return orders.select(
        key.alias("row_idx"),
        F.concat(F.lit("o-"), key.cast("string")).alias("unique_id"),
        F.col("n_name").alias("name_location"),
        F.array(*[F.lit(s) for s in SENSOR_TEXT])[(key % 3).cast("int")].alias("satellite_target"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=((key * 30) % 1440).cast("int"))).cast("timestamp_ntz").alias("datetime"),
        F.concat(F.lit("["), F.concat_ws(", ", names), F.lit("]")).alias("last_30_minutes_observation_filename"),
        F.when(key % 7 != 0, F.concat(F.lit("t_"), key.cast("string"), F.lit(".tif"))).alias("gpm_imerg_filename"),
    )


# ---- slots: event means in three 8-hour frames of a user's day ------------------------------------
SLOTS_SQL = f"""slot_means AS (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) // 8 AS INTEGER) AS t, AVG(value * {SCALE}::DOUBLE) AS v
  FROM events GROUP BY 1, 2, 3)"""


def day_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, values ARRAY of 3, valid ARRAY of 3) in a single aggregation."""
    events = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("date").alias("day"), (F.hour("ts") / 8).cast("int").alias("t"), (F.col("value") * SCALE).alias("value")
    )
    means = [F.avg(F.when(F.col("t") == t, F.col("value"))) for t in range(3)]
    rows = events.groupBy("user_id", "day").agg(F.array(*means).alias("values"))
    return rows.withColumn("valid", F.transform("values", lambda v: v.isNotNull())).withColumn(
        "values", F.transform("values", lambda v: F.coalesce(v, F.lit(0.0)))
    )


def sensor_of(ident) -> F.col:
    return F.array(*[F.lit(s) for s in SENSORS])[ident.cast("int")]
