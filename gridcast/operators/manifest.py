"""Manifest operators: reading, splitting, counting, positions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridcast import dims
from gridcast.functions import columns as fx
from gridcast.functions.rows import unpack
from gridcast.operators.ordered import first_per_group, ordinal_rank, previous_row

RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.TimestampNTZType() if c == "datetime" else T.StringType()) for c in dims.MANIFEST_COLUMNS]
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV manifest with a header. A missing column is reported before the scan; files must share one header.
    ``row_idx`` grows in file order (gaps allowed; see :func:`with_row_number`)."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in dims.MANIFEST_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"manifest {path} misses columns {missing}")
    by_name = {f.name: f for f in RAW_SCHEMA.fields}
    schema = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    # every file's header is checked against these names; a cell that does not parse fails the read
    strict = {"header": True, "escape": '"', "enforceSchema": False, "mode": "FAILFAST"}
    rows = spark.read.schema(schema).options(**strict).csv(path)
    return rows.withColumn("row_idx", F.monotonically_increasing_id())


def parse_manifest(raw: DataFrame) -> DataFrame:
    """Typed manifest: canonical sensor, its id, frame names, three slots, nullable target name."""
    names = fx.frame_list(F.col("last_30_minutes_observation_filename"))
    keep = ["row_idx"] if "row_idx" in raw.columns else []
    return raw.select(
        *keep,
        F.col("unique_id").alias("uid"),
        F.col("name_location").alias("site"),
        fx.known_sensor(F.col("satellite_target")).alias("sensor"),
        F.col("datetime").alias("ts"),
        names.alias("frames"),
        fx.blank_to_null(F.col("gpm_imerg_filename")).alias("target_file"),
    ).withColumns({"slots": fx.frame_slots(F.col("frames")), "sensor_id": fx.sensor_id(F.col("sensor"))})


def explode_slots(manifest: DataFrame) -> DataFrame:
    """One row per (uid, t), with a NULL filename where the sample has no frame."""
    return unpack(manifest, ["uid", "sensor"], "slots", "t", "filename")


def duplicate_ids(manifest: DataFrame, uid: str = "uid") -> DataFrame:
    return manifest.groupBy(uid).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def with_row_number(manifest: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Consecutive 0-based numbers in ``order``."""
    return ordinal_rank(manifest, [], order, name)


def sensor_positions(manifest: DataFrame, order: list[str]) -> DataFrame:
    """``local_idx``: the position among the rows of the same sensor."""
    return ordinal_rank(manifest, ["sensor"], order, "local_idx")


def sensor_counts(manifest: DataFrame) -> DataFrame:
    """Rows per sensor with zeros for absent sensors."""
    counts = manifest.groupBy("sensor").agg(F.count(F.lit(1)).alias("_n"))
    return (
        dims.sensors(manifest.sparkSession)
        .join(counts, "sensor", "left")
        .select("sensor", "sensor_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    )


def stored_shapes(manifest: DataFrame, mode: str) -> DataFrame:
    """Counts and the (frames, channels, height, width) every sensor is stored with."""
    channels = {s: len(dims.band_indices(s, mode)) for s in dims.SENSORS}
    size = dims.sensors(manifest.sparkSession).select("sensor", "height", "width")
    return sensor_counts(manifest).join(size, "sensor").select(
        "sensor", "n", F.lit(dims.FRAMES_PER_SAMPLE).alias("frames"),
        dims.sensor_case(F.col("sensor"), channels).alias("channels"), "height", "width",
    )


def is_holdout(site: Column, sites=dims.HOLDOUT_SITES) -> Column:
    return F.lower(site).isin(*[s.lower() for s in sites])


def split_by_site(manifest: DataFrame, sites=dims.HOLDOUT_SITES, site: str = "site") -> tuple[DataFrame, DataFrame]:
    """(training rows, hold-out rows); a NULL site trains."""
    held = F.coalesce(is_holdout(F.col(site), sites), F.lit(False))
    return manifest.where(~held), manifest.where(held)


def for_sensor(manifest: DataFrame, sensor: str, column: str = "sensor") -> DataFrame:
    return manifest.where(fx.canonical_sensor(F.col(column)) == sensor)


def keep_rows(manifest: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    return manifest.join(wanted, on, "left_semi")


def site_ids(manifest: DataFrame, site: str = "site") -> DataFrame:
    """Dense ids by sorted distinct site name of this manifest."""
    return ordinal_rank(manifest.select(site).distinct(), [], [site], "site_id")


def with_site_ids(manifest: DataFrame, site: str = "site") -> DataFrame:
    """Join on the site; AQE broadcasts the id table when its written size allows. A NULL site has no id."""
    ids = site_ids(manifest.where(F.col(site).isNotNull()), site)
    return manifest.join(ids, site, "left")


def profile(manifest: DataFrame, site: str = "site", ts: str = "ts", sensor: str = "sensor") -> DataFrame:
    """Rows, rows per sensor, distinct sites, time span. Pre-aggregates per (sensor, site)."""
    cells = manifest.groupBy(sensor, site).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi")
    )
    per_sensor = [
        F.coalesce(F.sum(F.when(F.col(sensor) == s, F.col("_n"))), F.lit(0)).cast("long").alias(f"n_{s}")
        for s in dims.SENSORS
    ]
    return cells.agg(
        F.sum("_n").alias("n_rows"), *per_sensor, F.count_distinct(site).alias("n_sites"),
        F.min("_lo").alias("first_ts"), F.max("_hi").alias("last_ts"),
    )


def first_rows(manifest: DataFrame, n: int, order: list[str]) -> DataFrame:
    return manifest.orderBy(*order).limit(n)


def first_per_sensor(manifest: DataFrame, n: int, order: list[str], sensor: str = "sensor") -> DataFrame:
    return first_per_group(manifest, [sensor], order, n)


def order_violations(manifest: DataFrame, order: list[str], ts: str = "ts") -> DataFrame:
    """Rows whose time lies before that of the row above."""
    return previous_row(manifest, [], order, ts, "previous_ts").where(F.col(ts) < F.col("previous_ts"))
