"""Normalisation statistics as JSON: ``{sensor: {mean: [16], std: [16], n_pixels}}``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast import dims
from gridcast.functions.columns import frame_path
from gridcast.operators.samples import archive_members
from gridcast.operators.stats import frame_stats, sample_files
from gridcast.sources import archive, rasters, tiff


def from_folders(slots: DataFrame, root: str, max_files: int | None = None, stride: int = 1, seed: int = 0, sizes=None, decoder=tiff.read_raster) -> DataFrame:
    """Statistics over all listed frames, each as often as it is listed. With ``max_files``, so many per sensor are
    drawn by name first, and only those are opened."""
    drawn = _drawn(slots, max_files, seed)
    named = drawn.select(frame_path(root, F.col("sensor"), F.col("filename")).alias("path"), "filename", "sensor")
    files = rasters.open_files(named.repartition("path") if max_files is None else _spread(named))
    return frame_stats(rasters.decode_frames(files, sizes, decoder=decoder), stride)


def from_archives(slots: DataFrame, index: DataFrame, max_files: int | None = None, stride: int = 1, seed: int = 0, sizes=None, decoder=tiff.read_raster) -> DataFrame:
    """The same from archive members; names without a member are no candidates."""
    drawn = _drawn(archive_members(slots, index), max_files, seed)
    members = index.join(drawn.select("filename", "sensor"), "filename")  # two listings count twice
    return frame_stats(rasters.decode_frames(archive.read_members(members), sizes, decoder=decoder), stride)


def _drawn(slots: DataFrame, max_files: int | None, seed: int) -> DataFrame:
    return slots.where(F.col("filename").isNotNull()) if max_files is None else sample_files(slots, max_files, seed)


def _spread(named: DataFrame) -> DataFrame:
    """A few hundred names per sensor leave the draw in few partitions: give every core its share."""
    return named.repartition(named.sparkSession.sparkContext.defaultParallelism, "path")


def write_norm_stats(stats: DataFrame, path: str) -> None:
    """One JSON document. The table has at most 3 x 16 rows, so it fits one task."""
    kept = stats.where(F.col("sensor").isin(*dims.SENSORS) & (F.col("band") < dims.BANDS_TOTAL))
    rows = F.array_sort(F.collect_list(F.struct("band", "mean", "std")))
    per_sensor = kept.groupBy("sensor").agg(rows.alias("_r"), F.max("n_pixels").alias("n_pixels"))
    body = F.struct(F.col("_r.mean").alias("mean"), F.col("_r.std").alias("std"), "n_pixels")
    document = per_sensor.groupBy().agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sensor", body))))).alias("value")
    )
    document.coalesce(1).write.mode("overwrite").text(path)


def read_norm_stats(spark: SparkSession, path: str) -> DataFrame:
    """(sensor, band, mean, std, n_pixels)."""
    text = spark.read.option("wholetext", True).text(path)
    kind = "map<string,struct<mean:array<double>,std:array<double>,n_pixels:bigint>>"
    per_sensor = text.select(F.explode(F.from_json("value", kind)).alias("sensor", "_s"))
    rows = per_sensor.select("sensor", F.coalesce("_s.n_pixels", F.lit(0)).alias("n_pixels"), F.posexplode(F.arrays_zip("_s.mean", "_s.std")).alias("band", "_v"))
    return rows.select("sensor", "band", F.col("_v.mean").alias("mean"), F.col("_v.std").alias("std"), "n_pixels")
