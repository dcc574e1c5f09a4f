"""Resumable raster ingest: every file is decoded once, however often the job is started."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridcast import dims
from gridcast.sources import tiff
from gridcast.sources.rasters import decode_frames, with_names

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


LIST_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
FILES_PER_TASK = 256


def frame_stream(spark: SparkSession, path: str, max_files: int = 10_000, pattern: str = "*.tif") -> DataFrame:
    """Files not seen before, ``max_files`` a batch. Spark lists each batch's files anew, by a task for every file unless
    ``LIST_TASKS`` says otherwise, and would decode them by a task for every 32."""
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set(LIST_TASKS, min(int(spark.conf.get(LIST_TASKS)), 4 * cores))
    raw = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    )
    return with_names(raw.load(path).coalesce(max(cores, -(-max_files // FILES_PER_TASK))))


def start_ingest(spark: SparkSession, path: str, output: str, checkpoint: str, sizes=None, n_bands: int = dims.BANDS_TOTAL, decoder=tiff.read_raster, max_files: int = 10_000) -> StreamingQuery:
    """Decode all files not seen before into Parquet by sensor, then stop; start again to continue."""
    frames = decode_frames(frame_stream(spark, path, max_files), sizes, n_bands, decoder)
    return (
        frames.writeStream.format("parquet").partitionBy("sensor").option("path", output)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
