"""Raster readers and writers. A file whose content cannot be read becomes a row with ``error``; a broken machine or
decoder fails the task."""
from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast import dims
from gridcast.functions.columns import path_filename, path_subdir
from gridcast.sources import tiff
from gridcast.sources.files import DATA_FAULTS, open_input, read_bytes, write_atomic
from gridcast.scratch import materialise

Decoder = Callable[[bytes], tuple[np.ndarray, tiff.Header]]
FRAME_SCHEMA = "path string, filename string, sensor string, height int, width int, n_bands int, pixels binary, error string"
TARGET_SCHEMA = "path string, filename string, rate array<float>, error string"
HEADER_SCHEMA = (
    "path string, filename string, sensor string, height int, width int, n_bands int, dtype string, crs string, "
    "transform array<double>, error string"
)

SCANS_PER_TASK = 64  # Spark's scan partitions that one task reads at most, each of up to 32 files
SCAN_BYTES = 32 << 20  # of rasters in one task


def binary_files(spark: SparkSession, path: str | list[str], pattern: str = "*.tif") -> DataFrame:
    """(path, filename, sensor, content) below ``path``; ``path`` may hold globs. The sensor is the folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return with_names(bundled(raw.load(path)))


def bundled(raw: DataFrame) -> DataFrame:
    """Small files in fewer tasks. Spark counts 4 MB for opening a file, so a scan task has some 32 files at most,
    and a task with a Python worker costs more than reading them."""
    size = int(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    scans = raw.select("length").rdd.getNumPartitions()
    tasks = max(raw.sparkSession.sparkContext.defaultParallelism, -(-scans // SCANS_PER_TASK), -(-size // SCAN_BYTES))
    return raw.coalesce(tasks) if tasks < scans else raw


def with_names(raw: DataFrame) -> DataFrame:
    return raw.select("path", path_filename(F.col("path")).alias("filename"), path_subdir(F.col("path")).alias("sensor"), "content")


def open_files(named: DataFrame) -> DataFrame:
    """(path, filename, sensor) -> (path, filename, sensor, content), opening only the named files. An absent
    file gives empty content, which the decoders report."""

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 64):
                batch = big.slice(at, 64)
                contents = []
                for path in batch["path"].to_pylist():
                    try:
                        contents.append(read_bytes(path))
                    except FileNotFoundError:
                        contents.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [batch["path"], batch["filename"], batch["sensor"], pa.array(contents, pa.binary())],
                    names=["path", "filename", "sensor", "content"],
                )

    return named.select("path", "filename", "sensor").mapInArrow(run, "path string, filename string, sensor string, content binary")


def decode_frames(
    files: DataFrame, sizes: dict[str, tuple[int, int]] | None = None, n_bands: int = dims.BANDS_TOTAL,
    decoder: Decoder = tiff.read_raster, check_dtype: bool = True,
) -> DataFrame:
    """(path, filename, sensor, content) -> FRAME_SCHEMA. ``sizes`` maps sensors to (height, width)."""
    expected = dims.NATIVE_SIZE if sizes is None else sizes

    def run(batches):
        for batch in batches:
            columns = {k: batch[k].to_pylist() for k in ("path", "filename", "sensor")}
            out = {"height": [], "width": [], "n_bands": [], "pixels": [], "error": []}
            for content, sensor in zip(batch["content"], columns["sensor"]):
                row = (None, None, None, None)
                error = None
                try:
                    if sensor not in expected:
                        raise tiff.RasterError(f"unknown sensor {sensor!r}")
                    block, head = decoder(content.as_buffer().to_pybytes())
                    block = tiff.check_frame(block, head, n_bands, expected[sensor], check_dtype)
                    row = (head.height, head.width, head.count, block.astype(np.uint8, copy=False).tobytes())
                except DATA_FAULTS as e:
                    error = f"{type(e).__name__}: {e}"
                for k, v in zip(out, (*row, error)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(
                {**columns, **out},
                schema=pa.schema(
                    [("path", pa.string()), ("filename", pa.string()), ("sensor", pa.string()), ("height", pa.int32()),
                     ("width", pa.int32()), ("n_bands", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]
                ),
            )

    return files.select("path", "filename", "sensor", "content").mapInArrow(run, FRAME_SCHEMA)


def decode_targets(files: DataFrame, size: tuple[int, int] = dims.TARGET_SIZE, decoder: Decoder = tiff.read_raster) -> DataFrame:
    """(path, filename, content) -> TARGET_SCHEMA."""

    def run(batches):
        for batch in batches:
            rates, errors = [], []
            for content in batch["content"]:
                try:
                    block, head = decoder(content.as_buffer().to_pybytes())
                    rates.append(tiff.check_target(block, head, size).reshape(-1))
                    errors.append(None)
                except DATA_FAULTS as e:
                    rates.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [batch["path"], batch["filename"], pa.array(rates, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=["path", "filename", "rate", "error"],
            )

    return files.select("path", "filename", "content").mapInArrow(run, TARGET_SCHEMA)


def read_frames(spark: SparkSession, path, sizes=None, n_bands: int = dims.BANDS_TOTAL, decoder: Decoder = tiff.read_raster) -> DataFrame:
    return decode_frames(binary_files(spark, path), sizes, n_bands, decoder)


def read_targets(spark: SparkSession, path, size=dims.TARGET_SIZE, decoder: Decoder = tiff.read_raster) -> DataFrame:
    return decode_targets(binary_files(spark, path), size, decoder)


def read_headers(named: DataFrame, sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Metadata of (path, filename, sensor). A task seeks to the directory of each file and to its values, some KB in
    all; pixels stay where they are. With ``sizes`` a wrong size or an unknown sensor is reported in ``error``."""

    def header(path: str, sensor: str) -> dict:
        try:
            with open_input(path) as stream:
                head = tiff.read_stream_header(tiff.Ranges(stream))
        except DATA_FAULTS as e:
            return {"error": f"{type(e).__name__}: {e}"}
        error = None
        if sizes is not None and sensor not in sizes:
            error = f"unknown sensor {sensor!r}"
        elif sizes is not None and sizes[sensor] != (head.height, head.width):
            error = f"expected size {sizes[sensor]}, got {(head.height, head.width)}"
        return {
            "height": head.height, "width": head.width, "n_bands": head.count, "dtype": head.dtype, "crs": head.crs,
            "transform": list(head.transform), "error": error,
        }

    def run(batches):
        for batch in batches:
            rows = [{"path": p, "filename": n, "sensor": s, **header(p, s)} for p, n, s in zip(*(batch[c].to_pylist() for c in ("path", "filename", "sensor")))]
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [("path", pa.string()), ("filename", pa.string()), ("sensor", pa.string()), ("height", pa.int32()),
                     ("width", pa.int32()), ("n_bands", pa.int32()), ("dtype", pa.string()), ("crs", pa.string()),
                     ("transform", pa.list_(pa.float64())), ("error", pa.string())]
                ),
            )

    return named.select("path", "filename", "sensor").mapInArrow(run, HEADER_SCHEMA)


# ---- writing --------------------------------------------------------------------------------------
def encode_column(shape: tuple[int, int], dtype: str = "float32", n_bands: int = 1, transform: tuple[float, ...] | None = None):
    """Arrow function: row-major ARRAY (bands, height, width) -> TIFF bytes."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        from gridcast.functions.kernels import to_block

        block = to_block(values, (n_bands, *shape)).astype(dtype)
        return pa.array([tiff.write_raster(b, transform) for b in block], pa.binary())

    return run


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write (filename, content) rows below ``root``, one file per row, and return (filename, bytes) of what
    was written. Each write is atomic and idempotent, so retried tasks do no harm."""
    base = root.rstrip("/")

    def run(batches):
        for batch in batches:
            sizes = []
            for name, content in zip(batch["filename"].to_pylist(), batch["content"]):
                data = content.as_buffer().to_pybytes()
                write_atomic(f"{base}/{name}", data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch["filename"], pa.array(sizes, pa.int64())], names=["filename", "bytes"])

    written = files.select("filename", "content").mapInArrow(run, "filename string, bytes bigint")
    return materialise(written, "written")


def prediction_faults(preds: DataFrame, manifest: DataFrame, size: tuple[int, int] = dims.TARGET_SIZE) -> DataFrame:
    """Everything that forbids writing: rows on one side only, repeated ids, wrong shape, non-finite values, file
    names that are missing or repeated (one row per name, with its smallest id).
    ``preds`` is (uid, rate ARRAY), ``manifest`` (uid, target_file)."""
    n = size[0] * size[1]
    flags = preds.groupBy("uid").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.coalesce(F.size("rate"), F.lit(-1)) != n).alias("_shape"),
        F.max(F.exists("rate", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).alias("_bad"),
    )
    rows = manifest.groupBy("uid").agg(F.count(F.lit(1)).alias("_m"), F.max(F.col("target_file").isNull()).alias("_unnamed"))
    both = rows.join(flags, "uid", "full")
    twice = manifest.where("target_file IS NOT NULL").groupBy("target_file").agg(F.count(F.lit(1)).alias("_c"), F.min("uid").alias("uid")).where("_c > 1")
    fault = (
        F.when(F.col("_n").isNull(), "no prediction").when(F.col("_m").isNull(), "not in manifest")
        .when((F.col("_n") > 1) | (F.col("_m") > 1), "repeated id")
        .when(F.col("_unnamed"), "no file name").when(F.col("_shape"), "wrong shape").when(F.col("_bad"), "non-finite")
    )
    found = both.select("uid", fault.alias("fault")).where(F.col("fault").isNotNull())
    return found.union(twice.select("uid", F.lit("repeated file name")))


def write_predictions(preds: DataFrame, manifest: DataFrame, root: str, size: tuple[int, int] = dims.TARGET_SIZE, transform: tuple[float, ...] | None = None) -> DataFrame:
    """One float32 raster per manifest row, named by its target file; refuses to write on any fault."""
    faults = prediction_faults(preds, manifest, size).limit(5).collect()
    if faults:
        raise ValueError(f"predictions do not match the manifest: {[tuple(r) for r in faults]}")
    named = manifest.select("uid", "target_file").join(preds.select("uid", "rate"), "uid")
    files = named.select(F.col("target_file").alias("filename"), encode_column(size, transform=transform)("rate").alias("content"))
    return write_files(files, root)


def write_bundle(preds: DataFrame, manifest: DataFrame, raw_manifest: DataFrame, root: str, size: tuple[int, int] = dims.TARGET_SIZE) -> DataFrame:
    """Rasters under ``root/test_files`` and a copy of the manifest beside them."""
    base = root.rstrip("/")
    written = write_predictions(preds, manifest, f"{base}/test_files", size)
    columns = [c for c in dims.MANIFEST_COLUMNS if c in raw_manifest.columns]
    raw_manifest.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{base}/evaluation_target")
    return written
