"""Combining several runs."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridcast import dims
from gridcast.functions.columns import drizzle_cut, path_filename
from gridcast.scratch import materialise
from gridcast.sources import tiff
from gridcast.sources.files import read_bytes
from gridcast.sources.raster_writer import save_files
from gridcast.sources.rasters import bundled

TASK_BYTES = 128 << 20  # of rasters that one task combines


def run_weights(runs: list[str], weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights normalised to 1; a run without one counts 1; fewer than two runs cannot be combined."""
    if len(runs) < 2:
        raise ValueError(f"need at least 2 runs, found {len(runs)}")
    raw = {r: float((weights or {}).get(r, 1.0)) for r in sorted(runs)}
    total = sum(raw.values())
    return {r: w / total for r, w in raw.items()}


def weight_column(run: Column, weights: dict[str, float]) -> Column:
    """The weight as a map literal: the list of runs is the caller's, so its size is known."""
    pairs = [F.lit(v) for item in weights.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), run)


def coverage(files: DataFrame, run: str = "run", name: str = "filename") -> DataFrame:
    """Runs per file."""
    return files.groupBy(name, run).agg(F.count(F.lit(1)).alias("_c")).groupBy(name).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("_c").alias("n_rows")
    )


def coverage_gaps(files: DataFrame, n_runs: int, run: str = "run", name: str = "filename") -> DataFrame:
    """Files that some run lacks or holds twice."""
    return coverage(files, run, name).where((F.col("n_runs") != n_runs) | (F.col("n_rows") != n_runs))


def combine_pixels(pixels: DataFrame, keys: list[str], weights: dict[str, float], run: str = "run", rate: str = "rate", cap: float = 60.0, floor: float = 0.15) -> DataFrame:
    """Weighted mean of long-form pixels, clipped and cut. A pixel that a run lacks or holds twice, a NULL rate and a
    run without a weight fail."""
    weight = F.coalesce(weight_column(F.col(run), weights), F.raise_error(F.concat(F.lit("unlisted run "), F.col(run))).cast("double"))
    number = F.create_map(*[F.lit(x) for i, r in enumerate(weights) for x in (r, i)])[F.col(run)]
    marks = [
        F.when((number >= i) & (number < i + 60), F.call_function("shiftleft", F.lit(1).cast("long"), (number - i).cast("int"))).otherwise(F.lit(0).cast("long"))
        for i in range(0, len(weights), 60)
    ]
    sums = pixels.groupBy(*keys).agg(
        F.sum(weight * F.col(rate).cast("double")).alias("_m"), F.count(rate).alias("_n"), F.count(F.lit(1)).alias("_rows"),
        *[F.bit_or(m).alias(f"_seen{i}") for i, m in enumerate(marks)],
    )
    # as many rows as runs, each with a rate, and every run's bit seen: each run once
    whole = (F.col("_n") == len(weights)) & (F.col("_rows") == len(weights))
    for i in range(len(marks)):
        whole = whole & (F.col(f"_seen{i}") == F.lit((1 << min(60, len(weights) - 60 * i)) - 1))
    mean = F.when(whole, F.col("_m")).otherwise(F.raise_error(F.lit("runs do not cover every pixel once")).cast("double"))
    return sums.select(*keys, drizzle_cut(mean, cap, floor).alias(rate))


def combine_grids(grids: DataFrame, weights: dict[str, float], run: str = "run", name: str = "filename", rate: str = "rate", cap: float = 60.0, floor: float = 0.15) -> DataFrame:
    """Weighted mean of grid rows (run, filename, rate ARRAY). One row per run and file moves, never pixels.

    Each run fills its own slot by an aggregate, so a group holds as many grids as there are runs, whatever
    the number of rows. A file that a run lacks, or lists twice, fails.
    """
    slots = [F.max(F.when(F.col(run) == r, F.col(rate))).alias(f"_r{i}") for i, r in enumerate(weights)]
    known = F.when(F.col(run).isin(*weights), F.col(run)).otherwise(F.raise_error(F.concat(F.lit("unlisted run "), F.col(run))).cast("string"))
    wide = grids.withColumn(run, known).groupBy(name).agg(F.count(F.lit(1)).alias("_n"), *slots)
    lacks = F.col("_n") != len(weights)
    for i in range(len(weights)):
        lacks = lacks | F.col(f"_r{i}").isNull()
    total = None
    for i, w in enumerate(weights.values()):
        part = F.transform(F.col(f"_r{i}"), _times(w))
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    mean = F.when(lacks, F.raise_error(F.concat(F.lit("runs do not cover "), F.col(name))).cast("array<double>")).otherwise(total)
    return wide.select(name, F.transform(mean, lambda v: drizzle_cut(v, cap, floor).cast("float")).alias(rate))


def _times(w: float):
    return lambda v: v.cast("double") * w


def missing_outputs(manifest: DataFrame, outputs: DataFrame, name: str = "filename") -> DataFrame:
    """Manifest rows a run has not produced yet."""
    return manifest.join(outputs.select(name), name, "left_anti")


def run_is_complete(manifest: DataFrame, outputs: DataFrame, name: str = "filename") -> bool:
    """Whether a run can be skipped: nothing of the manifest is missing."""
    return missing_outputs(manifest, outputs, name).isEmpty()


def run_files(spark: SparkSession, runs: dict[str, str], pattern: str = "*.tif") -> DataFrame:
    """(run, filename, path, length) of the files in each run's folder. Contents are not read."""
    listed = None
    for run, folder in sorted(runs.items()):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        files = bundled(files).select(F.lit(run).alias("run"), path_filename(F.col("path")).alias("filename"), "path", "length")
        listed = files if listed is None else listed.unionByName(files)
    return listed


def combine_runs(
    spark: SparkSession, runs: dict[str, str], out: str, weights: dict[str, float] | None = None, size: tuple[int, int] = dims.TARGET_SIZE,
    cap: float = 60.0, floor: float = 0.15, mode: str = "overwrite", decoder=tiff.read_raster,
) -> None:
    """Weighted mean of the rasters of several run folders (name -> folder), one raster per file name below ``out``.

    Only names are joined. A task then opens one file of each run, so no raster is shuffled and it holds as many grids
    as there are runs. Fewer than two runs, a file that a run lacks or holds twice, or a raster that cannot be read
    refuses or fails the job, and ``out`` stays as it was: files are moved into place when all are written.
    """
    share = run_weights(list(runs), weights)
    names = materialise(run_files(spark, runs), "run_files")
    gaps = coverage_gaps(names, len(runs)).limit(5).collect()
    if gaps:
        raise ValueError(f"runs do not hold the same files: {[tuple(r) for r in gaps]}")
    slots = [F.max(F.when(F.col("run") == r, F.col("path"))).alias(f"_p{i}") for i, r in enumerate(share)]
    total = names.agg(F.sum("length")).first()[0] or 0
    wide = names.groupBy("filename").agg(*slots).repartition(max(spark.sparkContext.defaultParallelism, int(total // TASK_BYTES) + 1), "filename")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                contents = []
                for paths in zip(*(part[f"_p{i}"].to_pylist() for i in range(len(share)))):
                    mean = np.zeros(size)
                    for path, weight in zip(paths, share.values()):
                        try:
                            mean += weight * tiff.check_target(*decoder(read_bytes(path)), size)
                        except tiff.RasterError as e:
                            raise ValueError(f"{path}: {e}") from e
                    mean = np.clip(mean, 0.0, cap)
                    mean[mean < floor] = 0.0
                    contents.append(tiff.write_raster(mean.astype(np.float32)[None]))
                yield pa.RecordBatch.from_arrays([part["filename"], pa.array(contents, pa.binary())], names=["filename", "content"])

    save_files(wide.mapInArrow(run, "filename string, content binary"), out, mode)
