"""Per-sensor, per-band statistics and standardisation."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridcast import dims
from gridcast.functions.rows import unpack
from gridcast.functions.columns import draw_order
from gridcast.operators.ordered import first_per_group

STD_FLOOR = 1e-6


def guarded_std(std: Column) -> Column:
    return F.when(std <= STD_FLOOR, 1.0).otherwise(std)


def value_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population mean and standard deviation per group of long-form values; partial sums shuffle only."""
    x = F.col(value).cast("double")
    return values.groupBy(*keys).agg(
        F.avg(x).alias("mean"), guarded_std(F.stddev_pop(x)).alias("std"), F.count(x).alias("n_pixels")
    )


def strided(pixels: DataFrame, stride: int, y: str = "y", x: str = "x") -> DataFrame:
    """Every ``stride``-th row and column of long-form pixels."""
    return pixels.where((F.col(y) % stride == 0) & (F.col(x) % stride == 0))


def sums_column(stride: int = 1):
    """Arrow function (pixels BINARY, bands, height, width) -> per band n, sum and sum of squares, exact."""

    @F.arrow_udf("array<struct<n:bigint,s:bigint,ss:bigint>>")
    def run(pixels: pa.Array, n_bands: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for raw, b, h, w in zip(pixels, n_bands.to_pylist(), height.to_pylist(), width.to_pylist()):
            if not raw.is_valid:
                out.append(None)
                continue
            block = np.frombuffer(raw.as_buffer(), np.uint8).reshape(b, h, w)[:, ::stride, ::stride]
            block = block.reshape(b, -1).astype(np.int64)
            sums, squares = block.sum(axis=1), (block * block).sum(axis=1)
            out.append([{"n": block.shape[1], "s": int(s), "ss": int(q)} for s, q in zip(sums, squares)])
        kind = pa.list_(pa.struct([("n", pa.int64()), ("s", pa.int64()), ("ss", pa.int64())]))
        return pa.array(out, kind)

    return run


def frame_stats(frames: DataFrame, stride: int = 1) -> DataFrame:
    """Statistics over decoded frames (sensor, pixels, n_bands, height, width, error).

    Unreadable frames are left out. A frame shrinks to 16 exact integer sums before any shuffle, and the
    variance is computed on decimals, so the result does not depend on the order of addition.
    """
    good = frames.where(F.col("error").isNull())
    sums = good.select("sensor", sums_column(stride)("pixels", "n_bands", "height", "width").alias("_sums"))
    bands = unpack(sums, ["sensor"], "_sums", "band", "_s")
    wide = "decimal(38,0)"
    totals = bands.groupBy("sensor", "band").agg(
        F.sum("_s.n").alias("n_pixels"),
        F.sum(F.col("_s.s").cast("decimal(28,0)")).cast(wide).alias("_sum"),
        F.sum(F.col("_s.ss").cast("decimal(28,0)")).cast(wide).alias("_squares"),
    )
    n = F.col("n_pixels").cast("double")
    mean = F.try_divide(F.col("_sum").cast("double"), n)
    # n*sum(x^2) - sum(x)^2 is an exact integer
    spread = (
        F.col("n_pixels").cast("decimal(18,0)") * F.col("_squares").cast("decimal(20,0)")
        - F.col("_sum").cast("decimal(19,0)") * F.col("_sum").cast("decimal(19,0)")
    ).cast("double")
    std = F.sqrt(spread) / n
    measured = totals.select("sensor", "band", mean.alias("_mean"), guarded_std(std).alias("_std"), "n_pixels")
    return (
        dims.bands(frames.sparkSession).join(measured, ["sensor", "band"], "left")
        .select(
            "sensor", "band",
            F.coalesce("_mean", F.lit(0.0)).alias("mean"),
            F.coalesce("_std", F.lit(1.0)).alias("std"),
            F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"),
        )
    )


def sample_files(slots: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` listed frames per sensor, without replacement. Each listing counts: a file named by two samples
    is drawn twice as often. Runs on names, so unsampled rasters are never opened."""
    listed = slots.where(F.col("filename").isNotNull())
    draw = draw_order(seed, F.col("sensor"), F.col("filename"), F.col("uid"), F.col("t"))
    return first_per_group(listed.withColumn("_draw", draw), ["sensor"], ["_draw", "uid", "t"], k).drop("_draw")


def standardise_long(values: DataFrame, stats: DataFrame, value: str = "value") -> DataFrame:
    """Rows plus ``z``. ``stats`` has one row per (sensor, band): at most 3 x 16, so it is broadcast."""
    bounded = stats.where(F.col("sensor").isin(*dims.SENSORS)).where(F.col("band") < dims.BANDS_TOTAL)
    joined = values.join(F.broadcast(bounded.select("sensor", "band", "mean", "std")), ["sensor", "band"])
    return joined.withColumn("z", (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def stats_arrays(stats: DataFrame, keys: list[str], band: str) -> DataFrame:
    """One row per key with ``means`` and ``stds`` in band order."""
    packed = F.array_sort(F.collect_list(F.struct(band, "mean", "std")))
    return stats.groupBy(*keys).agg(packed.alias("_p")).select(
        *keys, F.col("_p.mean").alias("means"), F.col("_p.std").alias("stds")
    )


def standardise_array(values: Column, means: Column, stds: Column) -> Column:
    centred = F.zip_with(values, means, lambda x, m: x.cast("double") - m)
    return F.zip_with(centred, stds, lambda d, s: d / s)
