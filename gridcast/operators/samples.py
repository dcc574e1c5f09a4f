"""Assembling samples: slots meet frames, samples meet targets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridcast import dims
from gridcast.functions.columns import select_bands


def zero_pixels(sensor: Column, mode: str) -> Column:
    sizes = {
        s: len(dims.band_indices(s, mode)) * dims.NATIVE_SIZE[s][0] * dims.NATIVE_SIZE[s][1] for s in dims.SENSORS
    }
    return F.repeat(F.unhex(F.lit("00")).cast("string"), dims.sensor_case(sensor, sizes)).cast("binary")


def cut_bands(frames: DataFrame, mode: str) -> DataFrame:
    """Frames with only the bands of ``mode``, cut before any shuffle."""
    cut = None
    for s in dims.SENSORS:
        part = select_bands(F.col("pixels"), dims.band_indices(s, mode), F.col("height") * F.col("width"))
        cut = F.when(F.col("sensor") == s, part) if cut is None else cut.when(F.col("sensor") == s, part)
    return frames.withColumn("pixels", cut)


def spread_key(name: Column, *ident: Column) -> Column:
    """The join key: the name, or for rows without one a value of their own that matches nothing. NULL keys
    would all meet in one task of a shuffled outer join."""
    return F.coalesce(name, F.concat_ws(":", F.lit("\u0000"), *[i.cast("string") for i in ident]))


def match_slots(slots: DataFrame, frames: DataFrame, payload: list[str]) -> DataFrame:
    """Slots (uid, sensor, t, filename) left-joined to frames (sensor, filename, error, payload...).

    ``outcome``: ``ok``, ``missing`` (no name) or ``corrupt`` (named but absent or unreadable). Names listed by
    very many samples are split by AQE's skew join.
    """
    right = frames.select("sensor", F.col("filename").alias("_key"), F.lit(True).alias("_found"), "error", *payload)
    left = slots.withColumn("_key", spread_key(F.col("filename"), F.col("uid"), F.col("t")))
    joined = left.join(right, ["sensor", "_key"], "left")
    ok = F.coalesce(F.col("_found") & F.col("error").isNull(), F.lit(False))
    return joined.select(
        "uid", "sensor", "t", "filename",
        F.when(ok, "ok").when(F.col("filename").isNull(), "missing").otherwise("corrupt").alias("outcome"),
        *[F.when(ok, F.col(c)).alias(c) for c in payload],
    )


def match_targets(samples: DataFrame, targets: DataFrame, size: int = dims.TARGET_SIZE[0] * dims.TARGET_SIZE[1]) -> DataFrame:
    """Samples (uid, target_file, ...) with ``target`` (zeros where unavailable) and ``target_missing``
    (named but absent or unreadable; a NULL name is not counted)."""
    right = targets.select(F.col("filename").alias("_key"), F.col("rate").alias("_rate"), F.col("error").alias("_error"), F.lit(True).alias("_found"))
    left = samples.withColumn("_key", spread_key(F.col("target_file"), F.col("uid")))
    ok = F.coalesce(F.col("_found") & F.col("_error").isNull(), F.lit(False))
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return left.join(right, "_key", "left").select(
        *samples.columns, F.when(ok, F.col("_rate")).otherwise(zero).alias("target"),
        (~ok & F.col("target_file").isNotNull()).alias("target_missing"),
    )


def outcome_counts(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return matched.groupBy(*by).agg(
        F.count_if(F.col("outcome") == "missing").alias("missing"),
        F.count_if(F.col("outcome") == "corrupt").alias("corrupt"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
    )


def stack_slots(matched: DataFrame, mode: str) -> DataFrame:
    """(uid, frames): the three slots of a sample in time order, zero pixels where nothing was read.
    A group is one sample's three slots."""
    frame = F.struct(
        "t", (F.col("outcome") == "ok").alias("valid"),
        F.coalesce(F.col("pixels"), zero_pixels(F.col("sensor"), mode)).alias("pixels"),
    )
    slots = [F.max(F.when(F.col("t") == t, frame)) for t in range(dims.FRAMES_PER_SAMPLE)]
    return matched.groupBy("uid").agg(F.array(*slots).alias("frames"))


def archive_members(slots: DataFrame, members: DataFrame) -> DataFrame:
    """Slots whose file is present among ``members``."""
    return slots.join(members.select("filename"), "filename", "left_semi")


def file_gaps(expected: DataFrame, present: DataFrame, key: str = "filename") -> DataFrame:
    """Names on one side only: side ``absent`` (expected, not present) or ``extra``."""
    want, have = expected.select(key).distinct(), present.select(key).distinct()
    # one full outer join instead of two anti joins: each side is shuffled once
    both = want.withColumn("_w", F.lit(True)).join(have.withColumn("_h", F.lit(True)), key, "full")
    side = F.when(F.col("_h").isNull(), "absent").when(F.col("_w").isNull(), "extra")
    return both.select(key, side.alias("side")).where(F.col("side").isNotNull())
