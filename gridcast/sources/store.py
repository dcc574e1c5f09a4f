"""The sample store: Parquet partitioned by sensor, built straight from rasters or archives.

A sample's row names its own files, so each task opens what its samples need and writes the finished rows:
only names and offsets are ever shuffled, never pixels.
"""
from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast import dims
from gridcast.functions.rows import unpack
from gridcast.functions.columns import frame_path, target_path
from gridcast.operators.manifest import sensor_counts
from gridcast.operators.samples import spread_key
from gridcast.sources import tiff
from gridcast.scratch import materialise
from gridcast.sources.files import DATA_FAULTS, MemberReader, read_bytes

FRAME_TYPE = "struct<t:int,valid:boolean,outcome:string,size:int,pixels:binary>"
STORE_SCHEMA = (
    "uid string, site string, sensor string, ts timestamp_ntz, target_file string, band_mode string, "
    f"frames array<{FRAME_TYPE}>, target array<float>, target_missing boolean, "
    "n_target int, with_target boolean, spec string"
)
MEMBER_FIELDS = {"offset": "bigint", "size": "bigint", "method": "int", "crc": "bigint"}
PLACE_TYPE = "struct<path:string," + ",".join(f"{n}:{k}" for n, k in MEMBER_FIELDS.items()) + ">"
SAMPLES_PER_TASK = 256
BYTES_PER_TASK = 128 << 20
ROWS_PER_OUTPUT = 16


def locate_in_folders(manifest: DataFrame, root: str, load_targets: bool = True) -> DataFrame:
    """Give every slot and target its place: ``struct<path, offset, size, method>``, NULL when not named."""
    place = lambda p: F.when(
        p.isNotNull(),
        F.struct(p.alias("path"), *[F.lit(None).cast(kind).alias(name) for name, kind in MEMBER_FIELDS.items()]),
    )
    target = target_path(root, F.col("target_file")) if load_targets else F.lit(None).cast("string")
    slots = F.transform("slots", lambda f: F.struct(f.isNotNull().alias("named"), place(frame_path(root, F.col("sensor"), f)).alias("place")))
    return manifest.select("uid", "site", "sensor", "ts", "target_file", slots.alias("places"), place(target).alias("target_place"), F.lit(load_targets).alias("load_target"))


def locate_in_archives(manifest: DataFrame, frame_index: DataFrame, target_index: DataFrame | None = None, load_targets: bool = True) -> DataFrame:
    """The same from archive indexes (joins on names only)."""
    entry = F.struct(F.col("archive").alias("path"), *MEMBER_FIELDS)
    frames = frame_index.select("filename", entry.alias("place"))
    targets = (target_index or frame_index).select(F.col("filename").alias("target_file"), entry.alias("target_place"))
    slots = unpack(manifest, ["uid"], "slots", "t", "filename")
    named = slots.where(F.col("filename").isNotNull()).join(frames, "filename", "left")
    per_sample = named.groupBy("uid").agg(
        F.array(*[
            F.struct(F.coalesce(F.max(F.col("t") == t), F.lit(False)).alias("named"), F.max(F.when(F.col("t") == t, F.col("place"))).alias("place"))
            for t in range(dims.FRAMES_PER_SAMPLE)
        ]).alias("places")
    )
    out = manifest.select("uid", "site", "sensor", "ts", "target_file").join(per_sample, "uid", "left")
    nothing = F.array_repeat(F.struct(F.lit(False).alias("named"), F.lit(None).cast(PLACE_TYPE).alias("place")), dims.FRAMES_PER_SAMPLE)
    out = out.withColumn("places", F.coalesce("places", nothing))
    if load_targets:
        key = spread_key(F.col("target_file"), F.col("uid"))
        out = out.withColumn("_key", key).join(targets.withColumnRenamed("target_file", "_key"), "_key", "left").drop("_key")
    else:
        out = out.withColumn("target_place", F.lit(None).cast(PLACE_TYPE))
    return out.withColumn("load_target", F.lit(load_targets))


def spec_of(band_mode: str, sizes: dict[str, tuple[int, int]], target_size: tuple[int, int]) -> str:
    """What a store was built for, kept in each of its rows."""
    return json.dumps({"bands": band_mode, "frames": {s: list(sizes[s]) for s in sorted(sizes)}, "target": list(target_size)})


def _fetch(reader: MemberReader, place: dict) -> bytes:
    if place["offset"] is None:
        return read_bytes(place["path"])
    return reader.read(*(place[k] for k in ("path", *MEMBER_FIELDS)))


def load_samples(located: DataFrame, band_mode: str, decoder=tiff.read_raster, sizes=None, target_size=dims.TARGET_SIZE) -> DataFrame:
    """Open, check, cut and stack each sample's rasters: a narrow pass over located samples."""
    sizes = sizes or dims.NATIVE_SIZE
    plan = {s: (list(dims.band_indices(s, band_mode)), sizes[s]) for s in dims.SENSORS}
    n_target = target_size[0] * target_size[1]
    kept = ["uid", "site", "sensor", "ts", "target_file"]
    frame_kind = pa.list_(pa.struct([("t", pa.int32()), ("valid", pa.bool_()), ("outcome", pa.string()), ("size", pa.int32()), ("pixels", pa.binary())]))

    spec = spec_of(band_mode, sizes, target_size)

    def stored(t, valid, outcome, pixels):
        return {"t": t, "valid": valid, "outcome": outcome, "size": len(pixels), "pixels": pixels}

    def frame(reader, t, slot, sensor):
        bands, size = plan[sensor]
        outcome = "missing"
        if slot["named"]:
            outcome = "corrupt"
            if slot["place"] is not None:
                try:
                    block, head = decoder(_fetch(reader, slot["place"]))
                    block = tiff.check_frame(block, head, dims.BANDS_TOTAL, size)
                    return stored(t, True, "ok", block[bands].tobytes())
                except DATA_FAULTS:
                    pass
        return stored(t, False, outcome, bytes(len(bands) * size[0] * size[1]))

    def target(reader, place, named):
        if place is not None:
            try:
                block, head = decoder(_fetch(reader, place))
                return tiff.check_target(block, head, target_size).reshape(-1), False
            except DATA_FAULTS:
                pass
        return np.zeros(n_target, np.float32), bool(named)

    def run(batches):
        reader = MemberReader()
        for big in batches:
            for at in range(0, big.num_rows, ROWS_PER_OUTPUT):
                batch = big.slice(at, ROWS_PER_OUTPUT)
                frames, rates, lost = [], [], []
                columns = (batch[c].to_pylist() for c in ("sensor", "places", "target_place", "target_file", "load_target"))
                for sensor, places, place, name, load in zip(*columns):
                    frames.append([frame(reader, t, slot, sensor) for t, slot in enumerate(places)])
                    rate, missing = target(reader, place, load and name is not None)
                    rates.append(rate)
                    lost.append(missing)
                yield pa.RecordBatch.from_arrays(
                    [batch[c] for c in kept]
                    + [pa.array([band_mode] * batch.num_rows), pa.array(frames, frame_kind), pa.array(rates, pa.list_(pa.float32())), pa.array(lost)]
                    + [pa.array([len(r) for r in rates], pa.int32()), batch["load_target"], pa.array([spec] * batch.num_rows)],
                    names=[*kept, "band_mode", "frames", "target", "target_missing", "n_target", "with_target", "spec"],
                )
        reader.close()

    return located.mapInArrow(run, STORE_SCHEMA)


def is_complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def write_store(located: DataFrame, path: str, band_mode: str, load_targets: bool | None = None, **reading) -> bool:
    """Build the store unless a finished one is there; an unfinished one is replaced. Returns whether it built.
    A finished store of other bands or grid sizes is an error, so is one with or without targets where
    ``load_targets`` says otherwise, and a sample that is listed twice.

    Located names are written once. Tasks are cut by (sensor, uid) ranges of equal sample counts, more of them where an
    index tells that members are large: the manifest is tiny beside its pixels, so its byte size says nothing about
    the work, and a file's uid range stays narrow for pruning on read.
    """
    spark = located.sparkSession
    if is_complete(spark, path):
        want = spec_of(band_mode, reading.get("sizes") or dims.NATIVE_SIZE, reading.get("target_size", dims.TARGET_SIZE))
        other = [r for r in read_store(spark, path).select("spec", "with_target").distinct().collect() if r.spec != want or load_targets not in (None, r.with_target)]
        if other:
            raise ValueError(f"the finished store at {path} was built for {other[0].spec}, targets {other[0].with_target}, not for {want}, targets {load_targets}")
        return False
    located = materialise(located, "located")
    size = lambda place: F.coalesce(place["size"], F.lit(0).cast("bigint"))
    per_row = F.aggregate("places", F.lit(0).cast("bigint"), lambda a, s: a + size(s["place"])) + size(F.col("target_place"))
    per_uid = located.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum(per_row).alias("bytes"))
    n, total, repeated = per_uid.agg(F.sum("n"), F.sum("bytes"), F.min(F.when(F.col("n") > 1, F.struct("uid")))).first()
    if repeated is not None:
        raise ValueError(f"samples are listed more than once, such as {repeated.uid!r}")
    tasks = max(spark.sparkContext.defaultParallelism, -(-(n or 0) // SAMPLES_PER_TASK), -(-(total or 0) // BYTES_PER_TASK))
    spread = located.repartitionByRange(tasks, "sensor", "uid").sortWithinPartitions("sensor", "uid")
    load_samples(spread, band_mode, **reading).write.mode("overwrite").partitionBy("sensor").parquet(path)
    return True


def build_from_folders(manifest: DataFrame, root: str, path: str, band_mode: str = "ir_only", load_targets: bool = True, limit: int | None = None, **reading) -> bool:
    rows = manifest.orderBy("row_idx").limit(limit) if limit is not None else manifest
    return write_store(locate_in_folders(rows, root, load_targets), path, band_mode, load_targets, **reading)


def build_from_archives(manifest: DataFrame, frame_index: DataFrame, path: str, band_mode: str = "ir_only", target_index: DataFrame | None = None, load_targets: bool = True, limit: int | None = None, **reading) -> bool:
    rows = manifest.orderBy("row_idx").limit(limit) if limit is not None else manifest
    return write_store(locate_in_archives(rows, frame_index, target_index, load_targets), path, band_mode, load_targets, **reading)


def read_store(spark: SparkSession, path: str, sensor: str | None = None, uids: DataFrame | None = None) -> DataFrame:
    """Stored samples; ``sensor`` prunes partitions, ``uids`` semi-joins."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(path)
    if sensor is not None:
        rows = rows.where(F.col("sensor") == sensor)
    return rows if uids is None else rows.join(uids, "uid", "left_semi")


def store_counters(store: DataFrame) -> DataFrame:
    """Missing and corrupt slots and unavailable targets; reads the outcomes, not the pixels."""
    seen = store.select("sensor", "target_missing", F.col("frames.outcome").alias("outcome"))
    n = lambda kind: F.sum(F.size(F.filter("outcome", lambda o: o == kind)))
    return seen.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("samples"), n("missing").alias("missing"), n("corrupt").alias("corrupt"),
        F.count_if("target_missing").alias("targets_missing"),
    )


def audit_store(store: DataFrame, manifest: DataFrame, band_mode: str, sizes=None, target_size=dims.TARGET_SIZE) -> DataFrame:
    """Per sensor: stored and expected counts, pixel length range and whether everything fits. Lengths are those that
    were stored beside the pixels; pixels are read of the first and the last sample of each sensor only, and must be
    as long as their row says."""
    sizes = sizes or dims.NATIVE_SIZE
    length = {s: len(dims.band_indices(s, band_mode)) * sizes[s][0] * sizes[s][1] for s in dims.SENSORS}
    found = store_sizes(store)
    want = target_size[0] * target_size[1]
    expected = dims.sensor_case(F.col("sensor"), length)
    empty = (F.col("n") == 0) & F.col("stored").isNull()
    fits = (F.col("stored") == F.col("n")) & (F.col("min_length") == expected) & (F.col("max_length") == expected) & (F.col("_t0") == want) & (F.col("_t1") == want)
    fits = fits & ~F.coalesce("sensor", F.lit("")).isin(broken_ends(store))
    return sensor_counts(manifest).join(found, "sensor", "left").select(
        "sensor", F.col("n").alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored"), "min_length", "max_length",
        F.coalesce(fits | empty, F.lit(False)).alias("complete"),
    )


def store_sizes(store: DataFrame) -> DataFrame:
    """Per sensor: samples, shortest and longest frame and target by the stored lengths. Reads no pixel."""
    seen = store.select("sensor", F.array_min("frames.size").alias("lo"), F.array_max("frames.size").alias("hi"), "n_target")
    return seen.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("stored"), F.min("lo").alias("min_length"), F.max("hi").alias("max_length"),
        F.min("n_target").alias("_t0"), F.max("n_target").alias("_t1"),
    )


def broken_ends(store: DataFrame) -> list[str]:
    """Sensors whose first or last sample has pixels or a target of another length than its row says. The driver holds
    two names per sensor; they are pushed into the scan, and files are sorted by them."""
    ends = store.groupBy("sensor").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).collect()
    places = [(F.col("sensor") == r.sensor) & F.col("uid").isin(r.lo, r.hi) for r in ends if r.lo is not None]
    if not places:
        return []
    rows = store.where(reduce(lambda a, b: a | b, places))
    right = F.forall("frames", lambda f: F.octet_length(f["pixels"]) == f["size"]) & (F.size("target") == F.col("n_target"))
    return [r.sensor for r in rows.where(~F.coalesce(right, F.lit(False))).select("sensor").distinct().collect()]
