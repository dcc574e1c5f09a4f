"""Feature records from stored samples: one narrow Arrow pass per sample, no shuffle."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridcast import dims
from gridcast.functions import columns as fx
from gridcast.functions.kernels import resize, resize_taps

# (features (C, H, W) float32, raw target (h, w) float32, uid) -> both, turned alike, with their shapes unchanged
Transform = Callable[[np.ndarray, np.ndarray, object], tuple[np.ndarray, np.ndarray]]

ROWS_PER_OUTPUT = 16  # a 50x96x96 record is 1.8 MB


@dataclass(frozen=True)
class FeatureConfig:
    image_size: int = 96
    interpolation: str = "bilinear"
    bands: str = "ir_only"
    stored_bands: str = "ir_only"
    include_differences: bool = True
    missing_frames: str = "repeat_last"
    rain_threshold: float = dims.RAIN_MM_H
    pad_channels: bool = True
    sizes: dict | None = None  # per sensor; the native sizes unless given

    @property
    def steps(self) -> int:
        n = dims.FRAMES_PER_SAMPLE
        return 2 * n - 1 if self.include_differences else n

    @property
    def channels(self) -> int:
        return dims.max_channels(self.bands) * self.steps


def collect_stats(stats: DataFrame) -> dict[tuple[str, int], tuple[float, float]]:
    """Statistics as a dict: (sensor, band) is a key of a fixed 3 x 16 dimension, which is checked."""
    limit = len(dims.SENSORS) * dims.BANDS_TOTAL
    rows = stats.select("sensor", "band", "mean", "std").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} statistics rows")
    return {(r["sensor"], r["band"]): (r["mean"], r["std"]) for r in rows}


def fill_order(valid: list[bool]) -> list[int]:
    """Which frame each slot shows after the repeat-last fill."""
    good = [t for t, v in enumerate(valid) if v]
    if not good:
        return list(range(len(valid)))
    return [max((g for g in good if g <= t), default=good[0]) for t in range(len(valid))]


def feature_block(frames: np.ndarray, valid: list[bool], mean, std, config: FeatureConfig) -> np.ndarray:
    """(T, C, H, W) uint8 -> (channels, image_size, image_size) float32."""
    order = fill_order(valid) if config.missing_frames == "repeat_last" else range(len(valid))
    size = (config.image_size, config.image_size)
    n_bands, n_frames = frames.shape[1], len(valid)
    n_out = n_bands * (2 * n_frames - 1 if config.include_differences else n_frames)
    out = np.zeros((max(n_out, config.channels if config.pad_channels else 0), *size), np.float32)
    stack = out[: n_bands * n_frames].reshape(n_frames, n_bands, *size)
    for t, source in enumerate(order):
        if source in order[:t]:  # the same frame again
            stack[t] = stack[order.index(source)]
            continue
        z = frames[source].astype(np.float32)
        z -= mean[:, None, None]
        z /= std[:, None, None]
        stack[t] = resize(z, size, config.interpolation)
    if config.include_differences:
        steps = out[n_bands * n_frames : n_out].reshape(n_frames - 1, n_bands, *size)
        np.subtract(stack[1:], stack[:-1], out=steps)
    return out


def transformed(transform: Transform, block: np.ndarray, target: list | None, size: tuple[int, int], uid) -> tuple[np.ndarray, np.ndarray | None]:
    grid = None if target is None else np.array(target, np.float32).reshape(size)
    # a sample without a target is turned with a grid of zeros
    out, turned = transform(block, np.zeros(size, np.float32) if grid is None else grid, uid)
    if out.shape != block.shape or turned.shape != tuple(size):
        raise ValueError(f"the transform changed shapes: {block.shape} to {out.shape}, {tuple(size)} to {turned.shape}")
    return np.ascontiguousarray(out, np.float32), None if grid is None else np.ascontiguousarray(turned, np.float32)


def image_features(
    samples: DataFrame, stats: DataFrame, config: FeatureConfig, keep: list[str], transform: Transform | None = None,
    target_size: tuple[int, int] = dims.TARGET_SIZE,
) -> DataFrame:
    """``keep`` columns plus ``features`` ARRAY<FLOAT>, ``channels`` and ``image_size``. A ``transform`` gets a sample's
    features and its raw target in the same pass; ``keep`` must then name ``uid`` and ``target``."""
    if transform is not None and not {"uid", "target"} <= set(keep):
        raise ValueError("a transform needs uid and target among the kept columns")
    if config.missing_frames not in ("repeat_last", "zero"):
        raise ValueError(f"unknown missing-frame strategy {config.missing_frames!r}")
    resize_taps(4, 4, config.interpolation)
    known = collect_stats(stats)
    plan = {}
    for s in dims.SENSORS:
        wanted = dims.band_indices(s, config.bands)
        pairs = np.array([known.get((s, b), (0.0, 1.0)) for b in wanted], dtype=np.float32)
        stored = len(dims.band_indices(s, config.stored_bands))
        plan[s] = (list(dims.stored_positions(s, config.stored_bands, config.bands)), stored, pairs[:, 0], pairs[:, 1])

    needed = list(dict.fromkeys([*keep, "sensor", "frames"]))
    source = samples.select(*needed)
    fields = [source.schema[c] for c in keep]
    schema = T.StructType(
        fields
        + [
            T.StructField("features", T.ArrayType(T.FloatType())),
            T.StructField("channels", T.IntegerType()),
            T.StructField("image_size", T.IntegerType()),
        ]
    )
    n_keep = len(keep)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, ROWS_PER_OUTPUT):
                batch = big.slice(at, ROWS_PER_OUTPUT)
                rows, widths, targets = [], [], []
                uids = batch["uid"].to_pylist() if transform else [None] * batch.num_rows
                grids = batch["target"].to_pylist() if transform else uids
                for sensor, frames, uid, grid in zip(batch["sensor"].to_pylist(), batch["frames"].to_pylist(), uids, grids):
                    positions, stored, mean, std = plan[sensor]
                    h, w = (config.sizes or dims.NATIVE_SIZE)[sensor]
                    stack = np.stack(
                        [np.frombuffer(f["pixels"], np.uint8).reshape(stored, h, w)[positions] for f in frames]
                    )
                    block = feature_block(stack, [f["valid"] for f in frames], mean, std, config)
                    if transform:
                        block, grid = transformed(transform, block, grid, target_size, uid)
                        targets.append(None if grid is None else grid.reshape(-1))
                    rows.append(block.reshape(-1))
                    widths.append(block.shape[0])
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
                size = pa.array([config.image_size] * len(rows), pa.int32())
                kept = {c: batch[c] for c in keep}
                if transform:
                    kept["target"] = pa.array(targets, pa.list_(pa.float32()))
                columns = [*kept.values(), features, pa.array(widths, pa.int32()), size]
                names = [*keep, "features", "channels", "image_size"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def feature_records(
    samples: DataFrame, stats: DataFrame, config: FeatureConfig = FeatureConfig(), site_ids: DataFrame | None = None,
    transform: Transform | None = None, target_size: tuple[int, int] = dims.TARGET_SIZE,
) -> DataFrame:
    """The full training record: image features, targets in three forms, ids, masks and time features. A ``transform``
    turns features and raw target together, before the log target and the rain mask are derived."""
    keep = ["uid", "sensor", "site", "ts", "target"]
    if site_ids is not None:  # joined while rows are small; a NULL site has no id
        samples = samples.join(site_ids, "site", "left")
        keep = [*keep, *[c for c in site_ids.columns if c != "site"]]
    base = samples.withColumn("valid", F.transform("frames", lambda f: f["valid"]))
    out = image_features(base, stats, config, keep + ["valid"], transform, target_size)
    rate = F.col("target")
    out = out.withColumns(
        {
            "sensor_id": fx.sensor_id(F.col("sensor")),
            "target_log": F.transform(rate, lambda r: fx.log_target(r).cast("float")),
            "rain_mask": F.transform(rate, lambda r: fx.rain_mask(r, config.rain_threshold, "float")),
            "has_data": fx.has_data(F.col("valid")).cast("float"),
            "valid_mask": F.transform("valid", lambda v: v.cast("float")),
        }
    ).withColumn("aux", fx.aux_vector(F.col("sensor_id"), F.col("ts")))
    return out
