"""Grid augmentation: draws fixed by (seed, uid), the same for features and target."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridcast.functions.columns import unit_draw
from gridcast.functions.kernels import noise_column, normal_draws, orient, orient_column


@dataclass(frozen=True)
class Augmentation:
    horizontal_flip: float = 0.0
    vertical_flip: float = 0.0
    rotate90: float = 0.0
    noise_enabled: bool = False
    noise_sigma: float = 0.0


# Fixed profiles: the full one raises sigma but leaves the noise off.
PROFILES = {
    "none": Augmentation(),
    "base": Augmentation(0.5, 0.5, 0.5),
    "full": Augmentation(0.5, 0.5, 0.5, noise_enabled=False, noise_sigma=2.0),
}


def draw_orientation(rows: DataFrame, profile: Augmentation, seed: int, uid: str = "uid") -> DataFrame:
    """``flip_x``, ``flip_y`` (BOOLEAN) and ``turns`` (0..3, counter-clockwise quarters)."""
    key = F.col(uid)
    turned = unit_draw(seed, "rotate", key) < profile.rotate90
    return rows.withColumns(
        {
            "flip_x": unit_draw(seed, "flip_x", key) < profile.horizontal_flip,
            "flip_y": unit_draw(seed, "flip_y", key) < profile.vertical_flip,
            "turns": F.when(turned, F.floor(unit_draw(seed, "turns", key) * 3).cast("int") + 1).otherwise(0),
        }
    )


def augment(rows: DataFrame, profile: Augmentation, seed: int, grids: dict[str, tuple[int, int, int]], uid: str = "uid", noisy: tuple[str, ...] = ()) -> DataFrame:
    """Turn the ARRAY columns in ``grids`` (name -> planes, height, width) alike; ``noisy`` columns get
    Gaussian noise when the profile enables it: one hash per row, the rest by mixing it with positions."""
    drawn = draw_orientation(rows, profile, seed, uid)
    for name, (planes, height, width) in grids.items():
        turn = orient_column((height, width), planes)
        drawn = drawn.withColumn(name, turn(name, "flip_x", "flip_y", "turns"))
    if profile.noise_enabled and profile.noise_sigma > 0:
        for name in noisy:
            digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(f"noise-{name}"), F.col(uid).cast("string")).cast("binary"))
            drawn = drawn.withColumn(name, noise_column(profile.noise_sigma)(name, digest))
    return drawn


def transform_of(profile: Augmentation, seed: int):
    """The profile as a step of the feature records: the same draws as :func:`augment`, for features and target alike;
    noise goes to the features only, from a generator keyed by (seed, uid)."""

    def draw(op: str, uid) -> float:
        return int(hashlib.md5(f"{seed}:{op}:{uid}".encode()).hexdigest()[:8], 16) / 4294967296.0

    def run(features: np.ndarray, target: np.ndarray, uid) -> tuple[np.ndarray, np.ndarray]:
        flip_x, flip_y = draw("flip_x", uid) < profile.horizontal_flip, draw("flip_y", uid) < profile.vertical_flip
        turns = 1 + int(draw("turns", uid) * 3) if draw("rotate", uid) < profile.rotate90 else 0
        features, target = (orient(g, flip_x, flip_y, turns) for g in (features, target))
        if profile.noise_enabled and profile.noise_sigma > 0:
            key = int(hashlib.md5(f"{seed}:noise-features:{uid}".encode()).hexdigest()[:16], 16)
            noise = normal_draws(key, features.size).reshape(features.shape).astype(np.float32)
            features = features + np.float32(profile.noise_sigma) * noise
        return features, target

    return run
