"""NumPy kernels on stacks of grids, shape (N, H, W), and the Arrow functions that apply them.

Each Arrow function turns one ARRAY column batch into one NumPy block without a Python loop over rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


# ---- noise ----------------------------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 32-bit integers."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(15))


def normal_draws(key: int, n: int) -> np.ndarray:
    """``n`` standard normal values fixed by a 64-bit key: position and key are mixed to two uniform numbers, the first in
    the open interval, and these turned by Box-Muller."""
    low, high = np.uint32(key & 0xFFFFFFFF), np.uint32(key >> 32)
    counter = np.arange(2 * n, dtype=np.uint32)
    bits = mixed(mixed(counter ^ low) ^ high).astype(np.float64).reshape(n, 2)
    radius = np.sqrt(np.log((bits[:, 0] + 0.5) / 4294967296.0) * -2.0)
    return radius * np.cos(bits[:, 1] / 4294967296.0 * 6.283185307179586)


def noise_column(sigma: float):
    """Arrow function (ARRAY, hexadecimal digest) -> ARRAY<DOUBLE>: Gaussian noise added, keyed by the first 16 digits.
    A NULL grid or value stays NULL."""

    @F.arrow_udf("array<double>")
    def run(grid: pa.Array, digest: pa.Array) -> pa.Array:
        lengths = np.where(grid.is_valid().to_numpy(zero_copy_only=False), np.diff(grid.offsets.to_numpy()), 0)
        flat = grid.flatten().cast(pa.float64())
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        draws = [normal_draws(int(d[:16], 16), n) for d, n in zip(digest.to_pylist(), lengths)]
        values = flat.fill_null(0.0).to_numpy(zero_copy_only=False) + sigma * np.concatenate([np.empty(0), *draws])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, mask=~known), mask=grid.is_null())

    return run


# ---- resize ---------------------------------------------------------------------------------------
def resize_taps(n_in: int, n_out: int, mode: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """One axis as a list of (source index, weight) per output; half-pixel centres, edge taps clamped."""
    dst = np.arange(n_out)
    if mode == "nearest":
        return [(np.minimum(dst * n_in // n_out, n_in - 1), np.ones(n_out))]
    src = (dst + 0.5) * n_in / n_out - 0.5
    if mode == "bilinear":
        src = np.maximum(src, 0.0)
        base = np.floor(src).astype(int)
        part = src - base
        taps = [(0, 1.0 - part), (1, part)]
    elif mode == "bicubic":
        a = -0.75  # fixed cubic coefficient
        base = np.floor(src).astype(int)
        part = src - base

        def cubic(d):
            d = np.abs(d)
            near = ((a + 2) * d - (a + 3)) * d * d + 1
            far = a * (((d - 5) * d + 8) * d - 4)
            return np.where(d <= 1, near, far)

        taps = [(k, cubic(part - k)) for k in (-1, 0, 1, 2)]
    else:
        raise ValueError(f"unknown interpolation {mode!r}")
    return [(np.clip(base + step, 0, n_in - 1), w) for step, w in taps]


def resize(grids: np.ndarray, size: tuple[int, int], mode: str = "bilinear") -> np.ndarray:
    """Resize the last two axes in the grids' own precision; grids of that size are returned as they are."""
    if grids.shape[-2:] == tuple(size):
        return grids
    for axis, n_out in ((-2, size[0]), (-1, size[1])):
        out = None
        for index, weight in resize_taps(grids.shape[axis], n_out, mode):
            w = weight.astype(grids.dtype)
            part = np.take(grids, index, axis=axis)
            if mode != "nearest":
                part *= w[:, None] if axis == -2 else w
            out = part if out is None else np.add(out, part, out=out)
        grids = out
    return grids


# ---- neighbourhoods -------------------------------------------------------------------------------
def _shifted(grids: np.ndarray, radius: int):
    n, h, w = grids.shape
    padded = np.zeros((n, h + 2 * radius, w + 2 * radius))
    padded[:, radius : radius + h, radius : radius + w] = grids
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            yield dy - radius, dx - radius, padded[:, dy : dy + h, dx : dx + w]


def sobel_difference(pred: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per-pixel L1 distance of the Sobel gradients, zero padding (the filter is linear)."""
    gx = np.zeros(pred.shape)
    gy = np.zeros(pred.shape)
    for dy, dx, window in _shifted(pred - target, 1):
        gx += dx * (2 - abs(dy)) * window
        gy += dy * (2 - abs(dx)) * window
    return np.abs(gx) + np.abs(gy)


def box_mean(grids: np.ndarray, size: int = 7) -> np.ndarray:
    """Mean over a size x size window with zero padding; the divisor is always size squared."""
    r = size // 2
    padded = np.pad(grids, ((0, 0), (r + 1, r), (r + 1, r)))
    total = padded.cumsum(axis=1).cumsum(axis=2)
    s = size
    return (total[:, s:, s:] - total[:, :-s, s:] - total[:, s:, :-s] + total[:, :-s, :-s]) / (s * s)


def ssim_loss(pred: np.ndarray, target: np.ndarray, size: int = 7) -> np.ndarray:
    """Per-pixel 1 - SSIM with the index clamped to [-1, 1]."""
    c1, c2, floor = 1e-4, 9e-4, 1e-8  # fixed stabilisers
    mp, mt = box_mean(pred, size), box_mean(target, size)
    vp = box_mean(pred * pred, size) - mp * mp
    vt = box_mean(target * target, size) - mt * mt
    cov = box_mean(pred * target, size) - mp * mt
    above = (2 * mp * mt + c1) * (2 * cov + c2)
    below = (mp * mp + mt * mt + c1) * (vp + vt + c2)
    return 1.0 - np.clip(above / np.maximum(below, floor), -1.0, 1.0)


# ---- flips ----------------------------------------------------------------------------------------
def orient(grids: np.ndarray, flip_x: bool, flip_y: bool, quarter_turns: int) -> np.ndarray:
    """Flip, then turn counter-clockwise, on the last two axes."""
    if flip_x:
        grids = grids[..., ::-1]
    if flip_y:
        grids = grids[..., ::-1, :]
    return np.rot90(grids, quarter_turns, axes=(-2, -1)) if quarter_turns % 4 else grids


# ---- Arrow ----------------------------------------------------------------------------------------
def to_block(column: pa.Array, shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """A batch of equally long lists as (N, *shape); a wrong length fails."""
    size = int(np.prod(shape))
    if column.null_count:
        raise ValueError("NULL grid")
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != size).any():
        raise ValueError(f"grid of {lengths[lengths != size][0]} values, expected {shape}")
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), *shape)


def to_lists(block: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    n = block.shape[0]
    flat = np.ascontiguousarray(block).reshape(n, -1)
    offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32) if n else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1), type=kind))


def resize_column(shape: tuple[int, int], size: tuple[int, int], mode: str):
    """Arrow function ARRAY -> ARRAY<DOUBLE> that resizes row-major grids."""
    resize_taps(shape[0], size[0], mode)  # reject a bad mode on the driver

    @F.arrow_udf("array<double>")
    def run(grid: pa.Array) -> pa.Array:
        return to_lists(resize(to_block(grid, shape), size, mode))

    return run


def pair_loss_column(shape: tuple[int, int], loss):
    """Arrow function (pred, target) -> DOUBLE: the mean of a per-pixel kernel over each grid."""

    @F.arrow_udf("double")
    def run(pred: pa.Array, target: pa.Array) -> pa.Array:
        values = loss(to_block(pred, shape), to_block(target, shape))
        return pa.array(values.reshape(len(pred), -1).mean(axis=1))

    return run


def orient_column(shape: tuple[int, int], planes: int = 1):
    """Arrow function (grid, flip_x, flip_y, turns) -> ARRAY<DOUBLE>, rows grouped by orientation."""

    @F.arrow_udf("array<double>")
    def run(grid: pa.Array, flip_x: pa.Array, flip_y: pa.Array, turns: pa.Array) -> pa.Array:
        block = to_block(grid, (planes, *shape))
        if shape[0] != shape[1] and (turns.to_numpy(zero_copy_only=False).astype(int) % 2).any():
            raise ValueError("quarter turns need square grids")
        out = np.empty_like(block)
        code = (
            turns.to_numpy(zero_copy_only=False).astype(int) * 4
            + flip_y.to_numpy(zero_copy_only=False).astype(int) * 2
            + flip_x.to_numpy(zero_copy_only=False).astype(int)
        )
        for c in np.unique(code):
            rows = code == c
            out[rows] = orient(block[rows], bool(c & 1), bool(c & 2), int(c) // 4)
        return to_lists(out)

    return run
