"""Scalar and array column expressions. Everything here stays in the JVM."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gridcast import dims


# ---- manifest cells -------------------------------------------------------------------------------
def frame_list(cell: Column) -> Column:
    """A list or tuple literal in a text cell as ARRAY<STRING>; blanks are empty, anything else fails."""
    text = F.trim(cell)
    blank = cell.isNull() | text.isin("", "[]", "()", "nan", "NaN")
    # a tuple needs a comma, as "('a')" is a plain string
    text = F.when(text.rlike(r"^[(\[]\s*[)\]]$"), "[]").otherwise(text)
    blank = blank | (text == "[]")
    as_list = F.when(
        text.rlike(r"(?s)^\(.*,.*\)$"), F.concat(F.lit("["), F.substring(text, 2, F.length(text) - 2), F.lit("]"))
    ).otherwise(text)
    as_list = F.regexp_replace(as_list, r",\s*\]$", "]")
    # the parser stops at the closing bracket, whatever follows it
    parsed = F.when(as_list.rlike(r"(?s)^\[.*\]$"), F.from_json(as_list, "array<string>", {"allowSingleQuotes": "true"}))
    failed = F.raise_error(F.concat(F.lit("could not parse frame list: "), F.coalesce(cell, F.lit("NULL"))))
    return F.when(blank, F.array().cast("array<string>")).otherwise(
        F.coalesce(parsed, failed.cast("array<string>"))
    )


def frame_slots(names: Column, n: int = dims.FRAMES_PER_SAMPLE) -> Column:
    """The first ``n`` names, padded with NULL."""
    padding = F.array_repeat(F.lit(None).cast("string"), n)
    return F.slice(F.concat(names, padding), 1, n)


def canonical_sensor(name: Column) -> Column:
    return F.lower(F.trim(name))


def known_sensor(name: Column) -> Column:
    """The canonical name; an unknown one fails the query."""
    clean = canonical_sensor(name)
    failed = F.raise_error(F.concat(F.lit("unknown sensor: "), F.coalesce(clean, F.lit("NULL"))))
    return F.when(clean.isin(*dims.SENSORS), clean).otherwise(failed.cast("string"))


def sensor_id(name: Column) -> Column:
    return dims.sensor_case(canonical_sensor(name), dims.SENSOR_ID)


def sensor_name(ident: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in dims.SENSORS]), (ident + 1).cast("int"))


def blank_to_null(name: Column) -> Column:
    return F.when(~F.lower(F.trim(name)).isin("", "nan"), name)


def frame_path(root: str | Column, sensor: Column, filename: Column) -> Column:
    base = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    return F.when(filename.isNotNull(), F.concat_ws("/", base, canonical_sensor(sensor), filename))


def target_path(root: str | Column, filename: Column) -> Column:
    base = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    return F.when(filename.isNotNull(), F.concat_ws("/", base, F.lit(dims.TARGET_SUBDIR), filename))


def path_filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def path_subdir(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


# ---- values ---------------------------------------------------------------------------------------
def is_finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def exceeds(x: Column, threshold: float, kind: str = "double") -> Column:
    """Strict ``x > threshold``, false for NaN. ``kind`` is the storage type of ``x``: a FLOAT column is
    compared with a FLOAT threshold, so that 0.1f is not above 0.1."""
    return ~F.isnan(x) & (x > F.lit(threshold).cast(kind))


def log_target(rate: Column) -> Column:
    return F.log1p(F.greatest(rate.cast("double"), F.lit(0.0)))


def rain_mask(rate: Column, threshold: float = dims.RAIN_MM_H, kind: str = "double") -> Column:
    return exceeds(rate, threshold, kind).cast("float")


def inverse_target(mean: Column) -> Column:
    return F.expm1(F.greatest(mean.cast("double"), F.lit(0.0)))


def sigmoid(z: Column) -> Column:
    z = z.cast("double")
    e = F.exp(-F.abs(z))  # never overflows
    return F.when(z >= 0, F.lit(1.0) / (e + 1)).otherwise(e / (e + 1))


def gated_rate(mean: Column, logit: Column, gate: float) -> Column:
    """Rate in mm/h, zero where the rain probability does not exceed ``gate``."""
    return F.when(sigmoid(logit) > gate, inverse_target(mean)).otherwise(0.0)


def clamp_log_var(v: Column) -> Column:
    # fixed bounds
    return F.greatest(F.least(v.cast("double"), F.lit(5.0)), F.lit(-10.0))


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x.cast("double")).otherwise(0.0)


def drizzle_cut(rate: Column, cap: float = 60.0, floor: float = dims.GATE_INFERENCE) -> Column:
    """Clip to [0, cap], then zero whatever is still below ``floor``."""
    clipped = F.least(F.greatest(rate.cast("double"), F.lit(0.0)), F.lit(cap))
    return F.when(clipped < floor, 0.0).otherwise(clipped)


def scene_weight(scene_max: Column, scale: float = 3.0) -> Column:
    return F.lit(1.0) + F.lit(scale) * F.log1p(F.greatest(finite_or_zero(scene_max), F.lit(0.0)))


def pixel_weight(log_rate: Column, scale: float = 3.0) -> Column:
    return F.lit(1.0) + F.lit(scale) * F.greatest(log_rate.cast("double"), F.lit(0.0))


# ---- time -----------------------------------------------------------------------------------------
def hour_fraction(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def cyclic_time(ts: Column) -> dict[str, Column]:
    hour = hour_fraction(ts)
    turn = hour * F.lit(2 * math.pi / 24)
    return {
        "daylight": F.cos((hour - 12.0) * F.lit(2 * math.pi / 24)),
        "sin_hour": F.sin(turn),
        "cos_hour": F.cos(turn),
    }


def aux_vector(ident: Column, ts: Column) -> Column:
    """One-hot sensor, then daylight proxy, sine and cosine of the hour."""
    onehot = [F.when(ident == i, 1.0).otherwise(0.0) for i in range(len(dims.SENSORS))]
    return F.array(*onehot, *cyclic_time(ts).values()).cast("array<float>")


def hour_class(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour.between(14, 22), "night").when(hour.between(2, 7), "day")


# ---- frame slots ----------------------------------------------------------------------------------
def has_data(valid: Column) -> Column:
    return F.exists(valid, lambda v: v)


def fill_slots(values: Column, valid: Column, strategy: str = "repeat_last", n: int = dims.FRAMES_PER_SAMPLE) -> Column:
    """Fill invalid slots from the last valid one, leading gaps from the first. Driven by the mask only;
    with no valid slot the values stay as they are."""
    if strategy == "zero":
        return values
    if strategy != "repeat_last":
        raise ValueError(f"unknown missing-frame strategy {strategy!r}")
    slot = [F.get(values, F.lit(t)) for t in range(n)]
    good = [F.get(valid, F.lit(t)) for t in range(n)]
    filled = []
    for t in range(n):
        nearest_first = list(range(t, -1, -1)) + list(range(t + 1, n))
        choice = F.when(good[nearest_first[0]], slot[nearest_first[0]])
        for s in nearest_first[1:]:
            choice = choice.when(good[s], slot[s])
        filled.append(choice.otherwise(slot[t]))
    return F.array(*filled)


def slot_differences(frames: Column, n: int = dims.FRAMES_PER_SAMPLE) -> Column:
    """``frames`` followed by the n-1 steps between neighbours (element-wise for array frames)."""
    slot = [F.get(frames, F.lit(t)) for t in range(n)]
    steps = [F.zip_with(slot[t + 1], slot[t], lambda a, b: a - b) for t in range(n - 1)]
    return F.concat(frames, F.array(*steps))


def flatten_stack(stack: Column, width: int) -> Column:
    """Concatenate the frames of a stack and pad with zeros at the end up to ``width`` values."""
    flat = F.flatten(stack).cast("array<double>")
    gap = F.greatest(F.lit(width) - F.size(flat), F.lit(0))
    return F.concat(flat, F.array_repeat(F.lit(0.0), gap))


def select_bands(pixels: Column, positions: tuple[int, ...], plane: Column | int) -> Column:
    """Cut whole band planes out of band-major BINARY pixels."""
    plane = F.lit(plane) if isinstance(plane, int) else plane
    first, last = positions[0], positions[-1]
    if positions == tuple(range(first, last + 1)):
        return F.substring(pixels, plane * first + 1, plane * len(positions))
    return F.concat(*[F.substring(pixels, plane * b + 1, plane) for b in positions])


# ---- grids as row-major arrays --------------------------------------------------------------------
def error_map(pred: Column, target: Column, absolute: bool = False) -> Column:
    if absolute:
        return F.zip_with(pred, target, lambda p, t: F.abs(p - t))
    return F.zip_with(pred, target, lambda p, t: p - t)


def unit_draw(seed: int, tag: str, *key: Column) -> Column:
    """A uniform number in [0, 1) fixed by (seed, tag, key): the same on every partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_order(seed: int, *key: Column) -> Column:
    """A 128-bit sort key fixed by (seed, key), for shuffles and samples without replacement."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))
