"""Baseline TIFF: uncompressed strips, chunky or planar, either byte order."""
from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: field type -> (struct code, bytes).
FIELD_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 12: ("d", 8), 16: ("Q", 8)}
# (sample format, bits) -> NumPy kind
SAMPLE_KINDS = {
    (1, 8): "u1", (1, 16): "u2", (1, 32): "u4",
    (2, 8): "i1", (2, 16): "i2", (2, 32): "i4",
    (3, 32): "f4", (3, 64): "f8",
}
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS, TAG_STRIP_COUNTS, TAG_PLANAR = 273, 277, 278, 279, 284
TAG_SAMPLE_FORMAT, TAG_PIXEL_SCALE, TAG_TIE_POINT, TAG_MATRIX, TAG_GEO_KEYS = 339, 33550, 33922, 34264, 34735
GEO_KEY_GEOGRAPHIC, GEO_KEY_PROJECTED = 2048, 3072
HEADER_TAGS = frozenset([
    TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_SAMPLES, TAG_SAMPLE_FORMAT, TAG_PIXEL_SCALE, TAG_TIE_POINT, TAG_MATRIX, TAG_GEO_KEYS,
])


class RasterError(ValueError):
    """A raster that cannot be read or breaks its contract."""


@dataclass(frozen=True)
class Header:
    height: int
    width: int
    count: int
    dtype: str
    crs: str | None
    transform: tuple[float, ...]


def of_bytes(data: bytes):
    """``read(at, n)`` over bytes in memory."""

    def read(at: int, n: int) -> bytes:
        return data[at : at + n]

    return read


class Ranges:
    """``read(at, n)`` over a seekable stream, fetched and kept by pages. ``fetched`` counts the bytes."""

    def __init__(self, stream, page: int = 4096):
        self.stream, self.page, self.pages, self.fetched = stream, page, {}, 0
        self.size = stream.seek(0, 2)

    def __call__(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        span = range(at // self.page, (at + n - 1) // self.page + 1)
        for k in span:
            if k not in self.pages:
                self.stream.seek(k * self.page)
                self.pages[k] = self.stream.read(min(self.page, self.size - k * self.page))
                self.fetched += len(self.pages[k])
        start = at - span[0] * self.page
        return b"".join(self.pages[k] for k in span)[start : start + n]


def _fields(read, only: frozenset | None = None) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory. With ``only``, other fields' values are not fetched."""
    start = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8 or struct.unpack(order + "H", start[2:4])[0] != 42:
        raise RasterError("not a TIFF file")
    (at,) = struct.unpack(order + "I", start[4:8])
    (n,) = struct.unpack(order + "H", read(at, 2))
    table = read(at + 2, 12 * n)
    out = {}
    for i in range(n):
        tag, kind, count, cell = struct.unpack_from(order + "HHI4s", table, 12 * i)
        if kind not in FIELD_TYPES or (only is not None and tag not in only):
            continue
        code, width = FIELD_TYPES[kind]
        if count * width > 4:
            cell = read(struct.unpack(order + "I", cell)[0], count * width)
        out[tag] = struct.unpack_from(f"{order}{code * count if kind == 5 else str(count) + code}", cell)
    return order, out


def _placed(tags: dict[int, tuple]) -> tuple[tuple, str | None]:
    transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    if TAG_MATRIX in tags:
        m = tags[TAG_MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif TAG_PIXEL_SCALE in tags and TAG_TIE_POINT in tags:
        (sx, sy), tie = tags[TAG_PIXEL_SCALE][:2], tags[TAG_TIE_POINT]
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    crs = None
    keys = tags.get(TAG_GEO_KEYS, ())
    for i in range(4, len(keys) - 3, 4):
        if keys[i] in (GEO_KEY_GEOGRAPHIC, GEO_KEY_PROJECTED) and keys[i + 1] == 0:
            crs = f"EPSG:{keys[i + 3]}"
    return transform, crs


def _parse(read, only: frozenset | None = None) -> tuple[str, dict[int, tuple], Header]:
    try:
        order, tags = _fields(read, only)
        count = int(tags.get(TAG_SAMPLES, (1,))[0])
        bits = int(tags.get(TAG_BITS, (1,))[0])
        kind = SAMPLE_KINDS.get((int(tags.get(TAG_SAMPLE_FORMAT, (1,))[0]), bits))
        height, width = int(tags[TAG_HEIGHT][0]), int(tags[TAG_WIDTH][0])
        transform, crs = _placed(tags)
    except (struct.error, KeyError, IndexError) as e:
        raise RasterError(f"damaged TIFF header: {e!r}") from e
    dtype = str(np.dtype(kind)) if kind else "unknown"
    return order, tags, Header(height, width, count, dtype, crs, tuple(float(v) for v in transform))


def read_header(data: bytes) -> Header:
    return _parse(of_bytes(data), HEADER_TAGS)[2]


def read_stream_header(ranges: Ranges) -> Header:
    """The header alone: start, directory and the values of its fields, wherever they lie in the file."""
    return _parse(ranges, HEADER_TAGS)[2]


def read_raster(data: bytes) -> tuple[np.ndarray, Header]:
    """Pixels as (bands, height, width)."""
    order, tags, head = _parse(of_bytes(data))
    if head.dtype == "unknown":
        raise RasterError("unsupported sample type")
    if int(tags.get(TAG_COMPRESSION, (1,))[0]) != 1:
        raise RasterError(f"unsupported compression {tags[TAG_COMPRESSION][0]}")
    if TAG_STRIP_OFFSETS not in tags or TAG_STRIP_COUNTS not in tags:
        raise RasterError("no strips")
    parts = [data[o : o + n] for o, n in zip(tags[TAG_STRIP_OFFSETS], tags[TAG_STRIP_COUNTS])]
    kind = np.dtype(head.dtype).newbyteorder(order)
    pixels = np.frombuffer(b"".join(parts), kind)
    if pixels.size != head.count * head.height * head.width:
        raise RasterError("truncated pixel data")
    if int(tags.get(TAG_PLANAR, (1,))[0]) == 2:
        block = pixels.reshape(head.count, head.height, head.width)
    else:
        block = pixels.reshape(head.height, head.width, head.count).transpose(2, 0, 1)
    return np.ascontiguousarray(block).astype(np.dtype(head.dtype), copy=False), head


def write_raster(block: np.ndarray, transform: tuple[float, ...] | None = None) -> bytes:
    """(bands, height, width) as one planar little-endian TIFF; an identity transform is not stored."""
    count, height, width = block.shape
    kind = block.dtype.newbyteorder("<")
    bits = block.dtype.itemsize * 8
    formats = {k: f for (f, b), k in SAMPLE_KINDS.items()}
    sample = formats[block.dtype.str[1:]]
    pixels = np.ascontiguousarray(block, kind).tobytes()
    strip = len(pixels) // count
    entries: list[tuple[int, int, list]] = [
        (TAG_WIDTH, 4, [width]), (TAG_HEIGHT, 4, [height]), (TAG_BITS, 3, [bits] * count),
        (TAG_COMPRESSION, 3, [1]), (TAG_PHOTOMETRIC, 3, [1]),
        (TAG_STRIP_OFFSETS, 4, [8 + i * strip for i in range(count)]),
        (TAG_SAMPLES, 3, [count]), (TAG_ROWS, 4, [height]), (TAG_STRIP_COUNTS, 4, [strip] * count),
        (TAG_PLANAR, 3, [2 if count > 1 else 1]), (TAG_SAMPLE_FORMAT, 3, [sample] * count),
    ]
    if transform is not None and tuple(transform) != (1.0, 0.0, 0.0, 0.0, 1.0, 0.0):
        a, b, c, d, e, f = transform
        entries.append((TAG_MATRIX, 12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]))
    pad = len(pixels) % 2
    at = 8 + len(pixels) + pad
    extra_at = at + 2 + 12 * len(entries) + 4
    table, extra = b"", b""
    for tag, kind_id, values in entries:
        raw = struct.pack(f"<{len(values)}{FIELD_TYPES[kind_id][0]}", *values)
        if len(raw) <= 4:
            cell = raw.ljust(4, b"\0")
        else:
            cell = struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        table += struct.pack("<HHI", tag, kind_id, len(values)) + cell
    head = b"II*\0" + struct.pack("<I", at)
    return head + pixels + b"\0" * pad + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0) + extra


# ---- contracts ------------------------------------------------------------------------------------
def check_frame(block: np.ndarray, head: Header, n_bands: int, size: tuple[int, int] | None, check_dtype: bool = True) -> np.ndarray:
    if head.count != n_bands:
        raise RasterError(f"expected {n_bands} bands, got {head.count}")
    if check_dtype and head.dtype != "uint8":
        raise RasterError(f"expected dtype uint8, got {head.dtype}")
    if size is not None and (head.height, head.width) != tuple(size):
        raise RasterError(f"expected size {tuple(size)}, got {(head.height, head.width)}")
    return block


def check_target(block: np.ndarray, head: Header, size: tuple[int, int]) -> np.ndarray:
    if head.count != 1:
        raise RasterError(f"expected 1 band, got {head.count}")
    if (head.height, head.width) != tuple(size):
        raise RasterError(f"expected size {tuple(size)}, got {(head.height, head.width)}")
    rate = block[0].astype(np.float32, copy=False)
    if not np.isfinite(rate).all():
        raise RasterError("non-finite values")
    return rate
