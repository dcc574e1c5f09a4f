"""Byte access from Python workers: local paths directly, any other URI through pyarrow's file systems."""
from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections import OrderedDict
from functools import lru_cache
from urllib.parse import unquote, urlparse


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return unquote(parsed.path) if parsed.scheme else path
    return None


@lru_cache(maxsize=16)
def _file_system(root: str):
    """One client per scheme and host in a worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)[0]


def _remote(path: str):
    parsed = urlparse(path)
    system = _file_system(f"{parsed.scheme}://{parsed.netloc}/")
    # object stores name the bucket first; file systems take the path alone
    inner = parsed.path if parsed.scheme in ("hdfs", "viewfs") else f"{parsed.netloc}{parsed.path}"
    return system, inner


def open_input(path: str):
    """A seekable binary stream."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    system, inner = _remote(path)
    return system.open_input_file(inner)


# What a file's content can do wrong. Other errors are the machine's or the decoder's own: the task fails. A decoder says
# by a ValueError, such as ``tiff.RasterError``, that it refuses a file.
DATA_FAULTS = (FileNotFoundError, ValueError, EOFError, struct.error, zlib.error)


def read_bytes(path: str) -> bytes:
    with open_input(path) as stream:
        return stream.read()


class MemberReader:
    """Reads archive members by the offset of their local header, keeping the archives used last open."""

    def __init__(self, most: int = 16):
        self._open, self._most, self.opened = OrderedDict(), most, 0

    def _stream(self, path: str):
        if path not in self._open:
            while len(self._open) >= self._most:
                self._open.popitem(last=False)[1].close()
            self._open[path] = open_input(path)
            self.opened += 1
        self._open.move_to_end(path)
        return self._open[path]

    def read(self, path: str, offset: int, size: int, method: int, crc: int) -> bytes:
        stream = self._stream(path)
        stream.seek(offset)
        head = stream.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member header at this offset")
        name_len, extra_len = struct.unpack("<HH", head[26:30])
        stream.seek(offset + 30 + name_len + extra_len)
        data = stream.read(size)
        if method == 8:
            data = zlib.decompressobj(-15).decompress(data)
        elif method != 0:
            raise ValueError(f"unsupported compression method {method}")
        if zlib.crc32(data) != crc:
            raise ValueError("checksum mismatch")
        return data

    def close(self) -> None:
        while self._open:
            self._open.popitem()[1].close()


def _created(local: str):
    """A new local file; its folder is made when the first file finds none."""
    try:
        return open(local, "wb")
    except FileNotFoundError:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")


def write_atomic(path: str, data: bytes) -> None:
    """Write beside the target, then rename: a retried task leaves a whole file."""
    local = _local(path)
    if local is not None:
        part = f"{local}.{uuid.uuid4().hex}.tmp"
        with _created(part) as stream:
            stream.write(data)
        os.replace(part, local)
        return
    system, inner = _remote(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as stream:
        stream.write(data)
    system.move(part, inner)


def plain(path: str) -> str:
    """The path as ``list_files`` gives it."""
    return _local(path) or path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of every file at or below a path, none if it does not exist."""
    local = _local(path)
    if local is not None:
        if os.path.isfile(local):
            return [(local, os.path.getsize(local))]
        return [(os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(local) for n in names]
    from pyarrow import fs

    system, inner = _remote(path)
    parsed = urlparse(path)
    prefix = f"{parsed.scheme}://{parsed.netloc}" if parsed.scheme in ("hdfs", "viewfs") else f"{parsed.scheme}://"
    found = system.get_file_info(inner)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    listed = system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
    return [(f"{prefix}{f.path}", f.size) for f in listed if f.type == fs.FileType.File]


def is_local(path: str) -> bool:
    return _local(path) is not None


def move(source: str, target: str) -> None:
    """Rename within one file system, in place of a file that is there."""
    local = _local(source)
    if local is not None:
        goal = _local(target)
        try:
            os.replace(local, goal)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(goal), exist_ok=True)
            os.replace(local, goal)
        return
    system, inner = _remote(source)
    goal = _remote(target)[1]
    system.create_dir(goal.rsplit("/", 1)[0], recursive=True)
    system.move(inner, goal)


def remove_tree(path: str) -> None:
    """Delete a file or a folder, if it is there."""
    local = _local(path)
    if local is not None:
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
        elif os.path.exists(local):
            os.remove(local)
        return
    from pyarrow import fs

    system, inner = _remote(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind == fs.FileType.File:
        system.delete_file(inner)
