"""Files as a Spark data sink: ``df.write.format("raster_files").mode("append").save(folder)``.

Tasks write to a folder of the job's own beside the target. Only when all have ended does the driver move it into place,
so nothing of a job that fails is ever seen, and what was there before stays.
"""
from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridcast import dims
from gridcast.sources.files import is_local, list_files, move, plain, remove_tree, write_atomic
from gridcast.sources.rasters import encode_column, prediction_faults

MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # name, place in the job's folder


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = plain(path.rstrip("/")), overwrite
        self.staging = f"{self.path}._job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        # an attempt has a folder of its own: a repeated task does not meet what the first one left
        attempt, files = uuid.uuid4().hex, []
        for batch in iterator:
            for name, content in zip(batch["filename"].to_pylist(), batch["content"]):
                if not name or name.startswith("/") or ".." in name.split("/") or not content.is_valid:
                    raise ValueError(f"no file can be written for {name!r}")
                place = f"{self.staging}/{attempt}/{name}"
                write_atomic(place, content.as_buffer().to_pybytes())
                files.append((name, place))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        twice = [n for n, c in Counter(n for n, _ in files).items() if c > 1]
        if twice:
            remove_tree(self.staging)
            raise ValueError(f"file names given twice: {sorted(twice)[:5]}")
        before = {p for p, _ in list_files(self.path)} if self.overwrite else set()
        # one file system's renames wait for each other: threads help where each is a request to a server
        with ThreadPoolExecutor(1 if is_local(self.path) else MOVERS) as pool:
            list(pool.map(lambda f: move(f[1], f"{self.path}/{f[0]}"), files))
            kept = {f"{self.path}/{n}" for n, _ in files}
            list(pool.map(remove_tree, [p for p in before if p not in kept]))
        remove_tree(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        """Tasks of the failed job may still run for a moment and write again, so the folder is removed until it has
        been gone for a second, within half a minute."""
        gone = 0
        for _ in range(150):
            left = list_files(self.staging)
            remove_tree(self.staging)
            gone = 0 if left else gone + 1
            if gone == 5:
                return
            time.sleep(0.2)


class RasterFiles(DataSource):
    """Rows (filename, content) become files below ``path``. ``append`` replaces files of the same name and leaves
    others; ``overwrite`` leaves only the job's own."""

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return "filename string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if not {"filename", "content"} <= set(schema.names):
            raise ValueError(f"filename and content are needed, got {schema.names}")
        return FilesWriter(self.options["path"], overwrite)


def save_files(files: DataFrame, root: str, mode: str = "append") -> None:
    files.sparkSession.dataSource.register(RasterFiles)
    files.select(F.col("filename").cast("string"), F.col("content").cast("binary")).write.format("raster_files").mode(mode).save(root)


def save_predictions(preds: DataFrame, manifest: DataFrame, root: str, size: tuple[int, int] = dims.TARGET_SIZE, transform: tuple[float, ...] | None = None, mode: str = "append") -> None:
    """One float32 raster per manifest row, named by its target file, all or none. ``preds`` is (uid, rate ARRAY),
    ``manifest`` (uid, target_file); any fault refuses the write before it starts."""
    faults = prediction_faults(preds, manifest, size).limit(5).collect()
    if faults:
        raise ValueError(f"predictions do not match the manifest: {[tuple(r) for r in faults]}")
    named = manifest.select("uid", "target_file").join(preds.select("uid", "rate"), "uid")
    save_files(named.select(F.col("target_file").alias("filename"), encode_column(size, transform=transform)("rate").alias("content")), root, mode)
