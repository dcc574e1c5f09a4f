"""Rasters inside ZIP archives as a Spark data source: ``spark.read.format("raster_archive").load(folder)``.

The driver lists archives and their sizes only. A partition is a byte range of one archive; its task reads the archive's
directory at the end of the file and then the members whose headers lie in its range. Filters on ``filename`` and
``sensor`` are pushed into the reader, so a member that they refuse is never read.
"""
from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from gridcast.sources.files import DATA_FAULTS, MemberReader, list_files, open_input

SCHEMA = "path string, archive string, filename string, sensor string, size bigint, content binary"
RANGE = 128 << 20
BATCH = 16 << 20  # bytes of content in one Arrow batch
PUSHED = ("filename", "sensor")


@dataclass
class Range(InputPartition):
    archive: str
    lo: int
    hi: int


@dataclass
class Test:
    """One pushed filter: a column equals one of some values, or starts with a text."""

    column: str
    values: frozenset | None = None
    prefix: str | None = None

    def passes(self, row: dict) -> bool:
        value = row[self.column]
        return value in self.values if self.values is not None else value.startswith(self.prefix)


def test_of(f: Filter) -> Test | None:
    """The filter as a test of a member's names, None where Spark has to apply it."""
    column = ".".join(getattr(f, "attribute", ()))
    if column not in PUSHED:
        return None
    if isinstance(f, EqualTo) and isinstance(f.value, str):
        return Test(column, values=frozenset([f.value]))
    if isinstance(f, In) and all(isinstance(v, str) for v in f.value):
        return Test(column, values=frozenset(f.value))
    if isinstance(f, StringStartsWith):
        return Test(column, prefix=f.value)
    return None


def members(archive: str) -> list[dict]:
    """The members of an archive below a folder, by header offset; of those with one bare name the last one in the
    directory."""
    with open_input(archive) as stream, zipfile.ZipFile(stream) as z:
        last = {m.filename.rsplit("/", 1)[1]: m for m in z.infolist() if "/" in m.filename and not m.filename.endswith("/")}
    rows = [
        {"member": m.filename, "filename": name, "sensor": m.filename.split("/")[-2], "offset": m.header_offset, "size": m.compress_size, "method": m.compress_type, "crc": m.CRC}
        for name, m in last.items()
    ]
    return sorted(rows, key=lambda r: r["offset"])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the folder of the archives must be given, as in load(folder)")
        self.path, self.pattern = options["path"], options.get("pattern", "*.zip")
        self.range = int(options.get("rangebytes", RANGE))
        if self.range < 1:
            raise ValueError(f"rangeBytes must be positive, got {self.range}")
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull):  # no column of a member is null
                continue
            test = test_of(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Range]:
        found = [(path, size) for path, size in list_files(self.path) if fnmatch(path.rsplit("/", 1)[-1], self.pattern)]
        return [Range(path, lo, min(size, lo + self.range)) for path, size in sorted(found) for lo in range(0, size, self.range)] or [Range("", 0, 0)]

    def wanted(self, part: Range) -> list[dict]:
        inside = [m for m in members(part.archive) if part.lo <= m["offset"] < part.hi] if part.archive else []
        return [m for m in inside if all(t.passes(m) for t in self.tests)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        reader, held, total = MemberReader(), [], 0
        for m in self.wanted(partition):
            try:
                content = reader.read(partition.archive, m["offset"], m["size"], m["method"], m["crc"])
            except DATA_FAULTS:
                content = b""  # the decoder reports it
            held.append((f"{partition.archive}!{m['member']}", partition.archive, m["filename"], m["sensor"], len(content), content))
            total += len(content)
            if total >= BATCH:
                yield self.batch(held)
                held, total = [], 0
        reader.close()
        if held:
            yield self.batch(held)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class RasterArchive(DataSource):
    """Options: ``path`` (the folder), ``pattern`` (of archive names, ``*.zip``), ``rangeBytes`` (a task's share)."""

    @classmethod
    def name(cls) -> str:
        return "raster_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE, pattern: str = "*.zip") -> DataFrame:
    """(path, archive, filename, sensor, size, content) of all members of the archives at ``path``, for the decoders. A
    member that cannot be read has empty content."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterArchive)
    return spark.read.format("raster_archive").option("rangeBytes", range_bytes).option("pattern", pattern).load(path)
