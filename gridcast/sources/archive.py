"""Rasters inside ZIP archives, read by byte range.

The index is a table of names and offsets; joins touch only the index, and pixels are read where they are used.
"""
from __future__ import annotations

import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridcast import dims
from gridcast.functions.columns import path_filename
from gridcast.sources.files import DATA_FAULTS, MemberReader, open_input

INDEX_SCHEMA = "archive string, member string, ordinal bigint, offset bigint, size bigint, method int, crc bigint"
TASK_BYTES = 128 << 20


def archive_index(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, member, filename, offset, size, method, crc) of all members below a folder of their archive.
    Top-level members and folder entries are skipped; of members with one bare name the last wins."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    names = archives.load(path).select("path")  # content is not read

    def run(batches):
        for batch in batches:
            for archive in batch["path"].to_pylist():
                with open_input(archive) as stream, zipfile.ZipFile(stream) as z:
                    rows = [
                        (archive, m.filename, i, m.header_offset, m.compress_size, m.compress_type, m.CRC)
                        for i, m in enumerate(z.infolist())
                        if "/" in m.filename and not m.filename.endswith("/")
                    ]
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame(rows, columns=["archive", "member", "ordinal", "offset", "size", "method", "crc"]).astype(
                        {"ordinal": "int64", "offset": "int64", "size": "int64", "method": "int32", "crc": "int64"}
                    ),
                    schema=pa.schema(
                        [("archive", pa.string()), ("member", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()),
                         ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64())]
                    ),
                    preserve_index=False,
                )

    listed = names.mapInArrow(run, INDEX_SCHEMA).withColumn("filename", path_filename(F.col("member")))
    # max over a struct keeps the last entry and combines on the map side
    entry = F.struct("archive", "ordinal", "member", "offset", "size", "method", "crc")
    return listed.groupBy("filename").agg(F.max(entry).alias("_e")).select("filename", "_e.*").drop("ordinal")


def read_members(index: DataFrame) -> DataFrame:
    """(path, filename, sensor, content) for the decoders; the sensor is the index's column if it has one, else
    the member's folder. Members are spread by archive and offset, so a task
    reads one stretch of one archive; the number of tasks follows the bytes to read."""
    folder = F.element_at(F.split("member", "/"), -2)
    index = index.withColumn("sensor", F.col("sensor") if "sensor" in index.columns else folder)
    total = index.agg(F.sum("size")).first()[0] or 0
    floor = index.sparkSession.sparkContext.defaultParallelism
    spread = index.repartitionByRange(max(floor, int(total // TASK_BYTES) + 1), "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches):
        reader = MemberReader()
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                contents = []
                for r in part:
                    try:
                        contents.append(reader.read(r["archive"], r["offset"], r["size"], r["method"], r["crc"]))
                    except DATA_FAULTS:
                        contents.append(b"")  # the decoder reports it
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{r['archive']}!{r['member']}" for r in part], pa.string()),
                        pa.array([r["filename"] for r in part], pa.string()),
                        pa.array([r["sensor"] for r in part], pa.string()),
                        pa.array(contents, pa.binary()),
                    ],
                    names=["path", "filename", "sensor", "content"],
                )

    return spread.mapInArrow(run, "path string, filename string, sensor string, content binary")
