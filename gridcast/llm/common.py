"""What the operators share: words of a text, 64-bit hashes in NumPy, intermediate tables."""
from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.scratch import scratch_path

U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORDS_KEPT = 200_000  # entries of a worker's word cache; it starts anew beyond, results do not change


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and scan what was written.

    The shuffle files of the job are freed as it ends: the table replaces them, also for a lost executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    gc.collect()
    return spark.read.schema(df.schema).parquet(path)


def fan_out(df: DataFrame, mb: int = 32) -> int:
    """Partitions of an exchange: the session's number, more where the input's files ask for it. Spark knows no size
    of a table made from objects and then gives a huge number."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = 0 if size >= 1 << 55 else size // (mb << 20)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tasks, 1_000_000))


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, by name: others may be there, whatever they are called."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def in_order(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (doc_id, text) in ``n`` ranges of ascending doc_id, rows with one doc_id by the hash of their text, and
    the number of the range (``pid``). Copies of one row are interchangeable and go by input partition, so neither a
    null doc_id nor a repeated row fills a task."""
    tagged = docs.withColumns({"_text": F.xxhash64("text"), "_from": F.spark_partition_id()})
    ranged = tagged.repartitionByRange(n, "doc_id", "_text", "_from").sortWithinPartitions("doc_id", "_text")
    return ranged.drop("_text", "_from").withColumn("pid", F.spark_partition_id())


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``used`` under neutral names, so that an operator's own columns cannot meet them,
    and a function that selects the columns of ``docs`` from a result."""
    names = {c: c if c in used else f"_other_{i}" for i, c in enumerate(docs.columns)}
    return (
        docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]),
        lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()]),
    )


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``limit`` bytes of text each; a longer text is a range of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if len(sizes):
        yield lo, len(sizes)


class WordHashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and x09-x0D: what bytes.split() takes as white space is exactly these."""
    return text.encode().split() if text else []


def hashed(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The name of an ordered pair."""
    return mix(a * U64(0x9E3779B97F4A7C15) + (b + U64(salt)) * U64(0xC2B2AE3D27D4EB4F))


def spans(h: np.ndarray, width: int, salt: int = 1) -> np.ndarray:
    """The hash of every ``width`` consecutive elements, by doubling: as many steps as the width has bits."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, h, 1
    while True:
        if width & size:
            part = power[done:]
            out = part[:n] if out is None else pair(out[:n], part[:n], salt + size)
            done += size
        if 2 * size > width:
            return mix(out + U64(salt))
        power = pair(power[:-size], power[size:], salt + 64 + size)
        size *= 2
