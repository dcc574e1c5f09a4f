"""Intermediate tables in the cluster's shared folder.

Operators that need the same physical rows twice (ranks, weighted draws) write them once and read them
back, so a lost executor re-reads files and never recomputes a range partitioning with other bounds.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A summary below this many rows may be broadcast; above it a shuffled join is planned.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

# folders that queries built once and use again, by (application, what)
BUILT: dict[tuple, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # one machine, and nothing was named, so name a folder
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    # with its scheme: a bare path means one file system to Spark and another to a Python worker
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/gridcast-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and return a scan of what was written."""
    path = scratch_path(df.sparkSession, label)
    # short-lived and read back at once: speed before size
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Folders below this application's scratch folder are no longer taken for built."""
    for key in [k for k, folder in BUILT.items() if folder.startswith(scratch_root(spark))]:
        del BUILT[key]


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring an already materialised side: rows, and bytes with its texts."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = sum(wide, F.lit(16 * len(df.columns)))
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and total <= max_bytes else df
