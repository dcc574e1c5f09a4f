"""Verification over a stream of pixel pairs. The sums live in the stream's state store and nowhere else."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridcast import dims
from gridcast.operators.verify import cell_sums, roll_up, scores

# The aggregates' state in the order of ``pair_sums``, each by the parts that Spark keeps: an average as sum and count,
# a variance as count, mean and moment, a covariance as count, two means and moment. A running query depends on this
# layout, too: Spark continues a checkpoint only with the same one.
STATE = (
    "n bigint, sum_d double, sum_abs double, sum_sq double, "
    "avg_p_sum double, avg_p_n bigint, avg_t_sum double, avg_t_n bigint, "
    "var_p_n double, mean_p double, m2_p double, var_t_n double, mean_t double, m2_t double, "
    "cov_n double, cov_p double, cov_t double, m2_pt double, "
    "tp bigint, fp bigint, fn bigint, heavy_tp bigint, heavy_fp bigint, heavy_fn bigint, heavy_sq double"
)
SUMS = (
    "n", "sum_d", "sum_abs", "sum_sq", "mean_p", "mean_t", "m2_p", "m2_t", "m2_pt", "tp", "fp", "fn", "heavy_tp", "heavy_fp",
    "heavy_fn", "heavy_sq",
)


def start_cells(pairs: DataFrame, checkpoint: str, rain: float = dims.RAIN_MM_H, heavy: float = dims.HEAVY_MM_H, once: bool = True) -> StreamingQuery:
    """Keep the sums per (sensor, site) of everything seen so far, one short row per cell, below ``checkpoint``. Started
    again with that folder, the stream goes on. Old versions of the state go by Spark's own retention
    (``spark.sql.streaming.minBatchesToRetain``), so the folder stays as large as the cells that few batches change."""
    writer = cell_sums(pairs, rain=rain, heavy=heavy).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_cells(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(sensor_id, site_id, sums) as of the last finished batch, also while the stream runs."""
    state = spark.read.format("statestore").load(checkpoint)
    kept = state.schema["value"].dataType
    fields = [part.split() for part in STATE.split(", ")]
    if [f.dataType.simpleString() for f in kept] != [kind for _, kind in fields]:
        raise ValueError(f"the state at {checkpoint} has another layout: {kept.simpleString()}")
    # a cast of structs goes by position, which tells apart the parts that share a name
    named = ",".join(f"{name}:{kind}" for name, kind in fields)
    cells = state.select("key.sensor_id", "key.site_id", F.col("value").cast(f"struct<{named}>").alias("v"))
    return cells.select("sensor_id", "site_id", *[F.col(f"v.{c}").alias(c) for c in SUMS])


def current_report(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Scores from the newest sums of every cell that :func:`start_cells` keeps."""
    return scores(roll_up(stored_cells(spark, checkpoint)))
