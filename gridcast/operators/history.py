"""Metric histories: one row per (run, epoch, step, tag, metric)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridcast.operators.ordered import first_per_group, moving_average, running_sums
from gridcast.operators.stopping import stops

HISTORY_SCHEMA = "run string, epoch int, step int, tag string, metric string, value double"


def append(rows: DataFrame, path: str) -> None:
    """Long form: a new metric needs no new header."""
    columns = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]
    rows.select(*columns).write.mode("append").partitionBy("run").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def series(spark: SparkSession, path: str, metrics: list[str], x: str = "epoch") -> DataFrame:
    """Curves of a wide CSV history: one row per (x, tag, metric) for the listed metrics that exist;
    ``tag`` is ``raw`` where the file has none."""
    wide = spark.read.option("header", True).csv(path)
    present = [m for m in metrics if m in wide.columns]
    schema = {m: "double" for m in present} | ({x: "int"} if x in wide.columns else {})
    typed = wide.select(*[F.col(c).cast(k).alias(c) for c, k in schema.items()], *(["tag"] if "tag" in wide.columns else []))
    if "tag" not in typed.columns:
        typed = typed.withColumn("tag", F.lit("raw"))
    if x not in typed.columns:
        typed = typed.withColumn(x, F.lit(None).cast("int"))
    if not present:
        return typed.select(x, "tag", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")).limit(0)
    return typed.unpivot([x, "tag"], present, "metric", "value").where(F.col("value").isNotNull())


def batch_means(losses: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean of batch losses weighted by batch size."""
    total = F.sum(weight).cast("double")
    return losses.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), total).alias("mean"))


def running_means(losses: DataFrame, by: list[str], order: list[str], value: str, weight: str) -> DataFrame:
    """The same after every batch."""
    parts = losses.withColumns({"_v": F.col(value) * F.col(weight), "_w": F.col(weight).cast("double")})
    sums = running_sums(parts, by, order, ["_v", "_w"])
    return sums.withColumn("running_mean", F.try_divide("running__v", "running__w")).drop("_v", "_w", "running__v", "running__w")


def _signed(value: str, mode: str) -> Column:
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, got {mode!r}")
    return F.col(value) if mode == "min" else -F.col(value)


def best_epochs(history: DataFrame, keys: list[str], epoch: str, value: str, mode: str = "min") -> DataFrame:
    """The best epoch per run; the first wins ties. A MIN over (value, epoch): combines on the map side."""
    best = F.min(F.struct(_signed(value, mode).alias("v"), F.col(epoch).alias("e"), F.col(value).alias("x")))
    return history.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.e").alias("best_epoch"), F.col("_b.x").alias("best_value")
    )


def latest_epochs(history: DataFrame, keys: list[str], epoch: str, n: int) -> DataFrame:
    return first_per_group(history, keys, [F.col(epoch).desc()], n)


def best_source(history: DataFrame, keys: list[str], tag: str, value: str, mode: str = "min") -> DataFrame:
    """Raw or averaged weights per epoch: ``ema`` only when strictly better, else whichever exists."""
    rows = history.groupBy(*keys).agg(
        F.max(F.when(F.col(tag) == "raw", F.col(value))).alias("raw_value"),
        F.max(F.when(F.col(tag) == "ema", F.col(value))).alias("ema_value"),
    )
    better = F.col("ema_value") < F.col("raw_value") if mode == "min" else F.col("ema_value") > F.col("raw_value")
    source = (
        F.when(F.col("raw_value").isNull() & F.col("ema_value").isNull(), None)
        .when(F.col("raw_value").isNull(), "ema").when(F.col("ema_value").isNull(), "raw")
        .when(better, "ema").otherwise("raw")
    )
    return rows.withColumn("source", source).withColumn(
        "value", F.when(F.col("source") == "ema", F.col("ema_value")).otherwise(F.col("raw_value"))
    )


def early_stops(history: DataFrame, keys: list[str], epoch: str, value: str, patience: int = 10, mode: str = "min", min_delta: float = 1e-5, n_blocks: int | None = None) -> DataFrame:
    """Per run: the epoch at which training stops (NULL if it does not) and the best value by then. The best only moves
    on an improvement above ``min_delta``; see :mod:`gridcast.operators.stopping` for how runs of any length are
    followed."""
    signed = history.select(*keys, epoch, _signed(value, mode).cast("double").alias("_signed"))
    found = stops(signed, keys, epoch, "_signed", max(patience, 1), min_delta, n_blocks)
    sign = 1.0 if mode == "min" else -1.0
    return found.select(*keys, F.col("stop").alias("stop_epoch"), (F.col("best") * sign).alias("best_value"))


def smoothed(history: DataFrame, keys: list[str], epoch: str, value: str, decay: float) -> DataFrame:
    return moving_average(history, keys, [epoch], value, decay, "ema")
