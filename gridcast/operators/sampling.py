"""Sampling: intensity weights, weighted draws, shuffles, batches, audits."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridcast.functions.columns import draw_order, scene_weight
from gridcast.operators.ordered import last_known, ordinal_rank, running_sums
from gridcast.scratch import materialise

WHOLE = 1 << 30  # the largest weight as a whole number


def scene_weights(samples: DataFrame, scale: float = 3.0, target: str = "target", keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``1 + scale*log1p(max(0, scene max))`` per sample; the scan reads the target column only."""
    return samples.select(*keep, scene_weight(F.array_max(target), scale).alias("weight"))


def weighted_draws(weights: DataFrame, n: int, seed: int, key: str = "uid") -> DataFrame:
    """``n`` draws with replacement, probability proportional to ``weight``: (key, weight, draws), draws > 0.

    Weights become whole numbers, so their running sums are exact. The sums cut a line into one stretch per key; n
    points drawn by hash fall on it, and one ordered pass over stretches and points counts them. The result depends
    on the rows, ``n`` and ``seed`` alone. Copies of a key add up; NULL, NaN and weights up to 0 are never drawn.
    """
    spark = weights.sparkSession
    rows = weights.select(key, F.col("weight").cast("double").alias("weight")).where(~F.isnan("weight") & (F.col("weight") > 0))
    rows = materialise(rows, "weights")
    most = rows.agg(F.max("weight")).first()[0]
    if most is None:
        raise ValueError("no positive weights")
    whole = F.greatest(F.floor(F.col("weight") / F.lit(most) * F.lit(WHOLE)), F.lit(1))
    keyed = rows.groupBy(key).agg(F.sum("weight").alias("weight"), F.sum(whole).alias("_q"))
    placed = materialise(running_sums(keyed, [], [key], ["_q"]).withColumn("_at", F.col("running__q") - F.col("_q")), "stretches")
    total = placed.agg(F.max("running__q")).first()[0]
    text = F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string"))
    point = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(total)
    points = spark.range(n).select(point.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_lo"))
    line = placed.select("_at", F.lit(0).alias("_kind"), F.col("_at").alias("_lo")).unionByName(points)
    drawn = last_known(line, ["_at", "_kind"], "_lo").where("_kind = 1").groupBy("_lo").agg(F.count(F.lit(1)).alias("draws"))
    return placed.join(drawn, placed["_at"] == drawn["_lo"]).select(key, "weight", "draws")


def expand_draws(draws: DataFrame) -> DataFrame:
    """One row per draw."""
    return draws.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int")))).drop("draws", "weight")


def shuffled(rows: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """Rows in a seed-fixed random order."""
    drawn = rows.withColumns({"_draw": draw_order(seed, *[F.col(k) for k in key]), "_pid": F.spark_partition_id()})
    return drawn.orderBy("_draw", *key, "_pid").drop("_draw", "_pid")  # copies of a row split by input partition


def shuffled_positions(rows: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """``position`` of every row in the order of :func:`shuffled`."""
    drawn = rows.withColumn("_draw", draw_order(seed, *[F.col(k) for k in key]))
    return ordinal_rank(drawn, [], ["_draw", *key], "position").drop("_draw")


def batches(rows: DataFrame, order: list[str], size: int, drop_last: bool = False) -> DataFrame:
    """``batch_id`` for fixed-size batches in ``order``; ``drop_last`` leaves out a short final batch."""
    if size <= 0:
        raise ValueError(f"batch size must be positive, got {size}")
    placed = ordinal_rank(rows, [], order, "_pos")
    out = placed.withColumn("batch_id", F.floor(F.col("_pos") / F.lit(size)).cast("long"))
    if drop_last:
        n = placed.count()
        out = out.where(F.col("_pos") < n - n % size)
    return out.drop("_pos")


def ordered_rows(rows: DataFrame, strategy: str, seed: int = 0, key: list[str] | None = None, scale: float = 3.0) -> DataFrame:
    """The sampling strategies by name."""
    strategy = strategy.lower()
    if strategy in ("uniform", "random"):
        return shuffled(rows, seed, key or ["uid"])
    if strategy == "sequential":
        return rows.orderBy(*(key or ["row_idx"]))
    if strategy == "precip_stratified":
        n = rows.count()
        return expand_draws(weighted_draws(scene_weights(rows, scale), n, seed))
    raise ValueError(f"unknown sampling strategy {strategy!r}")


def audit_sample(outputs: DataFrame, k: int = 25, seed: int = 0, key: str = "filename") -> DataFrame:
    """``k`` random outputs."""
    return outputs.withColumn("_draw", draw_order(seed, F.col(key))).orderBy("_draw", key).limit(k).drop("_draw")
