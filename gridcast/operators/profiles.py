"""Distribution summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridcast.functions.columns import hour_class, is_finite
from gridcast.operators.ordered import percentile_linear, value_at_rank


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        # both sides are single-row totals
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, same).drop(*[f"_k_{k}" for k in keys])


def predictions(pixels: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """Mean, share of non-zero values (%), p95, largest and smallest."""
    x = F.col(value).cast("double")
    sums = pixels.groupBy(*by).agg(
        F.avg(x).alias("mean"), (F.avg((x > 0).cast("double")) * 100).alias("nonzero_pct"),
        F.max(x).alias("max"), F.min(x).alias("min"),
    )
    narrow = pixels.select(*by, x.alias(value))
    return _join_null_safe(sums, percentile_linear(narrow, by, value, 0.95, "p95"), by)


def latencies(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """p90 and p99 picked by index ``int(q*n)`` from the sorted values."""
    at = {f"p{q}": F.floor(F.col("n") * q / 100) for q in (90, 99)}
    return value_at_rank(values, by, value, at)


def tensors(cells: DataFrame, uid: str, by: str, value: str) -> DataFrame:
    """Per group: samples, mean of the sample means, smallest, largest, and whether all is finite."""
    per_sample = cells.groupBy(by, uid).agg(
        F.avg(value).alias("_m"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.bool_and(is_finite(F.col(value))).alias("_f")
    )
    return per_sample.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_m").alias("mean_of_means"), F.min("_lo").alias("min"),
        F.max("_hi").alias("max"), F.bool_and("_f").alias("finite"),
    )


def day_night(rows: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean and sample standard deviation of night and day rows."""
    x = F.col(value).cast("double")
    classed = rows.select(hour_class(F.col(ts)).alias("hour_class"), x.alias("_x")).where(F.col("hour_class").isNotNull())
    return classed.groupBy("hour_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
        F.bool_and(is_finite(F.col("_x"))).alias("finite"),
    )


def rain_distribution(pixels: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """Zero share and skewness, raw and in log space (NULL for a constant column)."""
    x = F.col(value).cast("double")
    log = F.log1p(F.greatest(x, F.lit(0.0)))
    return pixels.groupBy(*by).agg(
        F.avg((x == 0).cast("double")).alias("zero_fraction"), F.skewness(x).alias("skew_raw"), F.skewness(log).alias("skew_log")
    )


def finite_audit(cells: DataFrame, uid: str, value: str) -> DataFrame:
    """Samples holding any non-finite value."""
    return cells.groupBy(uid).agg(F.count_if(~is_finite(F.col(value))).alias("bad")).where(F.col("bad") > 0)
