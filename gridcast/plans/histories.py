"""Metric histories derived from the events."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import history
from gridcast.plans.registry import query, rounded
from gridcast.plans.views import SCALE, table
from gridcast.scratch import scratch_path

# one run per event type, one epoch per day; the morning counts as raw weights, the rest as averaged ones
DAILY_SQL = f"""daily AS (
  SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS epoch, CASE WHEN hour(ts) < 12 THEN 'raw' ELSE 'ema' END AS tag,
         AVG(value * {SCALE}::DOUBLE) AS value, COUNT(*) AS n FROM events GROUP BY 1, 2, 3)"""
# one run per user, one epoch per event
LONG_SQL = f"""long AS (
  SELECT user_id, value * {SCALE}::DOUBLE AS value, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"""


def daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"), F.when(F.hour("ts") < 12, "raw").otherwise("ema").alias("tag")
    ).agg(F.avg(F.col("value") * SCALE).alias("value"), F.count(F.lit(1)).alias("n"))


@query("history_series", f"WITH {DAILY_SQL} SELECT epoch, run || '/' || tag AS tag, metric, ROUND(CASE metric WHEN 'rmse' THEN value ELSE n END, 6) AS value FROM daily, (SELECT UNNEST(['rmse', 'csi']) AS metric)")
def history_series(spark, sf_dir):
    """A wide CSV history to curves; a listed metric the file lacks is left out."""
    path = scratch_path(spark, "curves")
    wide = daily(spark, sf_dir).select("epoch", F.concat_ws("/", "run", "tag").alias("tag"), F.col("value").alias("rmse"), F.col("n").cast("double").alias("csi"))
    wide.write.option("header", True).csv(path)
    return rounded(history.series(spark, path, ["rmse", "mae", "csi"]), "value")


@query("history_append", f"WITH {DAILY_SQL} SELECT run, epoch, 0 AS step, tag, metric, ROUND(CASE metric WHEN 'rmse' THEN value ELSE n END, 6) AS value FROM daily, (SELECT UNNEST(['rmse', 'count']) AS metric)")
def history_append(spark, sf_dir):
    """Two appends; the second brings a metric the first did not have."""
    path = scratch_path(spark, "history")
    rows = daily(spark, sf_dir).withColumn("step", F.lit(0))
    history.append(rows.withColumn("metric", F.lit("rmse")), path)
    history.append(rows.withColumn("metric", F.lit("count")).withColumn("value", F.col("n").cast("double")), path)
    return rounded(history.read(spark, path), "value")


@query(
    "best_epoch",
    f"WITH {DAILY_SQL}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, tag ORDER BY value, epoch) AS lo FROM daily) "
    "SELECT run, tag, epoch AS best_epoch, ROUND(value, 6) AS best_value FROM r WHERE lo = 1",
)
def best_epoch(spark, sf_dir):
    return rounded(history.best_epochs(daily(spark, sf_dir), ["run", "tag"], "epoch", "value"), "best_value")


@query("best_epoch_max", "SELECT user_id, event_id AS best_epoch, value AS best_value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def best_epoch_max(spark, sf_dir):
    return history.best_epochs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", "max")


@query("latest_epochs", f"WITH {DAILY_SQL}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, tag ORDER BY epoch DESC) AS rn FROM daily) SELECT run, tag, epoch, ROUND(value, 6) AS value FROM r WHERE rn <= 3")
def latest_epochs(spark, sf_dir):
    return rounded(history.latest_epochs(daily(spark, sf_dir), ["run", "tag"], "epoch", 3).drop("n"), "value")


@query(
    "best_source",
    f"""WITH {DAILY_SQL}, k AS (SELECT * FROM daily WHERE NOT (tag = 'ema' AND epoch % 5 = 0) AND NOT (tag = 'raw' AND epoch % 7 = 0)),
    p AS (SELECT run, epoch, MAX(value) FILTER (WHERE tag = 'raw') AS r, MAX(value) FILTER (WHERE tag = 'ema') AS e FROM k GROUP BY 1, 2)
    SELECT run, epoch, CASE WHEN r IS NULL THEN 'ema' WHEN e IS NULL THEN 'raw' WHEN e < r THEN 'ema' ELSE 'raw' END AS source,
           ROUND(CASE WHEN r IS NULL OR e < r THEN e ELSE r END, 6) AS value FROM p""",
)
def best_source(spark, sf_dir):
    rows = daily(spark, sf_dir).where(~((F.col("tag") == "ema") & (F.col("epoch") % 5 == 0)) & ~((F.col("tag") == "raw") & (F.col("epoch") % 7 == 0)))
    return rounded(history.best_source(rows, ["run", "epoch"], "tag", "value"), "value").select("run", "epoch", "source", "value")


@query("epoch_loss", f"WITH {DAILY_SQL} SELECT run, ROUND(SUM(value * n) / SUM(n), 6) AS mean FROM daily GROUP BY 1")
def epoch_loss(spark, sf_dir):
    return rounded(history.batch_means(daily(spark, sf_dir), ["run"], "value", "n"), "mean")


@query(
    "running_loss",
    f"SELECT event_id, event_type, ROUND(SUM(value * {SCALE}::DOUBLE * (1 + event_id % 4)) OVER w / SUM(1 + event_id % 4) OVER w, 6) AS running_mean FROM events "
    "WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def running_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") * SCALE).alias("value"), (1 + F.col("event_id") % 4).alias("n"))
    out = history.running_means(rows, ["event_type"], ["event_id"], "value", "n")
    return rounded(out, "running_mean").select("event_id", "event_type", "running_mean")


@query(
    "moving_average",
    f"""WITH RECURSIVE {LONG_SQL}, s AS (
      SELECT user_id, i, event_id, value AS ema FROM long WHERE i = 0
      UNION ALL SELECT l.user_id, l.i, l.event_id, 0.9::DOUBLE * s.ema + 0.1::DOUBLE * l.value FROM s JOIN long l ON l.user_id = s.user_id AND l.i = s.i + 1)
    SELECT event_id, user_id, ROUND(ema, 6) AS ema FROM s""",
)
def moving_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") * SCALE).alias("value"))
    return rounded(history.smoothed(rows, ["user_id"], "event_id", "value", 0.9), "ema").select("event_id", "user_id", "ema")


@query(
    "early_stop",
    f"""WITH RECURSIVE {LONG_SQL}, s AS (
      SELECT user_id, i, event_id, value AS best, 0 AS bad, FALSE AS stopped FROM long WHERE i = 0
      UNION ALL SELECT l.user_id, l.i, l.event_id, CASE WHEN s.best - l.value > 1e-5 THEN l.value ELSE s.best END,
        CASE WHEN s.best - l.value > 1e-5 THEN 0 ELSE s.bad + 1 END, NOT (s.best - l.value > 1e-5) AND s.bad + 1 >= 10
      FROM s JOIN long l ON l.user_id = s.user_id AND l.i = s.i + 1 WHERE NOT s.stopped)
    SELECT user_id, MAX(event_id) FILTER (WHERE stopped) AS stop_epoch, MIN(best) AS best_value FROM s GROUP BY 1""",
)
def early_stop(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * SCALE).alias("value"))
    return history.early_stops(rows, ["user_id"], "event_id", "value", patience=10)
