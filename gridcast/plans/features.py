"""Statistics, scaling, filling, resizing, turning, scoring and profiles."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridcast import dims
from gridcast.functions import columns as fx
from gridcast.functions.rows import unpack
from gridcast.functions.kernels import resize_column
from gridcast.operators import augment, profiles, scoring, stats
from gridcast.plans.registry import query, rounded, rounds
from gridcast.plans.views import GRID, GRIDS_SQL, PAIRS_SQL, SCALE, SLOTS_SQL, cells, day_slots, grids, pixel_pairs, table


# ---- statistics and scaling -----------------------------------------------------------------------
BAND_STATS_SQL = f"""{GRIDS_SQL},
stats AS (SELECT sensor_id, i AS band, AVG(v) AS mean, CASE WHEN STDDEV_POP(v) <= 1e-6 THEN 1 ELSE STDDEV_POP(v) END AS std, COUNT(*) AS n_pixels FROM cells GROUP BY 1, 2)"""


def band_values(spark, sf_dir):
    rows = grids(spark, sf_dir)
    return unpack(rows, ["uid", "sensor_id"], "grid", "band", "value")


@query("band_stats", f"WITH {BAND_STATS_SQL} SELECT sensor_id, band, n_pixels, {rounds('mean', 'std')} FROM stats")
def band_stats(spark, sf_dir):
    return rounded(stats.value_stats(band_values(spark, sf_dir), ["sensor_id", "band"], "value"), "mean", "std")


@query("band_stats_strided", f"WITH {GRIDS_SQL} SELECT sensor_id, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_POP(v), 6) AS std, COUNT(*) AS n_pixels FROM cells WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY 1")
def band_stats_strided(spark, sf_dir):
    pixels = cells(grids(spark, sf_dir), "grid", ["uid", "sensor_id"], 8)
    return rounded(stats.value_stats(stats.strided(pixels, 2), ["sensor_id"], "v"), "mean", "std")


@query("zscore", f"WITH {BAND_STATS_SQL} SELECT uid, c.i AS band, ROUND((v - mean) / std, 6) AS z FROM cells c JOIN stats s ON c.sensor_id = s.sensor_id AND c.i = s.band")
def zscore(spark, sf_dir):
    """Arrays stay whole: the three rows of statistics (one per sensor id 0..2) are broadcast as arrays."""
    table_of = stats.stats_arrays(stats.value_stats(band_values(spark, sf_dir), ["sensor_id", "band"], "value"), ["sensor_id"], "band")
    three = table_of.where(F.col("sensor_id").between(0, 2))
    rows = grids(spark, sf_dir).join(F.broadcast(three), "sensor_id")
    scaled = rows.select("uid", stats.standardise_array(F.col("grid"), F.col("means"), F.col("stds")).alias("z"))
    return rounded(unpack(scaled, ["uid"], "z", "band", "z"), "z")


@query(
    "zscore_long",
    f"""WITH {GRIDS_SQL}, b AS (SELECT uid, sensor_id, i // 4 AS band, i % 4 AS p, v FROM cells),
    s AS (SELECT sensor_id, band, AVG(v) AS mean, STDDEV_POP(v) AS std FROM b GROUP BY 1, 2)
    SELECT uid, CAST(b.band AS INTEGER) AS band, CAST(p AS INTEGER) AS p, ROUND((v - mean) / std, 6) AS z FROM b JOIN s ON b.sensor_id = s.sensor_id AND b.band = s.band""",
)
def zscore_long(spark, sf_dir):
    """16 bands of four pixels each in long form, against the (sensor, band) dimension."""
    rows = band_values(spark, sf_dir).select(
        "uid", fx.sensor_name(F.col("sensor_id")).alias("sensor"), (F.col("band") / 4).cast("int").alias("band"),
        (F.col("band") % 4).cast("int").alias("p"), F.col("value").cast("double").alias("value"),
    )
    known = stats.value_stats(rows, ["sensor", "band"], "value")
    return rounded(stats.standardise_long(rows, known), "z").select("uid", "band", "p", "z")


# ---- bands ----------------------------------------------------------------------------------------
@query(
    "band_table",
    f"""WITH {GRIDS_SQL}, b AS (SELECT sensor_id, i // 4 AS band, AVG(v) AS mean FROM cells GROUP BY 1, 2),
    m AS (SELECT *, CASE sensor_id WHEN 2 THEN 8 ELSE 6 END AS split FROM b)
    SELECT CASE sensor_id WHEN 0 THEN 'himawari' WHEN 1 THEN 'goes' ELSE 'meteosat' END AS sensor, mode, CAST(band AS INTEGER) AS band,
           CAST(CASE mode WHEN 'ir_only' THEN band - split ELSE band END AS INTEGER) AS position, ROUND(mean, 6) AS mean
    FROM m, (SELECT UNNEST(['ir_only', 'visible_only', 'all']) AS mode)
    WHERE mode = 'all' OR (mode = 'ir_only' AND band >= split) OR (mode = 'visible_only' AND band < split)""",
)
def band_table(spark, sf_dir):
    """Mean level of every active band in every mode, with its position in the stored subset."""
    rows = band_values(spark, sf_dir).select(
        fx.sensor_name(F.col("sensor_id")).alias("sensor"), (F.col("band") / 4).cast("int").alias("band"), "value"
    )
    levels = rows.groupBy("sensor", "band").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    modes = None
    for mode in dims.BAND_MODES:
        part = dims.bands_for_mode(spark, mode).select("sensor", F.lit(mode).alias("mode"), "band", "position")
        modes = part if modes is None else modes.unionByName(part)
    return rounded(levels.join(F.broadcast(modes), ["sensor", "band"]), "mean").select("sensor", "mode", "band", "position", "mean")


@query(
    "band_selection",
    f"""WITH {GRIDS_SQL} SELECT uid, CAST(i // 4 - CASE sensor_id WHEN 2 THEN 8 ELSE 6 END AS INTEGER) AS position, CAST(i % 4 AS INTEGER) AS p, CAST(ROUND(v * 100) AS INTEGER) AS level
    FROM cells WHERE i // 4 >= CASE sensor_id WHEN 2 THEN 8 ELSE 6 END""",
)
def band_selection(spark, sf_dir):
    """Infrared planes out of arrays: the stored subset holds all 16 bands, positions are looked up."""
    rows = grids(spark, sf_dir)
    parts = []
    for s, ident in dims.SENSOR_ID.items():
        positions = dims.stored_positions(s, "all", "ir_only")
        planes = F.flatten(F.array(*[F.slice("grid", p * 4 + 1, 4) for p in positions]))
        parts.append(unpack(rows.where(F.col("sensor_id") == ident), ["uid"], planes, "k", "v"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(
        "uid", (F.col("k") / 4).cast("int").alias("position"), (F.col("k") % 4).cast("int").alias("p"),
        F.round(F.col("v").cast("double") * 100).cast("int").alias("level"),
    )


# ---- frames ---------------------------------------------------------------------------------------
@query(
    "fill_frames",
    f"""WITH {SLOTS_SQL}, s AS (SELECT DISTINCT user_id, day FROM slot_means), g AS (SELECT user_id, day, CAST(t AS INTEGER) AS t FROM s, (SELECT UNNEST(range(3)) AS t)),
    f AS (SELECT g.*, v, v IS NOT NULL AS valid FROM g LEFT JOIN slot_means m ON g.user_id = m.user_id AND g.day = m.day AND g.t = m.t)
    SELECT user_id, day, t, valid, BOOL_OR(valid) OVER (PARTITION BY user_id, day) AS has_data,
           ROUND(COALESCE(LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                          FIRST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled,
           ROUND(COALESCE(v, 0), 6) AS zeroed FROM f""",
)
def fill_frames(spark, sf_dir):
    rows = day_slots(spark, sf_dir)
    zipped = F.arrays_zip(
        F.col("valid").alias("valid"), fx.fill_slots(F.col("values"), F.col("valid")).alias("filled"),
        fx.fill_slots(F.col("values"), F.col("valid"), "zero").alias("zeroed"),
    )
    out = unpack(rows.withColumn("has_data", fx.has_data(F.col("valid"))), ["user_id", "day", "has_data"], zipped, "t", "_s")
    return out.select(
        "user_id", "day", "t", F.col("_s.valid").alias("valid"), "has_data",
        F.round(F.col("_s")["filled"], 6).alias("filled"), F.round(F.col("_s")["zeroed"], 6).alias("zeroed"),
    )


@query(
    "diff_stack",
    f"""WITH {GRIDS_SQL}, f AS (SELECT uid, i // 16 AS t, i % 16 AS c, v FROM cells ),
    d AS (SELECT a.uid, 4 + a.t AS t, a.c, b.v - a.v AS v FROM f a JOIN f b ON a.uid = b.uid AND a.c = b.c AND b.t = a.t + 1),
    z AS (SELECT uid, 7 AS t, k AS c, 0.0::DOUBLE AS v FROM grids, (SELECT UNNEST(range(16)) AS k))
    SELECT uid, CAST(t * 16 + c AS INTEGER) AS channel, ROUND(v, 6) AS value FROM (SELECT * FROM f UNION ALL SELECT * FROM d UNION ALL SELECT * FROM z)""",
)
def diff_stack(spark, sf_dir):
    """Four frames of 16 channels, their three steps, flattened and padded to 128 channels."""
    wide = F.transform("grid", lambda v: v.cast("double"))
    frames = F.array(*[F.slice(wide, 16 * t + 1, 16) for t in range(4)])
    rows = grids(spark, sf_dir).select("uid", fx.flatten_stack(fx.slot_differences(frames, 4), 128).alias("stack"))
    return rounded(unpack(rows, ["uid"], "stack", "channel", "value"), "value")


# ---- resize ---------------------------------------------------------------------------------------
def _resize_sql(n_in, n_out, mode):
    axis = f"(SELECT UNNEST(range({n_out})) AS d)"
    if mode == "nearest":
        taps = f"SELECT d, d * {n_in} // {n_out} AS s, 1.0::DOUBLE AS w FROM {axis}"
    elif mode == "bilinear":
        taps = f"""SELECT d, LEAST(CAST(FLOOR(p) AS INTEGER) + k, {n_in - 1}) AS s, CASE k WHEN 0 THEN 1 - (p - FLOOR(p)) ELSE p - FLOOR(p) END AS w
          FROM (SELECT d, GREATEST((d + 0.5::DOUBLE) * {n_in} / {n_out} - 0.5::DOUBLE, 0) AS p FROM {axis}), (SELECT UNNEST([0, 1]) AS k)"""
    else:
        taps = f"""SELECT d, GREATEST(LEAST(CAST(FLOOR(p) AS INTEGER) + k, {n_in - 1}), 0) AS s,
            CASE WHEN q <= 1 THEN 1.25::DOUBLE * q * q * q - 2.25::DOUBLE * q * q + 1 ELSE -0.75::DOUBLE * q * q * q + 3.75::DOUBLE * q * q - 6 * q + 3 END AS w
          FROM (SELECT d, k, p, ABS(p - FLOOR(p) - k) AS q FROM (SELECT d, (d + 0.5::DOUBLE) * {n_in} / {n_out} - 0.5::DOUBLE AS p FROM {axis}), (SELECT UNNEST([-1, 0, 1, 2]) AS k))"""
    return f"""WITH {GRIDS_SQL}, taps AS ({taps})
    SELECT uid, CAST(a.d AS INTEGER) AS y, CAST(b.d AS INTEGER) AS x, ROUND(SUM(v * a.w * b.w), 6) AS v
    FROM cells JOIN taps a ON a.s = cells.y JOIN taps b ON b.s = cells.x GROUP BY uid, a.d, b.d"""


def _resized(spark, sf_dir, n_out, mode):
    out = grids(spark, sf_dir).select("uid", resize_column(GRID, (n_out, n_out), mode)("grid").alias("grid"))
    return rounded(cells(out, "grid", ["uid"], n_out), "v")


@query("resize_bilinear", _resize_sql(8, 12, "bilinear"))
def resize_bilinear(spark, sf_dir):
    return _resized(spark, sf_dir, 12, "bilinear")


@query("resize_bilinear_down", _resize_sql(8, 5, "bilinear"))
def resize_bilinear_down(spark, sf_dir):
    return _resized(spark, sf_dir, 5, "bilinear")


@query("resize_bicubic", _resize_sql(8, 12, "bicubic"))
def resize_bicubic(spark, sf_dir):
    return _resized(spark, sf_dir, 12, "bicubic")


@query("resize_nearest", _resize_sql(8, 5, "nearest"))
def resize_nearest(spark, sf_dir):
    return _resized(spark, sf_dir, 5, "nearest")


# ---- augmentation ---------------------------------------------------------------------------------
def _unit_sql(tag):
    return f"CAST('0x' || SUBSTR(MD5('7:{tag}:' || CAST(uid AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(
    "flip_rotate",
    f"""WITH {GRIDS_SQL}, d AS (SELECT uid, {_unit_sql('flip_x')} < 0.5::DOUBLE AS fx, {_unit_sql('flip_y')} < 0.5::DOUBLE AS fy,
        CASE WHEN {_unit_sql('rotate')} < 0.5::DOUBLE THEN CAST(FLOOR({_unit_sql('turns')} * 3) AS INTEGER) + 1 ELSE 0 END AS k FROM grids),
    f AS (SELECT c.uid, k, CASE WHEN fy THEN 7 - y ELSE y END AS y, CASE WHEN fx THEN 7 - x ELSE x END AS x, v FROM cells c JOIN d ON c.uid = d.uid)
    SELECT uid, CAST(k AS INTEGER) AS turns, CAST(CASE k WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END AS INTEGER) AS y,
           CAST(CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END AS INTEGER) AS x, ROUND(v, 6) AS v FROM f""",
)
def flip_rotate(spark, sf_dir):
    out = augment.augment(grids(spark, sf_dir), augment.PROFILES["base"], 7, {"grid": (1, *GRID)})
    return rounded(cells(out, "grid", ["uid", "turns"], 8), "v")


def _mix_sql(x: str) -> str:
    """The kernel's scramble of 32-bit integers on a column of a subquery, step by step."""
    steps = [(16, 0x21F0AAAD), (15, 0x735A2D97)]
    for shift, factor in steps:
        x = f"SELECT uid, i, part, v, high, ((xor(z, z >> {shift}))::HUGEINT * {factor} & 4294967295)::BIGINT AS z FROM ({x})"
    return f"SELECT uid, i, part, v, high, xor(z, z >> 15) AS z FROM ({x})"


_DRAWN = """SELECT uid, i, part, v, ('0x' || SUBSTR(d, 1, 8))::BIGINT AS high, xor(2 * i + part, ('0x' || SUBSTR(d, 9, 8))::BIGINT) AS z
    FROM (SELECT uid, i::BIGINT AS i, v, MD5('3:noise-grid:' || uid) AS d FROM cells), (SELECT UNNEST([0, 1])::BIGINT AS part)"""
_DRAWN = _mix_sql(f"SELECT uid, i, part, v, high, xor(z, high) AS z FROM ({_mix_sql(_DRAWN)})")


@query(
    "noise",
    f"""WITH {GRIDS_SQL}, u AS (SELECT uid, i, v, MAX(z) FILTER (WHERE part = 0) AS a, MAX(z) FILTER (WHERE part = 1) AS b FROM ({_DRAWN}) GROUP BY uid, i, v)
    SELECT uid, CAST(i AS INTEGER) AS i, ROUND(v + SQRT(LN((a + 0.5::DOUBLE) / 4294967296.0::DOUBLE) * -2) * COS(b / 4294967296.0::DOUBLE * 6.283185307179586::DOUBLE) * 0.5::DOUBLE, 6) AS v FROM u""",
)
def noise(spark, sf_dir):
    profile = augment.Augmentation(noise_enabled=True, noise_sigma=0.5)
    out = augment.augment(grids(spark, sf_dir), profile, 3, {}, noisy=("grid",))
    return unpack(out, ["uid"], "grid", "i", "v").withColumn("v", F.round(F.col("v").cast("double"), 6))


# ---- targets --------------------------------------------------------------------------------------
@query(
    "target_transform",
    f"WITH {PAIRS_SQL}, r AS (SELECT uid, line, part, site_id, CASE WHEN line = 3 THEN -target WHEN line = 5 THEN 0.1::DOUBLE ELSE target END AS rate FROM pairs) "
    "SELECT uid, line, part, site_id, ROUND(LN(1 + GREATEST(rate, 0)), 6) AS log_rate, CAST(CASE WHEN rate > 0.1::DOUBLE THEN 1 ELSE 0 END AS FLOAT) AS rain FROM r",
)
def target_transform(spark, sf_dir):
    rate = F.when(F.col("line") == 3, -F.col("target")).when(F.col("line") == 5, 0.1).otherwise(F.col("target"))
    return pixel_pairs(spark, sf_dir).select(
        "uid", "line", "part", "site_id", F.round(fx.log_target(rate), 6).alias("log_rate"), fx.rain_mask(rate).alias("rain")
    )


@query(
    "drizzle_cut",
    f"WITH {PAIRS_SQL}, r AS (SELECT uid, line, part, site_id, CASE WHEN line = 4 THEN 'NaN'::DOUBLE WHEN line = 6 THEN 'Infinity'::DOUBLE ELSE pred * 30 - 1 END AS v FROM pairs), "
    "f AS (SELECT *, CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END AS f FROM r), c AS (SELECT *, LEAST(GREATEST(f, 0), 60) AS c FROM f) "
    "SELECT uid, line, part, site_id, ROUND(f, 6) AS finite, ROUND(CASE WHEN c < 0.15::DOUBLE THEN 0 ELSE c END, 6) AS rate FROM c",
)
def drizzle_cut(spark, sf_dir):
    value = F.when(F.col("line") == 4, F.lit(float("nan"))).when(F.col("line") == 6, F.lit(float("inf"))).otherwise(F.col("pred") * 30 - 1)
    finite = fx.finite_or_zero(value)
    out = pixel_pairs(spark, sf_dir).select("uid", "line", "part", "site_id", finite.alias("finite"), fx.drizzle_cut(finite).alias("rate"))
    return rounded(out, "finite", "rate")


# ---- scoring --------------------------------------------------------------------------------------
def lean_model(sat: np.ndarray, aux: np.ndarray) -> dict[str, np.ndarray]:
    """A stand-in for a user's model: each pixel leans on its left neighbour, so mirroring matters."""
    grid = sat[:, 0].astype(np.float64)
    left = np.zeros_like(grid)
    left[:, :, 1:] = grid[:, :, :-1]
    mean = 2.0 * grid + left + 0.1 * aux[:, :1, None].astype(np.float64)
    return {"mean": mean, "rain_logit": 10.0 * grid - 1.0}


def _score_sql(mirrored):
    # neighbours inside the list, before it is unnested
    scored = """n AS (SELECT uid, sensor_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v,
        CASE WHEN i % 8 > 0 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END AS l, CASE WHEN i % 8 < 7 THEN CAST(embedding[i + 2] AS DOUBLE) ELSE 0 END AS r FROM grids, (SELECT UNNEST(range(64)) AS i)),
    s AS (SELECT uid, y, x, 2 * v + l + 0.1::DOUBLE * CAST(sensor_id AS DOUBLE) AS m, 2 * v + r + 0.1::DOUBLE * CAST(sensor_id AS DOUBLE) AS mf,
        1 / (1 + EXP(1 - 10 * v)) > 0.15::DOUBLE AS wet FROM n),
    p AS (SELECT uid, y, x, CASE WHEN wet THEN EXP(GREATEST(m, 0)) - 1 ELSE 0 END AS a, CASE WHEN wet THEN EXP(GREATEST(mf, 0)) - 1 ELSE 0 END AS b FROM s)"""
    value = "0.5::DOUBLE * (a + b)" if mirrored else "a"
    return f"WITH {GRIDS_SQL}, {scored} SELECT uid, y, x, ROUND(CAST(CAST({value} AS FLOAT) AS DOUBLE), 4) AS rate FROM p"


def _scored(spark, sf_dir, mirrored):
    rows = grids(spark, sf_dir).select("uid", F.col("grid").alias("features"), F.array(F.col("sensor_id").cast("float")).alias("aux"))
    out = scoring.score(rows, lean_model, (1, *GRID), ["uid"], mirrored=mirrored)
    long = cells(out, "rate", ["uid"], 8)
    return long.select("uid", "y", "x", F.round("v", 4).alias("rate"))


@query("score_grids", _score_sql(False))
def score_grids(spark, sf_dir):
    return _scored(spark, sf_dir, False)


@query("score_mirrored", _score_sql(True))
def score_mirrored(spark, sf_dir):
    return _scored(spark, sf_dir, True)


# ---- profiles -------------------------------------------------------------------------------------
@query(
    "prediction_profile",
    f"WITH {PAIRS_SQL} SELECT sensor_id, ROUND(AVG(pred), 6) AS mean, ROUND(AVG(CASE WHEN pred > 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS nonzero_pct, "
    "MAX(pred) AS max, MIN(pred) AS min, ROUND(QUANTILE_CONT(pred, 0.95), 6) AS p95 FROM pairs GROUP BY 1",
)
def prediction_profile(spark, sf_dir):
    return rounded(profiles.predictions(pixel_pairs(spark, sf_dir), "pred", ["sensor_id"]), "mean", "nonzero_pct", "p95")


@query(
    "latency_quantiles",
    "WITH r AS (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, MAX(n) AS n, MAX(value) FILTER (WHERE i = n * 90 // 100) AS p90, MAX(value) FILTER (WHERE i = n * 99 // 100) AS p99 FROM r GROUP BY 1",
)
def latency_quantiles(spark, sf_dir):
    return profiles.latencies(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(
    "tensor_profile",
    f"WITH {GRIDS_SQL}, s AS (SELECT sensor_id, uid, AVG(v) AS m, MIN(v) AS lo, MAX(v) AS hi, BOOL_AND(NOT isnan(v) AND NOT isinf(v)) AS f FROM cells GROUP BY 1, 2) "
    "SELECT sensor_id, COUNT(*) AS samples, ROUND(AVG(m), 6) AS mean_of_means, MIN(lo) AS min, MAX(hi) AS max, BOOL_AND(f) AS finite FROM s GROUP BY 1",
)
def tensor_profile(spark, sf_dir):
    pixels = cells(grids(spark, sf_dir), "grid", ["uid", "sensor_id"], 8)
    return rounded(profiles.tensors(pixels, "uid", "sensor_id", "v"), "mean_of_means")


@query(
    "day_night_profile",
    f"WITH c AS (SELECT CASE WHEN hour(ts) BETWEEN 14 AND 22 THEN 'night' WHEN hour(ts) BETWEEN 2 AND 7 THEN 'day' END AS hour_class, value * {SCALE}::DOUBLE AS value FROM events) "
    "SELECT hour_class, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std, BOOL_AND(NOT isnan(value) AND NOT isinf(value)) AS finite FROM c WHERE hour_class IS NOT NULL GROUP BY 1",
)
def day_night_profile(spark, sf_dir):
    return rounded(profiles.day_night(table(spark, sf_dir, "events").select("ts", (F.col("value") * SCALE).alias("value")), "ts", "value"), "mean", "std")


@query(
    "rain_distribution",
    f"""WITH {PAIRS_SQL}, l AS (SELECT sensor_id, target AS x, LN(1 + target) AS g FROM pairs), m AS (SELECT sensor_id, AVG(x) AS mx, AVG(g) AS mg FROM l GROUP BY 1),
    d AS (SELECT l.sensor_id, x, x - mx AS dx, g - mg AS dg FROM l JOIN m ON l.sensor_id = m.sensor_id)
    SELECT sensor_id, ROUND(AVG(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_fraction, ROUND(AVG(dx * dx * dx) / POW(AVG(dx * dx), 1.5), 6) AS skew_raw,
           ROUND(AVG(dg * dg * dg) / POW(AVG(dg * dg), 1.5), 6) AS skew_log FROM d GROUP BY 1""",
)
def rain_distribution(spark, sf_dir):
    return rounded(profiles.rain_distribution(pixel_pairs(spark, sf_dir), "target", ["sensor_id"]), "zero_fraction", "skew_raw", "skew_log")


@query("finite_audit", "SELECT l_orderkey AS uid, COUNT(*) AS bad FROM lineitem WHERE l_discount = 0 GROUP BY 1")
def finite_audit(spark, sf_dir):
    """Samples with a value that is not finite (tax per discount, infinite or NaN at discount 0)."""
    ratio = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide("l_tax", "l_discount"))
    return profiles.finite_audit(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), ratio.alias("v")), "uid", "v")
