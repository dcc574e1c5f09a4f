"""Fixed dimensions: sensors, bands, thresholds, hold-out sites."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the data set.
SENSORS = ("himawari", "goes", "meteosat")
NATIVE_SIZE = {"himawari": (81, 81), "goes": (141, 141), "meteosat": (144, 144)}
FIRST_INFRARED_BAND = {"himawari": 6, "goes": 6, "meteosat": 8}
BANDS_TOTAL = 16
FRAMES_PER_SAMPLE = 3
TARGET_SIZE = (41, 41)
TARGET_SUBDIR = "gpm_imerg"
RAIN_MM_H = 0.1
HEAVY_MM_H = 10.0
GATE_VALIDATION = 0.5
GATE_INFERENCE = 0.15
HOLDOUT_SITES = ("aceh", "ecuador", "andalusia", "atlantic_coast")
BAND_MODES = ("ir_only", "all", "visible_only")
MANIFEST_COLUMNS = (
    "unique_id",
    "name_location",
    "satellite_target",
    "datetime",
    "last_30_minutes_observation_filename",
    "gpm_imerg_filename",
)

SENSOR_ID = {name: i for i, name in enumerate(SENSORS)}


def band_indices(sensor: str, mode: str) -> tuple[int, ...]:
    """Positions in the 16-band stack that ``mode`` keeps for ``sensor``."""
    if sensor not in SENSOR_ID:
        raise ValueError(f"unknown sensor {sensor!r}, expected one of {SENSORS}")
    if mode not in BAND_MODES:
        raise ValueError(f"unknown band mode {mode!r}, expected one of {BAND_MODES}")
    split = FIRST_INFRARED_BAND[sensor]
    start, stop = {"ir_only": (split, BANDS_TOTAL), "visible_only": (0, split), "all": (0, BANDS_TOTAL)}[mode]
    return tuple(range(start, stop))


def max_channels(mode: str) -> int:
    return max(len(band_indices(s, mode)) for s in SENSORS)


def stored_positions(sensor: str, stored: str, wanted: str) -> tuple[int, ...]:
    """Where the wanted bands sit inside a stack stored with mode ``stored``."""
    have = band_indices(sensor, stored)
    missing = [b for b in band_indices(sensor, wanted) if b not in have]
    if missing:
        raise ValueError(f"{sensor}: mode {stored!r} does not hold bands {missing} needed by {wanted!r}")
    return tuple(have.index(b) for b in band_indices(sensor, wanted))


def sensors(spark: SparkSession) -> DataFrame:
    """Three rows as an inline table: Catalyst knows the size and broadcasts by itself."""
    rows = ", ".join(
        f"('{s}', {i}, {NATIVE_SIZE[s][0]}, {NATIVE_SIZE[s][1]}, '{s}')" for s, i in SENSOR_ID.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(sensor, sensor_id, height, width, subdir)")


def bands(spark: SparkSession) -> DataFrame:
    """48 rows (sensor, sensor_id, band, is_ir), with the modes' membership as flags."""
    return sensors(spark).select(
        "sensor",
        "sensor_id",
        F.explode(F.sequence(F.lit(0), F.lit(BANDS_TOTAL - 1))).alias("band"),
    ).withColumn("is_ir", F.col("band") >= sensor_case(F.col("sensor"), FIRST_INFRARED_BAND))


def bands_for_mode(spark: SparkSession, mode: str) -> DataFrame:
    """Rows of :func:`bands` active in ``mode``; ``position`` counts inside the stored subset."""
    if mode not in BAND_MODES:
        raise ValueError(f"unknown band mode {mode!r}, expected one of {BAND_MODES}")
    all_bands = bands(spark)
    keep = {"ir_only": F.col("is_ir"), "visible_only": ~F.col("is_ir"), "all": F.lit(True)}[mode]
    start = sensor_case(F.col("sensor"), {s: band_indices(s, mode)[0] for s in SENSORS})
    return all_bands.where(keep).withColumn("position", F.col("band") - start)


def sensor_case(sensor: Column, values: dict) -> Column:
    """A per-sensor constant as a CASE expression (no join needed for three rows)."""
    out = None
    for name, value in values.items():
        literal = F.lit(value)
        out = F.when(sensor == name, literal) if out is None else out.when(sensor == name, literal)
    return out
