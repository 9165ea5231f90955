"""Table schemas, feature contracts and input rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_D, _S, _I, _L = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType()
_T, _B = T.TimestampType(), T.BooleanType()

# Names of the daily variables, in the order sources deliver them.
DAILY_VARIABLES = [
    "temperature_2m_max",
    "temperature_2m_min",
    "temperature_2m_mean",
    "precipitation_sum",
    "rain_sum",
    "snowfall_sum",
    "precipitation_hours",
    "wind_speed_10m_max",
    "wind_gusts_10m_max",
    "wind_direction_10m_dominant",
    "pressure_msl_mean",
    "relative_humidity_2m_mean",
    "cloud_cover_mean",
    "shortwave_radiation_sum",
    "et0_fao_evapotranspiration",
]

# Raw daily weather of one station.
STATION = _schema(time=_T, **{v: _D for v in DAILY_VARIABLES},
                  latitude=_D, longitude=_D, city=_S, state=_S, zone=_S)

# Raw storm fixes. All text: the file's second line holds units.
# Column names of the track archive.
TRACK_COLUMNS = [
    "ISO_TIME",
    "NATURE",
    "LAT",
    "LON",
    "WMO_WIND",
    "WMO_PRES",
    "USA_WIND",
    "USA_PRES",
    "USA_GUST",
    "TRACK_TYPE",
    "DIST2LAND",
    "LAND",
]
TRACKS = _schema(**{c: _S for c in TRACK_COLUMNS})

# Fact table of raw observations, unique by (city, time).
OBSERVATIONS = _schema(city=_S, time=_T, **{v: _D for v in DAILY_VARIABLES},
                       latitude=_D, longitude=_D, batch_id=_S, ingested_at=_T)
OBSERVATION_KEY = ["city", "time"]

# One row per state change of an ingest batch.
BATCHES = _schema(id=_L, started_at=_T, completed_at=_T, cities_count=_I, rows_ingested=_L,
                  status=_S, error_message=_S, recorded_at=_T)

PREDICTION_LOG = _schema(id=_L, model_name=_S, timestamp=_T,
                         features=T.MapType(_S, _D), prediction=_S)

RUN_METRICS = _schema(run_id=_S, model=_S, split=_S, metric=_S, value=_D)

# Short names the models use.
SHORT_NAMES = {
    "temperature_2m_max": "temp_max",
    "temperature_2m_min": "temp_min",
    "temperature_2m_mean": "temp_mean",
    "precipitation_sum": "precipitation",
    "wind_gusts_10m_max": "wind_gust_max",
    "wind_direction_10m_dominant": "wind_direction",
    "shortwave_radiation_sum": "solar_radiation",
    "et0_fao_evapotranspiration": "evapotranspiration",
}

# Lagged and rolled columns with their row offsets and windows.
LAG_COLUMNS = ["temp_max", "temp_min", "precipitation", "wind_speed_10m_max"]
LAGS = [1, 3, 7]
ROLL_COLUMNS = ["temp_max", "precipitation"]
ROLL_WINDOWS = [3, 7]

# Feature contracts of the three models.
CYCLONE_FEATURES = [
    "lat_abs",
    "lon",
    "lat",
    "pressure_min",
    "dist_to_land",
    "year",
    "month",
    "dayofyear",
]
HEATWAVE_FEATURES = [
    "temp_max_lag_1",
    "temp_max_lag_3",
    "temp_max_lag_7",
    "temp_max_roll_mean_3",
    "temp_max_roll_mean_7",
    "temp_min_lag_1",
    "precipitation_lag_1",
    "relative_humidity_2m_mean",
    "wind_speed_10m_max",
    "pressure_msl_mean",
    "month_sin",
    "month_cos",
    "month",
]
RAINFALL_FEATURES = [
    "precipitation_lag_1",
    "precipitation_lag_3",
    "precipitation_lag_7",
    "precipitation_roll_mean_3",
    "precipitation_roll_mean_7",
    "temp_max_lag_1",
    "temp_max_roll_mean_3",
    "relative_humidity_2m_mean",
    "wind_speed_10m_max",
    "pressure_msl_mean",
    "cloud_cover_mean",
    "month_sin",
    "month_cos",
    "month",
]


@dataclass(frozen=True)
class Rule:
    """What a scoring input must satisfy; ``default`` None means the value is required."""

    default: float | None = None
    low: float | None = None
    high: float | None = None
    whole: bool = False


# Defaults and ranges of the scoring inputs.
CYCLONE_RULES = {
    "lat_abs": Rule(low=0, high=90),
    "lon": Rule(low=-180, high=180),
    "lat": Rule(low=-90, high=90),
    "pressure_min": Rule(low=850, high=1050),
    "dist_to_land": Rule(default=0, low=0),
    "year": Rule(default=2024, low=1900, high=2100, whole=True),
    "month": Rule(low=1, high=12, whole=True),
    "dayofyear": Rule(low=1, high=366, whole=True),
}
HEATWAVE_RULES = {
    "temp_max_lag_1": Rule(),
    "temp_max_lag_3": Rule(default=0),
    "temp_max_lag_7": Rule(default=0),
    "temp_max_roll_mean_3": Rule(),
    "temp_max_roll_mean_7": Rule(default=0),
    "temp_min_lag_1": Rule(),
    "precipitation_lag_1": Rule(default=0),
    "relative_humidity_2m_mean": Rule(low=0, high=100),
    "wind_speed_10m_max": Rule(low=0),
    "pressure_msl_mean": Rule(),
    "month_sin": Rule(),
    "month_cos": Rule(),
    "month": Rule(low=1, high=12, whole=True),
}
RAINFALL_RULES = {
    "precipitation_lag_1": Rule(default=0),
    "precipitation_lag_3": Rule(default=0),
    "precipitation_lag_7": Rule(default=0),
    "precipitation_roll_mean_3": Rule(),
    "precipitation_roll_mean_7": Rule(default=0),
    "temp_max_lag_1": Rule(),
    "temp_max_roll_mean_3": Rule(),
    "relative_humidity_2m_mean": Rule(low=0, high=100),
    "wind_speed_10m_max": Rule(low=0),
    "pressure_msl_mean": Rule(),
    "cloud_cover_mean": Rule(low=0, high=100),
    "month_sin": Rule(),
    "month_cos": Rule(),
    "month": Rule(low=1, high=12, whole=True),
}

# The stations, as (city, latitude, longitude, state, zone).
STATIONS = [
    ("Mumbai", 19.0760, 72.8777, "Maharashtra", "coastal"),
    ("Chennai", 13.0827, 80.2707, "Tamil Nadu", "coastal"),
    ("Kolkata", 22.5726, 88.3639, "West Bengal", "coastal"),
    ("Delhi", 28.7041, 77.1025, "Delhi", "inland"),
    ("Ahmedabad", 23.0225, 72.5714, "Gujarat", "arid"),
    ("Hyderabad", 17.3850, 78.4867, "Telangana", "inland"),
    ("Bengaluru", 12.9716, 77.5946, "Karnataka", "inland"),
    ("Kochi", 9.9312, 76.2673, "Kerala", "coastal"),
    ("Bhubaneswar", 20.2961, 85.8245, "Odisha", "coastal"),
    ("Jaipur", 26.9124, 75.7873, "Rajasthan", "arid"),
    ("Lucknow", 26.8467, 80.9462, "Uttar Pradesh", "inland"),
    ("Guwahati", 26.1445, 91.7362, "Assam", "humid"),
    ("Pune", 18.5204, 73.8567, "Maharashtra", "inland"),
    ("Visakhapatnam", 17.6868, 83.2185, "Andhra Pradesh", "coastal"),
    ("Surat", 21.1702, 72.8311, "Gujarat", "coastal"),
]


def station_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STATIONS, "city string, latitude double, longitude double, state string, zone string")
