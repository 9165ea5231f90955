"""The daily weather job: labels, lags, rolling statistics and season in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from isobar.functions.columns import (coerce_numeric, drop_all_null, first_present,
                                      normalise_nulls, rename_present, seasonal_features)
from isobar.operators.chunks import CHUNK, Stage, chunk_directory, join_per_entity, over_chunks
from isobar.operators.cyclone import prepare_tracks
from isobar.operators.explore import event_summary
from isobar.operators.labels import (HOT, HOT_DAYS, RAIN_QUANTILES, SEVERE_HOT, cyclonic_flag,
                                     heatwave_columns, rain_flag, rain_thresholds)
from isobar.operators.panel import lag_columns, rolling_columns
from isobar.schemas import LAG_COLUMNS, LAGS, ROLL_COLUMNS, ROLL_WINDOWS, SHORT_NAMES
from isobar.session import materialize
from isobar.sources.files import read_station_csv, read_tracks_csv
from isobar.sources.sinks import write_csv, write_partitioned


# Columns that the windows read; border rows carry no others.
READS = list(dict.fromkeys(["temp_max", "precipitation", *LAG_COLUMNS, *ROLL_COLUMNS]))


def with_short_names(raw: DataFrame) -> DataFrame:
    """Rename source columns to the short names, or NULL-fill the labelled ones it lacks."""
    named = normalise_nulls(rename_present(raw, SHORT_NAMES))
    wanted = {"temp_max": None, "temp_min": None, "temp_mean": None, "precipitation": 0.0}
    for col, default in wanted.items():
        if col not in named.columns:
            other = first_present(named, ["precip"]) if col == "precipitation" else None
            fill = F.lit(default) if other is None else other
            named = named.withColumn(col, fill.cast("double"))
    return coerce_numeric(named, {c: c for c in wanted})


def _labelled(df: DataFrame, stages: Sequence[Stage], back: int, ahead: int,
              q: tuple[float, float], method: str, entity: str, time: str,
              unit: str, gust_col: str) -> DataFrame:
    """Window columns and the rain and cyclonic flags, with one shuffle of the panel.

    The windows and the join of the rainfall thresholds use the same (entity, chunk) spread. If
    a stage made ``_rain_next``, the next row's rain flag is added too.
    """
    wide = over_chunks(df, stages, back=back, ahead=ahead, entity=entity, time=time, unit=unit,
                       keep_chunk=True, reads=READS)
    joined = join_per_entity(wide, chunk_directory(df, entity, time, unit),
                             rain_thresholds(df, q, method, entity, time), entity)
    return flagged(joined, df, gust_col).drop(CHUNK)


def flagged(joined: DataFrame, df: DataFrame, gust_col: str = "wind_gust_max") -> DataFrame:
    """The rain and cyclonic flags of rows that carry their thresholds; ``df`` has the source columns."""
    rain = {"extreme_rainfall": rain_flag(F.col("precipitation"), high=False),
            "heavy_rainfall": rain_flag(F.col("precipitation"), high=True),
            "cyclonic_flag": cyclonic_flag(df, gust_col=gust_col)}
    if "_rain_next" in joined.columns:
        has_next = F.col("heatwave_flag_next").isNotNull()
        rain["extreme_rainfall_next"] = F.when(has_next, rain_flag(F.col("_rain_next"), high=False))
    return joined.withColumns(rain).drop("rain_q_low", "rain_q_high", "_rain_next")


def label_events(df: DataFrame, hot: float = HOT, severe: float = SEVERE_HOT,
                 days: int = HOT_DAYS, q: tuple[float, float] = RAIN_QUANTILES,
                 method: str = "exact", entity: str = "city", time: str = "time",
                 unit: str = "year", gust_col: str = "wind_gust_max") -> DataFrame:
    """All five event flags."""
    return _labelled(df, [lambda w: heatwave_columns(w, hot, severe, days)], days - 1, 0, q,
                     method, entity, time, unit, gust_col)


def weather_features(df: DataFrame, hot: float = HOT, severe: float = SEVERE_HOT,
                     days: int = HOT_DAYS, q: tuple[float, float] = RAIN_QUANTILES,
                     method: str = "exact", lags: Sequence[int] = LAGS,
                     windows: Sequence[int] = ROLL_WINDOWS, include_current: bool = False,
                     targets: bool = False, drop_unlagged: bool = True, tz: str = "UTC",
                     entity: str = "city", time: str = "time", unit: str = "year",
                     gust_col: str = "wind_gust_max") -> DataFrame:
    """Labelled and featurised panel, shuffled once.

    With ``targets`` the next day's flags are added as ``heatwave_flag_next`` and
    ``extreme_rainfall_next`` (NULL on an entity's last row). ``drop_unlagged`` drops rows on
    which every lag is NULL.
    """
    stages, back, ahead = window_stages(df, hot, severe, days, lags, windows, include_current, targets)
    out = _labelled(df, stages, back, ahead, q, method, entity, time, unit, gust_col)
    return finished(out, df, lags, drop_unlagged, time, tz)


def window_stages(df: DataFrame, hot: float = HOT, severe: float = SEVERE_HOT, days: int = HOT_DAYS,
                  lags: Sequence[int] = LAGS, windows: Sequence[int] = ROLL_WINDOWS,
                  include_current: bool = False,
                  targets: bool = False) -> tuple[list[Stage], int, int]:
    """The window columns of the feature table, and how many rows they reach back and ahead."""
    lag_cols = [c for c in LAG_COLUMNS if c in df.columns]
    roll_cols = [c for c in ROLL_COLUMNS if c in df.columns]

    def features(w: WindowSpec) -> dict[str, Column]:
        return {**heatwave_columns(w, hot, severe, days), **lag_columns(w, lag_cols, lags),
                **rolling_columns(w, roll_cols, windows, include_current)}

    def following(w: WindowSpec) -> dict[str, Column]:
        return {"heatwave_flag_next": F.lead("heatwave_flag").over(w),
                "_rain_next": F.lead("precipitation").over(w)}

    stages = [features, following] if targets else [features]
    return stages, max([*lags, *windows, days - 1]), 1 if targets else 0


def finished(out: DataFrame, df: DataFrame, lags: Sequence[int] = LAGS, drop_unlagged: bool = True,
             time: str = "time", tz: str = "UTC") -> DataFrame:
    """The season columns added, and rows without any lag dropped if so wanted."""
    lag_cols = [c for c in LAG_COLUMNS if c in df.columns]
    out = seasonal_features(out, time, tz)
    if not (drop_unlagged and lag_cols):
        return out
    return drop_all_null(out, [f"{c}_lag_{k}" for c in lag_cols for k in lags])


def run_etl(spark: SparkSession, raw_path: str | list[str], output_path: str,
            output_format: str = "parquet") -> DataFrame:
    """Raw station files to the partitioned feature table; returns the event totals of it."""
    raw, _ = read_station_csv(spark, raw_path)
    # The text is parsed once; brackets, counts and rows read the written table.
    table = weather_features(materialize(with_short_names(raw), "parsed"))
    if output_format == "parquet":
        write_partitioned(table, output_path)
        written = spark.read.parquet(output_path)
    elif output_format == "csv":
        write_csv(table, output_path)
        written = spark.read.schema(table.schema).csv(output_path, header=True)
    else:
        raise ValueError(f"unknown output format {output_format!r}")
    return event_summary(written)


def with_copies(raw: DataFrame) -> DataFrame:
    """Short-named numeric copies next to the source columns, which are kept."""
    rain = "precipitation_sum" if "precipitation_sum" in raw.columns else "precip"
    temperatures = {old: SHORT_NAMES[old] for old in SHORT_NAMES if old.startswith("temperature")}
    copied = coerce_numeric(normalise_nulls(raw), temperatures)
    return coerce_numeric(copied, {rain: "precipitation"}, absent=0.0)


def preprocess_all(spark: SparkSession, weather_path: str | None = None,
                   cyclone_path: str | None = None, output_dir: str | None = None
                   ) -> tuple[DataFrame | None, DataFrame | None]:
    """Processed weather and cyclone frames, also written as CSV if a folder is given.

    Unlike the ETL table this keeps the source columns and every row.
    """
    weather = cyclones = None
    if weather_path is not None:
        raw = with_copies(read_station_csv(spark, weather_path)[0])
        weather = weather_features(raw, drop_unlagged=False, gust_col="wind_gusts_10m_max")
    if cyclone_path is not None:
        cyclones = prepare_tracks(read_tracks_csv(spark, cyclone_path))
    if output_dir is not None:
        for name, frame in (("weather_processed", weather), ("cyclones_processed", cyclones)):
            if frame is not None:
                write_csv(frame, f"{output_dir}/{name}")
    return weather, cyclones
