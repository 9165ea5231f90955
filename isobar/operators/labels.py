"""Event labels of daily station weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from isobar.functions.columns import to_number
from isobar.functions.events import flag
from isobar.operators.chunks import over_chunks
from isobar.operators.panel import consecutive
from isobar.operators.ranking import group_quantiles

# Event thresholds.
HOT, SEVERE_HOT, HOT_DAYS = 40.0, 45.0, 3
RAIN_QUANTILES = (0.95, 0.99)
RAIN_FALLBACK = (50.0, 100.0)
GUST, PRESSURE = 60.0, 1005.0
GUST_FILL, PRESSURE_FILL = 0.0, 1013.0


def heatwave_columns(spec: WindowSpec, hot: float = HOT, severe: float = SEVERE_HOT,
                     days: int = HOT_DAYS, col: str = "temp_max") -> dict[str, Column]:
    return {"heatwave_flag": consecutive(spec, F.col(col) > hot, days),
            "severe_heatwave_flag": consecutive(spec, F.col(col) > severe, days)}


def label_heatwave(df: DataFrame, hot: float = HOT, severe: float = SEVERE_HOT,
                   days: int = HOT_DAYS, entity: str = "city", time: str = "time",
                   unit: str = "year") -> DataFrame:
    """Flags set from the ``days``-th consecutive row above the (strict) thresholds."""
    return over_chunks(df, [lambda w: heatwave_columns(w, hot, severe, days)], back=days - 1,
                       entity=entity, time=time, unit=unit, reads=["temp_max"])


def rain_thresholds(df: DataFrame, q: tuple[float, float] = RAIN_QUANTILES,
                    method: str = "exact", entity: str = "city", time: str = "time") -> DataFrame:
    """Two precipitation quantiles per entity."""
    return group_quantiles(df, "precipitation", {"rain_q_low": q[0], "rain_q_high": q[1]},
                           by=[entity], spread=[time], method=method)


def rain_flag(col: Column, high: bool) -> Column:
    threshold = F.col("rain_q_high" if high else "rain_q_low")
    return flag(col > F.coalesce(threshold, F.lit(RAIN_FALLBACK[1 if high else 0])))


def label_rainfall(df: DataFrame, q: tuple[float, float] = RAIN_QUANTILES,
                   method: str = "exact", entity: str = "city", time: str = "time",
                   fit_on: DataFrame | None = None) -> DataFrame:
    """Flags for rain above the entity's own quantiles.

    Quantiles come from ``fit_on`` if given, for instance the training part; an entity without any
    has the fixed thresholds.
    """
    thresholds = rain_thresholds(df if fit_on is None else fit_on, q, method, entity, time)
    joined = df.join(thresholds, [entity], "left")
    rain = F.col("precipitation")
    return joined.withColumns({
        "extreme_rainfall": rain_flag(rain, high=False),
        "heavy_rainfall": rain_flag(rain, high=True),
    }).drop("rain_q_low", "rain_q_high")


def cyclonic_flag(df: DataFrame, gust: float = GUST, pressure: float = PRESSURE,
                  gust_col: str = "wind_gust_max",
                  pressure_col: str = "pressure_msl_mean") -> Column:
    """Strong gusts with low pressure; 0 where the frame lacks either column."""
    if gust_col not in df.columns or pressure_col not in df.columns:
        return F.lit(0)
    blowing = F.coalesce(to_number(F.col(gust_col)), F.lit(GUST_FILL)) > gust
    low = F.coalesce(to_number(F.col(pressure_col)), F.lit(PRESSURE_FILL)) < pressure
    return flag(blowing & low)


def label_cyclonic(df: DataFrame, gust: float = GUST, pressure: float = PRESSURE,
                   gust_col: str = "wind_gust_max",
                   pressure_col: str = "pressure_msl_mean") -> DataFrame:
    return df.withColumn("cyclonic_flag",
                         cyclonic_flag(df, gust, pressure, gust_col, pressure_col))
