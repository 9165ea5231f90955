"""Aggregates behind the exploratory reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.operators.panel import trailing_full_mean

EVENT_FLAGS = {
    "heatwave_days": "heatwave_flag",
    "severe_heatwave_days": "severe_heatwave_flag",
    "extreme_rain_days": "extreme_rainfall",
    "cyclonic_days": "cyclonic_flag",
}


def _total(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def event_summary(df: DataFrame) -> DataFrame:
    """Totals of the four event flags, one row."""
    return df.agg(*[_total(c).alias(name) for name, c in EVENT_FLAGS.items()])


def events_by(df: DataFrame, key: str | Column) -> DataFrame:
    """Heatwave and extreme-rain days per zone, month, city or any other key."""
    return df.groupBy(key).agg(_total("heatwave_flag").alias("heatwaves"),
                               _total("extreme_rainfall").alias("extreme_rainfall"))


def distinct_entities(df: DataFrame, entity: str = "city") -> DataFrame:
    return df.select(entity).distinct()


def coverage(df: DataFrame, entity: str = "city") -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))


def coverage_rollup(df: DataFrame, entity: str = "city") -> DataFrame:
    """Rows per entity and, with a NULL entity, in total."""
    return df.rollup(entity).agg(F.count(F.lit(1)).alias("n_rows"))


def monthly_trend(df: DataFrame, col: str, entity: str = "city", time: str = "time",
                  periods: int = 12) -> DataFrame:
    """Monthly mean per entity and its trailing mean over ``periods`` full months."""
    monthly = df.groupBy(entity, F.trunc(time, "month").alias("month")).agg(
        F.avg(col).alias("monthly_mean"))
    return trailing_full_mean(monthly, "monthly_mean", "annual_mean", periods, entity, "month")


def leakage_corr(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with the target as ``(feature, correlation)`` rows."""
    pairs = df.agg(*[F.corr(c, target).alias(c) for c in features])
    stacked = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation"))
                        for c in features])
    return pairs.select(F.inline(stacked))


def mean_by_class(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.avg(col).alias(f"mean_{col}"), F.count(col).alias("n"))
