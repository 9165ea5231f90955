"""Null handling, coercion, column choice and calendar parts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)


def null_if_nan(col: Column) -> Column:
    """NaN compares as larger than any number in Spark, so it is turned into NULL early."""
    return F.when(~F.isnan(col), col)


def normalise_nulls(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in floats})


def to_number(col: Column) -> Column:
    """Double, or NULL where the value is not a number."""
    return null_if_nan(col.try_cast("double"))


def to_time(col: Column) -> Column:
    """Timestamp, or NULL where the text is not a date."""
    return col.try_cast("timestamp")


def coerce_numeric(df: DataFrame, mapping: Mapping[str, str],
                   absent: float | None = None) -> DataFrame:
    """Copy source columns into numeric targets; a source the frame lacks gives ``absent``."""
    missing = F.lit(absent).cast("double")
    return df.withColumns({
        target: to_number(F.col(source)) if source in df.columns else missing
        for source, target in mapping.items()})


def first_present(df: DataFrame, candidates: Sequence[str], per_row: bool = False) -> Column | None:
    """The first candidate the frame has, or per row the first one that is not NULL.

    Names are compared without case, as Spark resolves them.
    """
    have = {c.lower() for c in df.columns}
    present = [c for c in candidates if c.lower() in have]
    if not present:
        return None
    return F.coalesce(*[F.col(c) for c in present]) if per_row else F.col(present[0])


def project_available(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns the frame has, and the names it lacks."""
    missing = [c for c in wanted if c not in df.columns]
    return df.select(*[c for c in wanted if c in df.columns]), missing


def rename_present(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows in which every one of the columns is NULL."""
    return df.na.drop(how="all", subset=list(cols))


def local_time(col: Column, tz: str = "UTC") -> Column:
    return col if tz == "UTC" else F.from_utc_timestamp(col, tz)


def date_parts(col: Column) -> dict[str, Column]:
    return {"year": F.year(col), "month": F.month(col), "day": F.day(col),
            "dayofyear": F.dayofyear(col)}


def seasonal_features(df: DataFrame, time: str = "time", tz: str = "UTC") -> DataFrame:
    """Month, day of year and the month as a point on the yearly circle."""
    when = local_time(to_time(F.col(time)), tz)
    angle = F.month(when) * F.lit(2 * math.pi / 12)
    return df.withColumns({"month": F.month(when), "dayofyear": F.dayofyear(when),
                           "month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def year_chunks(df: DataFrame, start: str, end: str) -> DataFrame:
    """Split each ``[start, end]`` date range at year ends into ``chunk_start, chunk_end`` rows.

    A one-day range gives one chunk and an end on 1 January is kept; an inverted range gives none.
    """
    years = F.sequence(F.year(start), F.year(end))
    valid = df.where(F.col(start) <= F.col(end)).withColumn("_year", F.explode(years))
    return valid.withColumns({
        "chunk_start": F.greatest(F.col(start), F.make_date("_year", F.lit(1), F.lit(1))),
        "chunk_end": F.least(F.col(end), F.make_date("_year", F.lit(12), F.lit(31))),
    }).drop("_year")


def date_grid(df: DataFrame, start: str, end: str, out: str = "time", days: int = 1) -> DataFrame:
    """One row per step in the half-open range ``[start, end)`` of each input row."""
    steps = F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr(f"interval {days} day"))
    return df.where(F.col(start) < F.col(end)).withColumn(out, F.explode(steps))
