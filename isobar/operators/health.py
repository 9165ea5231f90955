"""Coverage, freshness and batch status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.operators.chunks import over_chunks

# Days after which a station is aging or stale; shown length of an error.
AGING_DAYS, STALE_DAYS = 2, 7
SHOWN_ERROR = 200


def extent(df: DataFrame, entity: str = "city", time: str = "time") -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.min(time).alias("earliest"), F.max(time).alias("latest"))


def freshness_status(latest: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, latest)
    return (F.when(latest.isNull(), "empty").when(age > STALE_DAYS, "stale")
            .when(age > AGING_DAYS, "aging").otherwise("OK"))


def freshness(df: DataFrame, as_of: Column, entity: str = "city", time: str = "time",
              dimension: DataFrame | None = None) -> DataFrame:
    """Extent, age in days and status per entity; with a dimension also entities without rows."""
    seen = extent(df, entity, time)
    if dimension is not None:
        seen = dimension.select(entity).join(seen, entity, "left").fillna(0, ["n_rows"])
    return seen.withColumns({"days_old": F.datediff(as_of, F.col("latest")),
                             "status": freshness_status(F.col("latest"), as_of)})


def gaps(df: DataFrame, entity: str = "city", time: str = "time",
         unit: str = "year") -> DataFrame:
    """Runs of missing days between two rows of an entity."""
    days = df.select(entity, F.to_date(time).alias(time))
    nexts = over_chunks(days, [lambda w: {"next_time": F.lead(time).over(w)}], ahead=1,
                        entity=entity, time=time, unit=unit, reads=[])
    missing = F.datediff("next_time", time) - 1
    return nexts.where(missing > 0).select(
        entity, F.date_add(time, 1).alias("gap_start"),
        F.date_sub("next_time", 1).alias("gap_end"), missing.alias("missing_days"))


def count_since(df: DataFrame, time: str, since: Column, entity: str = "city") -> DataFrame:
    """Total rows, rows at or after ``since`` and number of entities."""
    recent = F.coalesce(F.sum((F.col(time) >= since).cast("long")), F.lit(0))
    per_entity = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), recent.alias("_recent"))
    return per_entity.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("_recent"), F.lit(0)).alias("recent_rows"),
        F.count(entity).alias("n_entities"))


def latest_batches(states: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` batches started last, with run time and a shortened error text."""
    minutes = (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")) / 60
    return (states.orderBy(F.desc("started_at"), F.desc("id")).limit(k)
            .select("id", "started_at", "completed_at", "status", "rows_ingested",
                    F.round(minutes, 1).alias("minutes"),
                    F.substring("error_message", 1, SHOWN_ERROR).alias("error_message")))


def stale_batches(states: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Batches still marked running long after they started."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("started_at")) / 3600
    return states.where((F.col("status") == "running") & (age > hours))
