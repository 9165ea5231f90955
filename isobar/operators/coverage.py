"""Which days are stored per entity, as intervals: found once, merged on ingest, asked for holes.

An interval is a run of days without a gap. Their number grows with the gaps, not with the rows, so a
plan of what to fetch reads the intervals instead of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.operators.panel import over_chunks


def intervals(df: DataFrame, entity: str = "city", time: str = "time",
              unit: str = "year") -> DataFrame:
    """``entity, first_day, last_day`` of every run of days in ``df``; rows without a key count not.

    Runs are found inside calendar chunks, so no task holds a whole entity, and joined over their
    borders like those of two batches.
    """
    days = (df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
            .select(entity, F.to_date(time).alias("_day")).distinct())

    def marks(spec) -> dict[str, Column]:
        # Days less their number in the chunk are equal along a run.
        return {"_run": F.date_sub("_day", F.row_number().over(spec))}

    runs = over_chunks(days, [marks], entity=entity, time="_day", unit=unit, reads=[],
                       keep_chunk=True)
    inside = runs.groupBy(entity, "_chunk", "_run").agg(F.min("_day").alias("first_day"),
                                                        F.max("_day").alias("last_day"))
    return merged(inside.select(entity, "first_day", "last_day"), entity)


def merged(found: DataFrame, entity: str = "city") -> DataFrame:
    """Intervals that overlap or touch joined into one; orders the intervals of an entity."""
    earlier = Window.partitionBy(entity).orderBy("first_day", "last_day").rowsBetween(
        Window.unboundedPreceding, -1)
    upto = Window.partitionBy(entity).orderBy("first_day", "last_day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    reach = F.max("last_day").over(earlier)
    fresh = F.coalesce(F.col("first_day") > F.date_add(reach, 1), F.lit(True))
    return (found.withColumn("_new", fresh.cast("int"))
            .withColumn("_no", F.sum("_new").over(upto))
            .groupBy(entity, "_no").agg(F.min("first_day").alias("first_day"),
                                        F.max("last_day").alias("last_day")).drop("_no"))


def extended(stored: DataFrame, rows: DataFrame, entity: str = "city",
             time: str = "time") -> DataFrame:
    """The stored intervals after ``rows`` were ingested: the table itself is not read."""
    return merged(stored.select(entity, "first_day", "last_day").unionByName(
        intervals(rows, entity, time)), entity)


def holes(dimension: DataFrame, stored: DataFrame, start: Column, end: Column,
          entity: str = "city", skip: Sequence[str] = ()) -> DataFrame:
    """``entity, fetch_start, fetch_end, n_days``: every run of days from ``start`` to ``end``, both
    included, that is not stored; an entity of the dimension without intervals has one.

    Entities in ``skip`` are left alone.
    """
    wanted = dimension.select(entity).distinct().where(~F.col(entity).isin(list(skip)) if skip
                                                       else F.lit(True))
    first, last = start.cast("date"), end.cast("date")
    # Two intervals beyond both ends bound the holes.
    outside = wanted.select(entity, F.inline(F.array(*[
        F.struct(d.alias("first_day"), d.alias("last_day"))
        for d in (F.date_sub(first, 1), F.date_add(last, 1))])))
    inside = stored.join(wanted, entity, "left_semi").select(
        entity, F.greatest("first_day", F.date_sub(first, 1)).alias("first_day"),
        F.least("last_day", F.date_add(last, 1)).alias("last_day")).where("first_day <= last_day")
    ends = merged(inside.unionByName(outside), entity)
    following = F.lead("first_day").over(Window.partitionBy(entity).orderBy("first_day"))
    return ends.withColumn("_next", following).where("_next IS NOT NULL").select(
        entity, F.date_add("last_day", 1).alias("fetch_start"),
        F.date_sub("_next", 1).alias("fetch_end"),
        (F.datediff("_next", "last_day") - 1).cast("long").alias("n_days"))
