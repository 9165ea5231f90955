"""Ordered windows over long series, split so that no task holds a whole entity.

A window partitioned by the entity alone sends every row of one entity to one task, so a station
with a third of all rows stalls the job. Here a series is cut into calendar chunks and windows run
per ``(entity, chunk)``; whatever crosses a chunk border is carried explicitly:

* bounded frames (lags, rolling statistics, next-day targets) get the last ``back`` rows before the
  chunk and the first ``ahead`` rows after it as extra, marked rows (:func:`over_chunks`);
* running quantities are summarised to one row per chunk and the prefix over those summaries is
  joined back (see ``panel.streak_length``).

The rows are shuffled once, by ``(entity, chunk)``; the edge rows and summaries that travel between
chunks are a few rows per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
EDGE = "_edge"

Stage = Callable[[WindowSpec], dict[str, Column]]


def with_chunk(df: DataFrame, entity: str = "city", time: str = "time",
               unit: str = "year") -> DataFrame:
    """Add the chunk column and spread the rows by ``(entity, chunk)``.

    ``unit`` is any ``date_trunc`` unit. With one row per entity and day a year holds at most 366
    rows; use ``month`` or ``day`` for finer series.
    """
    return (df.withColumn(CHUNK, F.date_trunc(unit, F.col(time)))
              .repartition(entity, CHUNK))


def chunk_window(entity: str = "city", time: str = "time") -> WindowSpec:
    return Window.partitionBy(entity, CHUNK).orderBy(time)


def _edge_rows(chunked: DataFrame, back: int, ahead: int, entity: str, time: str) -> DataFrame:
    """For each chunk, the ``back`` rows before it and the ``ahead`` rows after it."""
    rows = F.struct(time, *[c for c in chunked.columns if c not in (entity, time, CHUNK)])
    within = Window.partitionBy(entity, CHUNK)
    ranked = chunked.withColumns({
        "_rank": F.row_number().over(within.orderBy(time)),
        "_size": F.count(F.lit(1)).over(within),
    }).withColumns({
        "_tail": F.col("_rank") > F.col("_size") - back,
        "_head": F.col("_rank") <= ahead,
    })
    borders = ranked.where("_tail OR _head").groupBy(entity, CHUNK).agg(
        F.array_sort(F.collect_list(F.when(F.col("_tail"), rows))).alias("_tails"),
        F.array_sort(F.collect_list(F.when(F.col("_head"), rows))).alias("_heads"),
    )
    # One row per chunk from here on. Every chunk has at least one row, so the nearest ``back``
    # chunks are enough to find ``back`` rows even where chunks are nearly empty.
    across = Window.partitionBy(entity).orderBy(CHUNK)
    parts = []
    if back:
        before = F.reverse(F.flatten(F.collect_list("_tails").over(across.rowsBetween(-back, -1))))
        parts.append(F.slice(before, 1, back))
    if ahead:
        after = F.flatten(F.collect_list("_heads").over(across.rowsBetween(1, ahead)))
        parts.append(F.slice(after, 1, ahead))
    edges = borders.select(entity, CHUNK, F.concat(*parts).alias("_rows"))
    return edges.select(entity, CHUNK, F.inline("_rows")).repartition(entity, CHUNK)


def over_chunks(df: DataFrame, stages: Sequence[Stage], back: int = 0, ahead: int = 0,
                entity: str = "city", time: str = "time", unit: str = "year",
                keep_chunk: bool = False, reads: Sequence[str] | None = None) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows back and ``ahead`` rows on.

    Each stage maps the window spec to new columns; a later stage may use columns of an earlier
    one. ``(entity, time)`` must be unique (see ``quality.duplicate_keys``), otherwise the row
    order, and with it a lag, is undefined. ``reads`` names the columns that the stages read; border
    rows carry no others. A frame that already carries the chunk column, from
    :func:`with_chunk`, is not shuffled again.
    """
    chunked = df if CHUNK in df.columns else with_chunk(df, entity, time, unit)
    rows = chunked.withColumn(EDGE, F.lit(False))
    if back or ahead:
        carried = chunked.columns if reads is None else dict.fromkeys(
            [entity, time, CHUNK, *(c for c in reads if c in chunked.columns)])
        edges = _edge_rows(chunked.select(*carried), back, ahead, entity, time)
        rows = rows.unionByName(edges.withColumn(EDGE, F.lit(True)), allowMissingColumns=True)
    spec = chunk_window(entity, time)
    for stage in stages:
        rows = rows.withColumns(stage(spec))
    rows = rows.where(~F.col(EDGE)).drop(EDGE)
    return rows if keep_chunk else rows.drop(CHUNK)


def chunk_directory(df: DataFrame, entity: str = "city", time: str = "time",
                    unit: str = "year") -> DataFrame:
    """The distinct (entity, chunk) pairs, found map-side before anything is shuffled."""
    return df.select(entity, F.date_trunc(unit, F.col(time)).alias(CHUNK)).distinct()


def join_per_entity(chunked: DataFrame, directory: DataFrame, per_entity: DataFrame,
                    entity: str = "city") -> DataFrame:
    """Left join of a one-row-per-entity frame onto chunked rows.

    The frame is joined to the chunk directory first, so that the rows join on ``(entity, chunk)``:
    they stay where the chunk shuffle put them, and an entity's rows stay spread over its chunks.
    """
    keyed = directory.join(per_entity, entity, "left")
    return chunked.join(keyed, [entity, CHUNK], "left")
