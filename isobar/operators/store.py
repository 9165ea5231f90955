"""Keyed merge and resume planning over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.schemas import OBSERVATION_KEY


def batch_number(col: str = "batch_id") -> Column:
    """The number at the end of a batch id, so that batch 10 follows batch 9."""
    return F.regexp_extract(F.col(col).cast("string"), "([0-9]+)$", 1).try_cast("long")


def newest_batch() -> list[Column]:
    """Rows by time of ingest, then by number of the batch."""
    return [F.col("ingested_at"), batch_number()]


def latest_per_key(df: DataFrame, keys: Sequence[str],
                   order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` values of each key; a hash of the row decides ties.

    An aggregate rather than a ranked window: copies of a key are reduced before the shuffle, so
    a key with very many copies costs one row per input task.
    """
    rest = [c for c in df.columns if c not in keys]
    places = [F.col(o) if isinstance(o, str) else o for o in order]
    newest = F.max_by(F.struct(*rest), F.struct(*places, F.xxhash64(*rest))).alias("_row")
    merged = df.groupBy(*keys).agg(newest)
    return merged.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c)
                           for c in df.columns])


def upsert_latest(existing: DataFrame, incoming: DataFrame,
                  keys: Sequence[str] = OBSERVATION_KEY,
                  order: Sequence[str | Column] | None = None) -> DataFrame:
    """Merge by key, the latest ingested row wins; repeating a merge changes nothing."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    return latest_per_key(both, keys, newest_batch() if order is None else order)


def new_rows(incoming: DataFrame, existing: DataFrame,
             keys: Sequence[str] = OBSERVATION_KEY) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def plan_ranges(dimension: DataFrame, stored: DataFrame, start: str, end: str,
                force: bool = False, entity: str = "city", time: str = "time") -> DataFrame:
    """The date range still to fetch for each entity of the dimension.

    ``action`` is ``full`` where nothing is stored or everything is wanted again, ``resume`` from
    the day after the last stored one, or ``skip`` (without a range) when that is past ``end``.
    """
    latest = stored.groupBy(entity).agg(F.max(F.to_date(time)).alias("_last"))
    known = dimension.select(entity).join(latest, entity, "left")
    fresh = F.lit(force) | F.col("_last").isNull()
    following = F.date_add("_last", 1)
    first, final = F.lit(start).cast("date"), F.lit(end).cast("date")
    begin = F.when(fresh, first).otherwise(following)
    needed = begin <= final
    action = F.when(~needed, "skip").when(fresh, "full").otherwise("resume")
    return known.select(entity, action.alias("action"),
                        F.when(needed, begin).alias("fetch_start"),
                        F.when(needed, final).alias("fetch_end"))


def batch_states(ledger: DataFrame) -> DataFrame:
    """Latest recorded state of every batch."""
    return latest_per_key(ledger, ["id"], ["recorded_at"]).drop("recorded_at")
