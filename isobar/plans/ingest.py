"""Incremental ingest: landed files into a keyed table, with a batch ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.columns import normalise_nulls
from isobar.operators.store import batch_states, latest_per_key, newest_batch, upsert_latest
from isobar.schemas import BATCHES, OBSERVATION_KEY, OBSERVATIONS
from isobar.session import materialize
from isobar.sources.files import read_station_csv, union_by_name
from isobar.sources.sinks import append, overwrite_touched, path_exists

# Fixed value: stored length of an error text.
STORED_ERROR = 500
YEAR = "_year"
# Up to this number of touched partitions are named in the filter of the stored table.
NAMED_PARTITIONS = 10_000


def as_observations(raw: DataFrame, batch_id: str, ingested_at: Column) -> DataFrame:
    """Rows of the fact table: known columns only, NaN as NULL, stamped with the batch."""
    stamped = normalise_nulls(raw).withColumns({
        "batch_id": F.lit(str(batch_id)), "ingested_at": ingested_at})
    absent = {f.name: F.lit(None).cast(f.dataType) for f in OBSERVATIONS.fields
              if f.name not in stamped.columns}
    return stamped.withColumns(absent).select(*OBSERVATIONS.names)


def split_keyed(rows: DataFrame, keys: Sequence[str] = OBSERVATION_KEY
                ) -> tuple[DataFrame, DataFrame]:
    """Rows with a complete key, and the others."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    return rows.where(complete), rows.where(~complete)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(YEAR)


def upsert_into(spark: SparkSession, path: str, incoming: DataFrame,
                keys: Sequence[str] = OBSERVATION_KEY, order: Sequence[str | Column] | None = None,
                entity: str = "city", time: str = "time") -> int:
    """Merge ``incoming`` into the Parquet table at ``path``; returns its number of keys.

    The table is partitioned by (entity, year) and only the partitions that receive rows are
    replaced. Their entities and years are few and named in the filter, so that only these
    partitions are read; beyond ``NAMED_PARTITIONS`` the join alone selects them. The merged partitions are written to the shared folder before they replace the
    stored ones, so the table never depends on its own files, and a rerun gives the same table.
    """
    order = newest_batch() if order is None else order
    fresh = latest_per_key(incoming, keys, order).withColumn(YEAR, F.year(time))
    fresh = materialize(fresh, "incoming")
    merged = fresh
    if path_exists(spark, path):
        touched = fresh.select(entity, YEAR).distinct()
        stored = stored_partitions(spark.read.schema(fresh.schema).parquet(path), touched, entity)
        affected = stored.join(touched, [entity, YEAR], "left_semi").select(*fresh.columns)
        merged = materialize(upsert_latest(affected, fresh, keys, order), "merged")
    spread = merged.repartition(entity, YEAR).sortWithinPartitions(entity, YEAR, time)
    overwrite_touched(spread, path, [entity, YEAR])
    return fresh.count()


def stored_partitions(stored: DataFrame, touched: DataFrame, entity: str = "city") -> DataFrame:
    """The stored rows of the touched entities and years, as a filter on the partitions."""
    named = touched.limit(NAMED_PARTITIONS + 1).collect()
    if len(named) > NAMED_PARTITIONS:
        return stored
    entities, years = ({r[c] for r in named} for c in (entity, YEAR))
    return stored.where(F.col(entity).isin(sorted(entities)) & F.col(YEAR).isin(sorted(years)))


def _record(spark: SparkSession, ledger: str, batch_id: int, started_at: str, recorded_at: str,
            status: str, cities: int = 0, rows: int = 0, error: str | None = None) -> None:
    done = None if status == "running" else recorded_at
    state = spark.createDataFrame(
        [(batch_id, started_at, done, cities, rows, status, error and error[:STORED_ERROR],
          recorded_at)],
        "id long, started_at string, completed_at string, cities_count int, rows_ingested long, "
        "status string, error_message string, recorded_at string")
    append(state.select(*[F.col(f.name).cast(f.dataType) for f in BATCHES.fields]), ledger)


def _landed(spark: SparkSession, landed: str | Mapping[str, str], batch_id: int,
            ingested_at: Column) -> tuple[DataFrame, dict[str, str]]:
    """The written rows of a batch, and the error of each city whose files cannot be read."""
    frames, errors = [], {}
    for city, path in ({"": landed} if isinstance(landed, str) else landed).items():
        try:
            raw, _ = read_station_csv(spark, path)
            frames.append(materialize(as_observations(raw, str(batch_id), ingested_at), "landed"))
        except Exception as exc:
            if not city:
                raise
            errors[city] = str(exc)
    if not frames:
        raise RuntimeError("no city could be read: " + "; ".join(sorted(errors)))
    return union_by_name(frames), errors


def run_batch(spark: SparkSession, landed: str | Mapping[str, str], table: str, ledger: str,
              quarantine: str, batch_id: int, started_at: str, finished_at: str) -> DataFrame:
    """Ingest the landed CSV files as one batch; returns the rows per city and status.

    ``landed`` is one path for all files, or a path per city: then a city whose files cannot be
    read does not stop the others. It has a row ``failed`` in the result and is named in the ledger.

    The batch is always closed: ``completed`` with its number of rows, also when that is zero, or
    ``failed`` with the error. Rows without a complete key go to the quarantine table, in the
    partition of their batch, which a repeated run replaces; they do not hold up the others.
    """
    _record(spark, ledger, batch_id, started_at, started_at, "running")
    try:
        stamped, errors = _landed(spark, landed, batch_id, F.lit(finished_at).cast("timestamp"))
        good, bad = split_keyed(stamped)
        overwrite_touched(bad, quarantine, ["batch_id"])
        rows = upsert_into(spark, table, good)
        cities = good.agg(F.count_distinct("city").alias("n")).first()["n"]
        _record(spark, ledger, batch_id, started_at, finished_at, "completed", cities, rows,
                f"failed: {', '.join(sorted(errors))}" if errors else None)
    except Exception as exc:
        _record(spark, ledger, batch_id, started_at, finished_at, "failed", error=str(exc))
        raise
    status = F.when(F.col("city").isNull() | F.col("time").isNull(), "quarantined")
    counted = stamped.groupBy("city", status.otherwise("ingested").alias("status")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    failed = [(city, "failed", 0) for city in sorted(errors)]
    return counted.unionAll(spark.createDataFrame(failed, counted.schema))


def ledger_states(spark: SparkSession, ledger: str) -> DataFrame:
    return batch_states(spark.read.schema(BATCHES).parquet(ledger))
