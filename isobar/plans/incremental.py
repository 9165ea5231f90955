"""The feature table kept up to date: only chunks that new rows can change are computed again.

A store has three tables, all partitioned by station: the rows and the features by year as well, and
one summary row per (station, year) chunk. The summary holds what a chunk means to others: its
number of rows, the run of hot days that enters and leaves it, and how often each amount of rain
occurs. From the summaries alone follow the chunks that a change can reach, the rainfall thresholds of
a station and the run that a chunk inherits. So an update reads and replaces the touched chunks and
those in reach of them; whatever depends on a whole station is added when features are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.operators.chunks import CHUNK, chunk_window, over_chunks, with_chunk
from isobar.operators.labels import HOT, RAIN_QUANTILES
from isobar.operators.ranking import _interpolate
from isobar.operators.store import latest_per_key
from isobar.plans.ingest import YEAR, stored_partitions, upsert_into
from isobar.plans.weather import READS, finished, flagged, window_stages
from isobar.session import materialize
from isobar.sources.sinks import overwrite_touched, path_exists

ROWS, FEATURES, SUMMARY = "rows", "features", "summary"
RAIN = "array<struct<value:double,n:bigint>>"


def _named(table: DataFrame, chunks: DataFrame, entity: str) -> DataFrame:
    """The rows of ``table`` in ``chunks``, whose partitions the scan's filter names."""
    return stored_partitions(table, chunks, entity).join(
        F.broadcast(chunks.select(entity, YEAR)) if chunks.count() <= 10_000
        else chunks.select(entity, YEAR), [entity, YEAR], "left_semi")


def _with_runs(chunked: DataFrame, held: Column, entity: str, time: str) -> DataFrame:
    """``hot_run``, the run of rows up to each one inside its chunk, and whether it reaches back over
    the border."""
    spec = chunk_window(entity, time)
    upto = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = chunked.withColumns({"_place": F.row_number().over(spec),
                                  "_held": F.coalesce(held, F.lit(False))})
    reset = F.max(F.when(~F.col("_held"), F.col("_place"))).over(upto)
    return placed.withColumn("_reset", reset).withColumns({
        "hot_run": (F.col("_place") - F.coalesce("_reset", F.lit(0))).cast("int"),
        "_open": F.col("_reset").isNull()}).drop("_held", "_reset")


def summarise(chunked: DataFrame, hot: float, entity: str, time: str) -> DataFrame:
    """One row per chunk: ``n_rows``, ``enters`` (the hot run at its start, of all its rows if none
    ends it), ``leaves`` (the run at its end) and ``rain``, its amounts with their counts."""
    runs = _with_runs(chunked.select(entity, time, CHUNK, "temp_max"), F.col("temp_max") > hot,
                      entity, time)
    shape = runs.groupBy(entity, CHUNK).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.when(F.col("_open"), F.col("hot_run"))).alias("enters"),
        F.max_by("hot_run", "_place").alias("leaves"))
    known = F.col("precipitation").isNotNull() & ~F.isnan("precipitation")
    rain = chunked.where(known).groupBy(entity, CHUNK, F.col("precipitation").cast("double").alias(
        "value")).agg(F.count(F.lit(1)).alias("n")).groupBy(entity, CHUNK).agg(
        F.array_sort(F.collect_list(F.struct("value", "n"))).alias("rain"))
    return (shape.join(rain, [entity, CHUNK], "left")
            .withColumns({YEAR: F.year(CHUNK), "rain": F.coalesce("rain", F.array().cast(RAIN)),
                          "enters": F.coalesce("enters", F.lit(0))}).drop(CHUNK))


def reached(summary: DataFrame, touched: Column, back: int, ahead: int, entity: str) -> DataFrame:
    """The chunks that are touched, or whose rows see ``back`` rows before or ``ahead`` rows after them
    a touched one. One row per chunk is ordered per station."""
    across = Window.partitionBy(entity).orderBy(YEAR)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = summary.withColumns({"_through": F.sum("n_rows").over(upto), "_touched": touched})
    start = F.col("_through") - F.col("n_rows")
    placed = placed.withColumns({
        "_last": F.max(F.when(F.col("_touched"), F.col("_through"))).over(before),
        "_first": F.min(F.when(F.col("_touched"), start)).over(after)})
    # Rows between the chunks are fewer than the reach.
    near = ((F.col("_touched")) | (start - F.col("_last") < back)
            | (F.col("_first") - F.col("_through") < ahead))
    return placed.where(F.coalesce(near, F.lit(False))).select(entity, YEAR)


def update_features(spark: SparkSession, store: str, incoming: DataFrame, version: int,
                    hot: float = HOT, targets: bool = True, entity: str = "city",
                    time: str = "time") -> DataFrame:
    """Merge rows into the store and bring the features up to date; returns the chunks recomputed.

    Rows are keyed by (entity, time); of equal keys the one with the highest ``version`` stays, so
    late rows, corrections and repeated updates are all the same call. Rows without a complete key
    are left out. An update that is repeated after a failure gives the same store.
    """
    rows = incoming.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).withColumn(
        "_version", F.lit(version))
    rows = materialize(latest_per_key(rows, [entity, time], ["_version"]), "incoming")
    touched = materialize(rows.select(entity, F.year(time).alias(YEAR)).distinct(), "touched")
    if touched.isEmpty():
        return touched
    upsert_into(spark, f"{store}/{ROWS}", rows, [entity, time], ["_version"], entity, time)
    stored = spark.read.parquet(f"{store}/{ROWS}")

    fresh = with_chunk(_named(stored, touched, entity).drop(YEAR, "_version"), entity, time)
    summary = summarise(materialize(fresh, "touched-rows"), hot, entity, time)
    if path_exists(spark, f"{store}/{SUMMARY}"):
        entities = touched.select(entity).distinct()
        known = spark.read.parquet(f"{store}/{SUMMARY}").join(entities, entity, "left_semi")
        summary = known.join(touched, [entity, YEAR], "left_anti").unionByName(summary)
    summary = materialize(summary, "summary")

    stages, back, ahead = window_stages(stored, hot=hot, targets=targets)
    marked = summary.join(touched.withColumn("_hit", F.lit(True)), [entity, YEAR], "left")
    again = materialize(reached(marked, F.col("_hit").isNotNull(), back, ahead, entity), "again")
    marked = summary.join(again.withColumn("_hit", F.lit(True)), [entity, YEAR], "left")
    # What they see themselves: the same reach the other way round.
    needed = materialize(reached(marked, F.col("_hit").isNotNull(), ahead, back, entity), "needed")

    chunked = with_chunk(_named(stored, needed, entity).drop(YEAR, "_version"), entity, time)
    wide = over_chunks(chunked, stages, back=back, ahead=ahead, entity=entity, time=time,
                       keep_chunk=True, reads=READS)
    wide = _with_runs(wide, F.col("temp_max") > hot, entity, time).drop("_place").withColumn(
        YEAR, F.year(CHUNK)).drop(CHUNK)
    wide = materialize(wide.join(again, [entity, YEAR], "left_semi"), "features")
    overwrite_touched(wide.repartition(entity, YEAR), f"{store}/{FEATURES}", [entity, YEAR])
    overwrite_touched(summary.repartition(entity), f"{store}/{SUMMARY}", [entity])
    return again


def thresholds(summary: DataFrame, q: tuple[float, float] = RAIN_QUANTILES,
               entity: str = "city") -> DataFrame:
    """The exact rainfall quantiles per station, from the counted amounts of its chunks."""
    counted = summary.select(entity, F.inline("rain")).groupBy(entity, "value").agg(
        F.sum("n").alias("_count"))
    sizes = counted.groupBy(entity).agg(F.sum("_count").alias("_n"))
    counted = counted.join(sizes, entity).withColumns({
        "_slice": F.lit(0), "_at": F.col("value"), "_gap": F.lit(False)})
    return _interpolate(counted, [entity], {"rain_q_low": q[0], "rain_q_high": q[1]})


def inherited_runs(summary: DataFrame, entity: str = "city") -> DataFrame:
    """``carry`` per chunk: the hot run that reaches it from the chunks before.

    A chunk that is hot throughout adds its rows to the run it inherits; any other starts anew.
    """
    across = Window.partitionBy(entity).orderBy(YEAR)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    through = F.col("enters") == F.col("n_rows")
    placed = summary.withColumn("_total", F.sum("n_rows").over(
        across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Since the last chunk in which a run ended, all rows are hot.
    ended = F.max(F.when(~through, F.struct("_total", "leaves"))).over(before)
    placed = placed.withColumn("_ended", ended)
    behind = F.col("_total") - F.col("n_rows")
    return placed.select(entity, YEAR, F.when(
        F.col("_ended").isNotNull(), behind - F.col("_ended._total") + F.col("_ended.leaves"))
        .otherwise(behind).cast("int").alias("carry"))


def read_features(spark: SparkSession, store: str, q: tuple[float, float] = RAIN_QUANTILES,
                  drop_unlagged: bool = True, entity: str = "city", time: str = "time",
                  tz: str = "UTC", gust_col: str = "wind_gust_max") -> DataFrame:
    """The feature table of the store, as the full job would make it, with ``hot_streak``."""
    summary = spark.read.parquet(f"{store}/{SUMMARY}")
    base = spark.read.parquet(f"{store}/{FEATURES}")
    joined = base.join(thresholds(summary, q, entity), entity, "left").join(
        inherited_runs(summary, entity), [entity, YEAR], "left")
    streak = F.col("hot_run") + F.when(F.col("_open"), F.col("carry")).otherwise(0)
    out = flagged(joined.withColumn("hot_streak", streak), base, gust_col)
    return finished(out, base, drop_unlagged=drop_unlagged, time=time, tz=tz).drop(
        "hot_run", "_open", "carry", YEAR)
