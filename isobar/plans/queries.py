"""The registered queries: every operator over the whole given tables.

Computed doubles are rounded so that results do not depend on the order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions import columns as C
from isobar.functions import events as E
from isobar.operators import coverage, cyclone, dimension, drift, explore, health, labels, matrices
from isobar.operators import metrics, panel, quality, ranking, store, weights
from isobar.plans import boosted, incremental, ingest, scoring, training, views, weather
from isobar.plans.views import batch_ledger, dim_station, prediction_log, table, track_points
from isobar.schemas import (CYCLONE_FEATURES, CYCLONE_RULES, HEATWAVE_FEATURES, LAG_COLUMNS,
                            RAINFALL_FEATURES, ROLL_COLUMNS)
from isobar.session import materialize, new_path, tune
from isobar.sources import archives, files, paged, sinks
from isobar.streaming.drift import stream_drift
from isobar.streaming.landing import stream_landed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def panel_once(spark: SparkSession, sf: str) -> DataFrame:
    """The station panel as a written table, for plans that read it several times."""
    return materialize(views.station_daily(spark, sf), "station-daily")


station_daily = views.station_daily
ROLLED = [f"{c}_roll_{s}_{w}" for w in (3, 7) for c in ROLL_COLUMNS for s in ("mean", "std")]
LAGGED = [f"{c}_lag_{k}" for c in LAG_COLUMNS for k in (1, 3, 7)]
SEASON = ["month_sin", "month_cos"]

# Source names of the panel's columns, as raw files carry them.
RAW_NAMES = {
    "temp_max": "temperature_2m_max", "temp_min": "temperature_2m_min",
    "temp_mean": "temperature_2m_mean", "precipitation": "precipitation_sum",
    "wind_gust_max": "wind_gusts_10m_max",
}


def raw_station(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RAW_NAMES)


# ---------------------------------------------------------------- labels and event aggregates

@query
def events_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    return explore.events_by(weather.label_events(panel_once(spark, sf)), "zone")


@query
def events_by_month(spark: SparkSession, sf: str) -> DataFrame:
    labelled = weather.label_events(panel_once(spark, sf))
    return explore.events_by(labelled, F.month("time").alias("month"))


@query
def events_by_city(spark: SparkSession, sf: str) -> DataFrame:
    return (explore.events_by(weather.label_events(panel_once(spark, sf)), "city")
            .orderBy(F.desc("heatwaves"), "city"))


@query
def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    return explore.event_summary(weather.label_events(panel_once(spark, sf)))


@query
def label_heatwave(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_heatwave(station_daily(spark, sf).select("city", "time", "temp_max"))


@query
def label_rainfall(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_rainfall(
        panel_once(spark, sf).select("city", "time", "precipitation"))


@query
def label_rainfall_default(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds learned from some stations only: the others have the fixed ones."""
    panel = panel_once(spark, sf).select("city", "time", "precipitation")
    known = panel.where(F.ascii(F.right("city", F.lit(1))) % 2 == 0)
    return labels.label_rainfall(panel, fit_on=known)


@query
def label_cyclonic(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_cyclonic(station_daily(spark, sf)).select(
        "city", "time", "wind_gust_max", "pressure_msl_mean", "cyclonic_flag")


@query
def weather_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weather.weather_features(panel_once(spark, sf)), 4, [*ROLLED, *SEASON])


@query
def weather_features_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table after the history, rows that came late, and corrections of wrong ones."""
    panel = panel_once(spark, sf)
    part = F.pmod(F.xxhash64("city", "time"), F.lit(10))
    wrong = panel.where(part == 9).withColumns({"temp_max": F.lit(99.0), "precipitation": F.lit(0.0)})
    store = new_path(spark, "feature-store")
    for no, rows in enumerate([panel.where(part < 7).unionByName(wrong), panel.where(part >= 7)]):
        incremental.update_features(spark, store, rows, version=no, targets=False)
    out = incremental.read_features(spark, store)
    return rounded(out.drop("hot_streak"), 4, [*ROLLED, *SEASON])


@query
def weather_etl_table(spark: SparkSession, sf: str) -> DataFrame:
    """Raw CSV files to the partitioned feature table, then the totals of that table."""
    landed, out = new_path(spark, "raw-csv"), new_path(spark, "features")
    sinks.write_csv(raw_station(station_daily(spark, sf)), landed)
    return weather.run_etl(spark, landed, out)


# ------------------------------------------------------------------------- panel operators

@query
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    base = station_daily(spark, sf).select("city", "time", *LAG_COLUMNS)
    return panel.lag_features(base, LAG_COLUMNS)


@query
def rolling_prior(spark: SparkSession, sf: str) -> DataFrame:
    base = station_daily(spark, sf).select("city", "time", *ROLL_COLUMNS)
    return rounded(panel.rolling_stats(base, ROLL_COLUMNS), 4, ROLLED)


@query
def rolling_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    base = station_daily(spark, sf).select("city", "time", *ROLL_COLUMNS)
    return rounded(panel.rolling_stats(base, ROLL_COLUMNS, include_current=True), 4, ROLLED)


@query
def streak_length(spark: SparkSession, sf: str) -> DataFrame:
    base = station_daily(spark, sf).select("city", "time", "temp_max")
    return panel.streak_length(base, F.col("temp_max") > labels.HOT)


@query
def streak_length_gaps(spark: SparkSession, sf: str) -> DataFrame:
    base = station_daily(spark, sf).select("city", "time", "temp_max")
    return panel.streak_length(base, F.col("temp_max") > 20.0, gap_breaks=True)


@query
def next_day_target(spark: SparkSession, sf: str) -> DataFrame:
    base = station_daily(spark, sf).select("city", "time", "temp_max")
    return panel.lead_target(base, "heatwave_flag", stages=[labels.heatwave_columns],
                             back=labels.HOT_DAYS - 1, reads=["temp_max"])


@query
def monthly_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(explore.monthly_trend(station_daily(spark, sf), "temp_max"), 6,
                   ["monthly_mean", "annual_mean"])


@query
def date_grid(spark: SparkSession, sf: str) -> DataFrame:
    spans = health.extent(station_daily(spark, sf)).select(
        "city", "earliest", F.date_add("latest", 1).alias("until"))
    return C.date_grid(spans, "earliest", "until").select("city", "time")


@query
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    return health.gaps(station_daily(spark, sf))


@query
def entity_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    found = labels.rain_thresholds(panel_once(spark, sf))
    return rounded(found, 4, ["rain_q_low", "rain_q_high"])


@query
def entity_percentiles_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the approximate quantiles keep the rank error that the sketch promises."""
    days = panel_once(spark, sf)
    found = labels.rain_thresholds(days, method="approx")
    ranked = days.join(found, "city").groupBy("city").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum((F.col("precipitation") <= F.col(c)).cast("long")).alias(c)
          for c in ("rain_q_low", "rain_q_high")])
    allowed = F.col("n_rows") / ranking.ACCURACY + 1
    return ranked.select("city", "n_rows", *[
        (F.abs(F.col(c) - q * F.col("n_rows")) <= allowed).alias(name)
        for c, q, name in zip(("rain_q_low", "rain_q_high"), labels.RAIN_QUANTILES,
                              ("low_within", "high_within"))])


# ----------------------------------------------------------------------- scans and sinks

@query
def scan_station_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The panel written by city, then one station read through partition pruning."""
    path = new_path(spark, "by-city")
    sinks.write_partitioned(station_daily(spark, sf), path)
    return spark.read.parquet(path).where(F.col("city") == "NATION_7").select(
        "city", "time", "temp_max", "precipitation")


@query
def scan_station_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two column orders, read back by name."""
    days = raw_station(panel_once(spark, sf))
    early = F.col("time") < F.lit("1996-01-01").cast("date")
    paths = [new_path(spark, "station-csv") for _ in range(2)]
    sinks.write_csv(days.where(early), paths[0])
    sinks.write_csv(days.where(~early).select(*days.columns[::-1]), paths[1])
    named = weather.with_short_names(files.read_station_csv(spark, paths)[0])
    return named.select("city", F.to_date("time").alias("time"), "temp_max", "temp_min",
                        "precipitation", "wind_gust_max", "pressure_msl_mean")


def track_text(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks as the text columns of their archive, with its line of units."""
    names = {"ISO_TIME": F.date_format("iso_time", "yyyy-MM-dd HH:mm:ss"), "NATURE": "nature",
             "LAT": "lat", "LON": "lon", "WMO_WIND": "wmo_wind", "WMO_PRES": "wmo_pres",
             "USA_WIND": "usa_wind", "DIST2LAND": "dist2land"}
    text = track_points(spark, sf).select(*[
        (F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for n, c in names.items()])
    units = spark.createDataFrame([("", "TS", "degrees_north", "degrees_east", "kts", "mb", "kts",
                                    "km")], text.schema)
    return text.unionByName(units)


def cleaned_tracks(text: DataFrame) -> DataFrame:
    clean = cyclone.prepare_tracks(text, dated_only=True)
    return clean.select("year", "month", "day", "dayofyear", "wind_kts", "category",
                        "pressure_min", "lat", "lat_abs", "lon", "dist_to_land")


@query
def scan_tracks_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks as latin-1 CSV with a line of units, read back and cleaned."""
    path = new_path(spark, "tracks-csv")
    track_text(spark, sf).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return cleaned_tracks(files.read_tracks_csv(spark, path))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in three parts, or in more if it is large."""
    rows = df.count()
    return df.repartition(max(3, -(-rows // 200_000)))


@query
def scan_tracks_zip(spark: SparkSession, sf: str) -> DataFrame:
    """The same from zip archives of several members each, as many archives as the table has parts."""
    folder = new_path(spark, "tracks-zip")
    archives.write_zipped_csv(spread(track_text(spark, sf)), folder, "ISO-8859-1",
                              rows_per_member=1_000)
    return cleaned_tracks(files.read_tracks_zip(spark, folder))


@query
def scan_paged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as an endpoint would hand them out: pages of the table, read by several tasks."""
    path, columns = f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus"]
    schema = spark.read.parquet(path).select(*columns).schema
    fetch = paged.ParquetPages(path, columns)
    return paged.read_pages(spark, fetch, schema, limit=5_000)


@query
def scan_daily_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON response per station and year, with arrays over the days, back to rows."""
    days = raw_station(station_daily(spark, sf)).withColumn("year", F.year("time"))
    spans = days.groupBy("city", "year").agg(
        F.min("time").alias("first"), F.date_add(F.max("time"), 1).alias("until"))
    variables = ["temperature_2m_max", "precipitation_sum", "cloud_cover_mean"]
    grid = C.date_grid(spans, "first", "until")
    full = grid.join(days.select("city", "year", "time", *variables),
                     ["city", "year", "time"], "left")
    # At most 366 days per array.
    packed = full.groupBy("city", "year").agg(
        F.min("first").alias("first"), F.max("until").alias("until"),
        F.array_sort(F.collect_list(F.struct("time", *variables))).alias("rows"))
    daily = F.struct(*[F.col("rows").getField(v).alias(v) for v in variables])
    response = packed.select(F.to_json(F.struct(
        "city", F.unix_timestamp(F.col("first").cast("timestamp")).alias("start"),
        F.unix_timestamp(F.col("until").cast("timestamp")).alias("end"),
        F.lit(86400).alias("interval"), daily.alias("daily"))).alias("value"))
    return files.parse_daily_json(response).select(
        "city", F.to_date("time").alias("time"), *variables, "rain_sum")


@query
def project_available(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["time", "city", "temp_max", "soil_moisture", "zone", "snowfall_sum"]
    kept, missing = C.project_available(station_daily(spark, sf), wanted)
    return kept.withColumn("missing", F.lit(",".join(missing)))


@query
def dim_station_table(spark: SparkSession, sf: str) -> DataFrame:
    return dim_station(spark, sf)


@query
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    days = station_daily(spark, sf)
    early = days.where("time < DATE '1998-01-01'").select("city", "time", "temp_max")
    late = days.where("time >= DATE '1998-01-01'").select("time", "precipitation", "city")
    return files.union_by_name([early, late])


# ------------------------------------------------------------------- columns and predicates

@query
def rename_columns(spark: SparkSession, sf: str) -> DataFrame:
    from isobar.schemas import SHORT_NAMES
    raw = raw_station(station_daily(spark, sf))
    return C.rename_present(raw, SHORT_NAMES).select(
        "city", "time", "temp_max", "temp_min", "temp_mean", "precipitation", "wind_gust_max")


def readings_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as text, some of it not a number."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("point_id"),
        F.when(e % 5 == 0, "n/a").when(e % 7 == 0, " ").when(e % 11 == 0, "NaN")
        .otherwise(F.col("value").cast("string")).alias("reading"))


@query
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return C.coerce_numeric(readings_as_text(spark, sf),
                            {"reading": "value", "absent": "other"}, absent=0.0)


@query
def first_present(spark: SparkSession, sf: str) -> DataFrame:
    points = track_points(spark, sf)
    return points.select(
        "point_id", C.first_present(points, cyclone.WIND_COLUMNS).alias("by_column"),
        C.first_present(points, cyclone.WIND_COLUMNS, per_row=True).alias("by_row"))


@query
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    text = table(spark, sf, "events").select(
        e.alias("point_id"),
        F.when(e % 9 == 0, "not a date").otherwise(F.col("ts").cast("string")).alias("text"))
    parsed = text.withColumn("at", C.to_time(F.col("text")))
    return parsed.select("point_id", *[c.alias(n) for n, c in C.date_parts(F.col("at")).items()])


@query
def seasonal_features(spark: SparkSession, sf: str) -> DataFrame:
    days = station_daily(spark, sf).select("city", "time")
    return rounded(C.seasonal_features(days), 6, SEASON)


@query
def attach_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Station metadata onto the rows, by the small dimension's key."""
    days = station_daily(spark, sf).select("city", "time", "temp_max")
    known = dim_station(spark, sf).where("zone <> 'REGION_1'")
    return dimension.attach_dimension(days, known, cols=["zone"])


@query
def filter_nature(spark: SparkSession, sf: str) -> DataFrame:
    return cyclone.filter_nature(track_points(spark, sf)).select("point_id", "nature")


@query
def drop_all_null(spark: SparkSession, sf: str) -> DataFrame:
    points = track_points(spark, sf).select("point_id", "wmo_wind", "wmo_pres")
    return C.drop_all_null(points, ["wmo_wind", "wmo_pres"])


@query
def validate_features(spark: SparkSession, sf: str) -> DataFrame:
    tracks = cyclone.prepare_tracks(track_points(spark, sf).withColumn("time", F.col("iso_time")))
    valid, quarantine = quality.validate_features(tracks, CYCLONE_RULES)
    both = valid.withColumn("violations", F.array().cast("array<string>")).unionByName(quarantine)
    return both.select("point_id", F.array_join("violations", "; ").alias("violations"),
                       F.round("pressure_min", 4).alias("pressure_min"))


@query
def align_features(spark: SparkSession, sf: str) -> DataFrame:
    tracks = cyclone.prepare_tracks(track_points(spark, sf))
    return quality.align_features(tracks, CYCLONE_FEATURES, ["point_id"])


@query
def check_unique_key(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


# ------------------------------------------------------------------------------- cyclones

@query
def cyclone_prepare(spark: SparkSession, sf: str) -> DataFrame:
    return cyclone.prepare_tracks(track_points(spark, sf)).select(
        "point_id", "year", "month", "day", "dayofyear", "wind_kts", "category",
        "pressure_min", "lat", "lat_abs", "lon", "dist_to_land")


@query
def cyclone_category(spark: SparkSession, sf: str) -> DataFrame:
    return track_points(spark, sf).select(
        "point_id", "wmo_wind", E.cyclone_category(F.col("wmo_wind")).alias("category"))


@query
def category_text(spark: SparkSession, sf: str) -> DataFrame:
    kind = (F.col("point_id") % 8).cast("int")
    return track_points(spark, sf).select(
        "point_id", kind.alias("category"), E.category_text(kind).alias("description"))


@query
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return weights.class_distribution(cyclone.prepare_tracks(track_points(spark, sf)), "category")


@query
def leakage_corr(spark: SparkSession, sf: str) -> DataFrame:
    tracks = cyclone.prepare_tracks(track_points(spark, sf), per_row_wind=True)
    pairs = explore.leakage_corr(tracks, ["pressure_min", "lat_abs", "dist_to_land"], "category")
    return rounded(pairs, 6, ["correlation"])


@query
def mean_by_class(spark: SparkSession, sf: str) -> DataFrame:
    tracks = cyclone.prepare_tracks(track_points(spark, sf))
    return rounded(explore.mean_by_class(tracks, "pressure_min", "category"), 6,
                   ["mean_pressure_min"])


# --------------------------------------------------------------------- coverage and health

@query
def coverage_by_city(spark: SparkSession, sf: str) -> DataFrame:
    return explore.coverage(station_daily(spark, sf)).orderBy("n_rows", "city")


@query
def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return explore.coverage_rollup(station_daily(spark, sf))


@query
def distinct_entities(spark: SparkSession, sf: str) -> DataFrame:
    return explore.distinct_entities(station_daily(spark, sf))


@query
def entity_extent(spark: SparkSession, sf: str) -> DataFrame:
    return health.extent(station_daily(spark, sf))


@query
def freshness_status(spark: SparkSession, sf: str) -> DataFrame:
    return health.freshness(station_daily(spark, sf), F.lit("2001-11-05").cast("date"),
                            dimension=dim_station(spark, sf))


@query
def count_since(spark: SparkSession, sf: str) -> DataFrame:
    return health.count_since(station_daily(spark, sf), "time", F.lit("2000-01-01").cast("date"))


@query
def latest_batches(spark: SparkSession, sf: str) -> DataFrame:
    recent = health.latest_batches(store.batch_states(batch_ledger(spark, sf)))
    return recent.select("id", F.to_date("started_at").alias("started"), "status",
                         "rows_ingested", "minutes", "error_message")


@query
def stale_batches(spark: SparkSession, sf: str) -> DataFrame:
    late = health.stale_batches(store.batch_states(batch_ledger(spark, sf)),
                                F.lit("2001-07-31 12:00:00").cast("timestamp"))
    return late.select("id", F.to_date("started_at").alias("started"), "status")


# --------------------------------------------------------------------------- ingest

def two_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The panel as two overlapping batches; the second corrects the year 1998."""
    days = station_daily(spark, sf).select("city", "time", "precipitation")

    def stamped(df: DataFrame, batch: str, day: str) -> DataFrame:
        return df.withColumns({"batch_id": F.lit(batch),
                               "ingested_at": F.lit(day).cast("timestamp")})

    first = stamped(days.where("time < DATE '1999-01-01'"), "9", "2024-01-01")
    later = days.where("time >= DATE '1998-01-01'")
    later = later.withColumn("precipitation", F.round(F.col("precipitation") + 1, 2))
    return first, stamped(later, "10", "2024-01-01")


@query
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    first, second = two_batches(spark, sf)
    return store.upsert_latest(first, second).select("city", "time", "precipitation", "batch_id")


@query
def upsert_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same merge into a stored table; the second batch is delivered twice."""
    path = new_path(spark, "observations")
    first, second = two_batches(spark, sf)
    for batch in (first, second, second):
        ingest.upsert_into(spark, path, batch)
    return ingest.read_table(spark, path).select("city", "time", "precipitation", "batch_id")


@query
def new_rows_anti(spark: SparkSession, sf: str) -> DataFrame:
    first, second = two_batches(spark, sf)
    return store.new_rows(second, first).select("city", "time", "precipitation")


@query
def coverage_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Days to fetch from stored intervals, which a second batch has extended; no rows are read again."""
    panel = panel_once(spark, sf).select("city", "time")
    held = panel.where(~F.dayofmonth("time").isin(7, 8, 21))
    early = F.year("time") % 2 == 0
    stored = materialize(coverage.intervals(held.where(early)), "coverage")
    stored = materialize(coverage.extended(stored, held.where(~early)), "coverage")
    ends = panel.agg(F.min(F.to_date("time")).alias("a"), F.max(F.to_date("time")).alias("z"))
    return coverage.holes(panel.select("city").distinct(), stored,
                          F.date_sub(ends.select("a").scalar(), 3),
                          F.date_add(ends.select("z").scalar(), 2))


@query
def ingest_plan(spark: SparkSession, sf: str) -> DataFrame:
    return store.plan_ranges(dim_station(spark, sf), station_daily(spark, sf),
                             "1995-01-01", "2001-10-31")


@query
def year_chunks(spark: SparkSession, sf: str) -> DataFrame:
    spans = health.extent(station_daily(spark, sf)).select("city", "earliest", "latest")
    return C.year_chunks(spans, "earliest", "latest").select("city", "chunk_start", "chunk_end")


def land(spark: SparkSession, sf: str) -> list[str]:
    """The two batches as landed CSV folders, with a row without a day for every city.

    The second batch has its columns in another order.
    """
    from isobar.schemas import STATION
    paths = []
    for i, batch in enumerate(two_batches(spark, sf)):
        raw = batch.withColumnsRenamed({"precipitation": "precipitation_sum"})
        absent = {f.name: F.lit(None).cast(f.dataType) for f in STATION.fields
                  if f.name not in raw.columns}
        whole = raw.withColumns(absent).select(*STATION.names)
        broken = whole.groupBy("city").agg(F.max("precipitation_sum").alias("precipitation_sum"))
        names = STATION.names[::-1] if i else STATION.names
        path = new_path(spark, f"landed-{i}")
        (whole.unionByName(broken, allowMissingColumns=True).select(*names)
         .write.option("header", True).csv(path))
        paths.append(path)
    return paths


def outcome(spark: SparkSession, path: str, quarantine: str) -> DataFrame:
    """Extent and totals of the stored and of the quarantined rows of each city."""
    both = ingest.read_table(spark, path).select("city", "time", "precipitation_sum",
                                                 F.lit("stored").alias("kind"))
    both = both.unionByName(spark.read.parquet(quarantine).select(
        "city", "time", "precipitation_sum", F.lit("quarantined").alias("kind")))
    return both.groupBy("kind", "city").agg(
        F.count(F.lit(1)).alias("n_rows"), F.to_date(F.min("time")).alias("earliest"),
        F.to_date(F.max("time")).alias("latest"),
        F.round(F.sum("precipitation_sum"), 2).alias("precipitation"))


@query
def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two landed batches through the ingest job with ledger and quarantine."""
    path, ledger, bad = (new_path(spark, n) for n in ("table", "ledger", "quarantine"))
    for i, landed in enumerate(land(spark, sf), start=1):
        ingest.run_batch(spark, landed, path, ledger, bad, i, f"2024-01-0{i} 00:00:00",
                         f"2024-01-0{i} 00:10:00")
    batches = ingest.ledger_states(spark, ledger).select(
        F.concat(F.lit("batch "), "status").alias("kind"), F.col("id").cast("string").alias("city"),
        F.col("rows_ingested").alias("n_rows"))
    return outcome(spark, path, bad).unionByName(batches, allowMissingColumns=True)


@query
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same batches through the streaming job, one run after each landing."""
    path, state, inbox, bad = (new_path(spark, n) for n in (
        "table", "stream-state", "inbox", "quarantine"))
    for folder in land(spark, sf):
        arrived = files.read_text_csv(spark, folder)
        arrived.write.mode("append").option("header", True).csv(inbox)
        stream_landed(spark, inbox, path, state, bad).awaitTermination()
    return outcome(spark, path, bad)


# ------------------------------------------------------------------ matrices and splits

FEATURE_DIGITS = [*ROLLED, *LAGGED, *SEASON]


def features_once(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table with next-day targets, written once as the ETL does."""
    wide = weather.weather_features(panel_once(spark, sf), targets=True, drop_unlagged=False)
    return materialize(wide, "features")


@query
def matrix_cyclone(spark: SparkSession, sf: str) -> DataFrame:
    return matrices.cyclone_matrix(cyclone.prepare_tracks(track_points(spark, sf)))


@query
def matrix_heatwave(spark: SparkSession, sf: str) -> DataFrame:
    matrix = matrices.heatwave_matrix(features_once(spark, sf))
    return rounded(matrix, 4, [c for c in HEATWAVE_FEATURES if c in FEATURE_DIGITS])


@query
def matrix_rainfall(spark: SparkSession, sf: str) -> DataFrame:
    matrix = matrices.rainfall_matrix(features_once(spark, sf))
    return rounded(matrix, 4, [c for c in RAINFALL_FEATURES if c in FEATURE_DIGITS])


@query
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    points = track_points(spark, sf).select("point_id", "wmo_wind", "wmo_pres")
    return rounded(matrices.impute_median(points, ["wmo_wind", "wmo_pres"]), 6,
                   ["wmo_wind", "wmo_pres"])


def heat_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Heatwave label, deterministic score and its decision per station day."""
    days = station_daily(spark, sf).select("city", "time", "temp_max")
    score = (F.col("temp_max") % 10) / 10.0
    return labels.label_heatwave(days).select(
        "city", "time", F.col("heatwave_flag").alias("label"), score.alias("score"),
        (score >= 0.5).cast("int").alias("prediction"))


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    labelled = materialize(heat_labels(spark, sf).select("city", "time", "label"), "labels")
    return matrices.split_test(labelled)


@query
def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = matrices.temporal_split(station_daily(spark, sf).select("city", "time"))
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test")))


@query
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    tracks = cyclone.prepare_tracks(track_points(spark, sf))
    return rounded(weights.class_weights(tracks, "category"), 6, ["weight"])


@query
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    tracks = cyclone.prepare_tracks(track_points(spark, sf)).select("point_id", "category")
    return rounded(weights.with_balanced_weight(tracks, "category"), 6, ["weight"])


@query
def pos_weight(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights.pos_weight(heat_labels(spark, sf)), 6, ["pos_ratio"])


@query
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["temp_max", "precipitation", "pressure_msl_mean"]
    days = station_daily(spark, sf).select("city", "time", *cols)
    return rounded(weights.standardize(days, cols), 5, cols)


# ------------------------------------------------------------------------------- metrics

def graded_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """True category, the category of the other agency's wind, and six class probabilities."""
    tracks = cyclone.prepare_tracks(track_points(spark, sf))
    raw = [(1 + (F.col("point_id") * (c + 3) + F.col("storm_id") * 7) % 11).cast("double")
           for c in range(6)]
    total = raw[0] + raw[1] + raw[2] + raw[3] + raw[4] + raw[5]
    return tracks.select("point_id", F.col("category").alias("label"),
                         E.cyclone_category(F.col("usa_wind")).alias("prediction"),
                         F.array(*[r / total for r in raw]).alias("probabilities"))


@query
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(graded_tracks(spark, sf))


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(graded_tracks(spark, sf), range(6))


@query
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.classification_metrics(graded_tracks(spark, sf)), 6,
                   ["accuracy", "precision", "recall", "f1"])


@query
def per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.per_class_metrics(graded_tracks(spark, sf)), 6,
                   ["precision", "recall", "f1"])


@query
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(heat_labels(spark, sf)), 6, ["roc_auc"])


@query
def roc_auc_by_class(spark: SparkSession, sf: str) -> DataFrame:
    graded = graded_tracks(spark, sf)
    return rounded(metrics.roc_auc_by_class(graded, "label", "probabilities", 6), 6, ["roc_auc"])


@query
def roc_auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    graded = graded_tracks(spark, sf)
    return rounded(metrics.roc_auc_ovr(graded, "label", "probabilities", 6), 6, ["roc_auc"])


@query
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.log_loss(heat_labels(spark, sf)), 6, ["log_loss"])


@query
def log_loss_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    graded = graded_tracks(spark, sf)
    return rounded(metrics.log_loss_multiclass(graded, "label", "probabilities"), 6, ["log_loss"])


# ----------------------------------------------------------------------------- decisions

@query
def severity_band(spark: SparkSession, sf: str) -> DataFrame:
    scored = heat_labels(spark, sf)
    return scored.select("city", "time", "score", *[
        c.alias(n) for n, c in scoring.heatwave_decision(F.col("score")).items()])


@query
def rain_decision(spark: SparkSession, sf: str) -> DataFrame:
    scored = station_daily(spark, sf).select(
        "city", "time", (F.col("cloud_cover_mean") / 100).alias("score"))
    return scored.select("city", "time", *[
        c.alias(n) for n, c in scoring.rainfall_decision(F.col("score")).items()])


@query
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    decided = scoring.decide(graded_tracks(spark, sf).select("point_id", "probabilities"),
                             "cyclone")
    return decided.select("point_id", "category", "description",
                          F.round("confidence", 6).alias("confidence"),
                          F.round(F.try_element_at("probabilities", F.lit("2")), 6).alias("p2"))


# --------------------------------------------------------------------------------- drift

LOGGED = ["f_value", "f_k"]


@query
def prediction_log_parse(spark: SparkSession, sf: str) -> DataFrame:
    return drift.parse_features(prediction_log(spark, sf))


@query
def drift_window_split(spark: SparkSession, sf: str) -> DataFrame:
    return drift.window_split(prediction_log(spark, sf)).select(
        "id", "model_name", "age", "samples", "side")


def sided_log(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log in long form, first half of the month against the second."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    log = prediction_log(spark, sf).withColumn(
        "side", F.when(early, "reference").otherwise("current"))
    return drift.unpivot_features(log, LOGGED, ["model_name", "side"])


@query
def drift_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drift.moments(sided_log(spark, sf)), 5,
                   ["reference_mean", "current_mean", "reference_std", "current_std"])


@query
def drift_ks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drift.ks_two_sample(sided_log(spark, sf)), 6, ["statistic"])


@query
def drift_pvalue_asymp(spark: SparkSession, sf: str) -> DataFrame:
    found = drift.compute_drift(sided_log(spark, sf), "asymptotic")
    return rounded(found.select("model_name", "feature", "statistic", "p_value", "drifted"), 6,
                   ["statistic", "p_value"])


@query
def drift_pvalue_exact(spark: SparkSession, sf: str) -> DataFrame:
    split = drift.window_split(prediction_log(spark, sf))
    found = drift.compute_drift(drift.feature_rows(split, LOGGED), "exact")
    return rounded(found.select("model_name", "feature", "n_ref", "n_cur", "statistic", "p_value",
                                "drifted"), 6, ["statistic", "p_value"])


def report_text(report: DataFrame) -> DataFrame:
    """The report with one row per tested feature, as columns; one row for models without any."""
    kept = report.drop("timestamp").withColumn("f", F.explode_outer("features"))
    return kept.drop("features").select("*", "f.*").drop("f")


@query
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    return report_text(drift.drift_report(prediction_log(spark, sf), LOGGED, method="asymptotic"))


@query
def drift_report_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same report from a log that grows three times, of which a stream keeps the windows.

    A run of the stream takes all files of an append, so there are three reports for any number of files.
    """
    log, reports, checkpoint = (new_path(spark, x) for x in ("log", "reports", "drift-stream"))
    rows = prediction_log(spark, sf).select(
        "id", "model_name", F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        F.create_map(*[x for c in LOGGED for x in (F.lit(c), F.col(c))]).alias("features"),
        F.lit(None).cast("string").alias("prediction"))
    for no in range(3):
        sinks.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == no), log)
        stream_drift(spark, log, reports, checkpoint, method="asymptotic").awaitTermination()
    report = spark.read.parquet(reports).drop("epoch")
    return report_text(report.select("model_name", *[c for c in report.columns if c != "model_name"]))


# ------------------------------------------------------------------------------- models

RUN_ID = "bench"


def tracks_once(spark: SparkSession, sf: str) -> DataFrame:
    return cyclone.prepare_tracks(track_points(spark, sf))


def checked_run(table: DataFrame) -> DataFrame:
    """Rows per split beside the names of the metrics and whether their values can be right."""
    sizes = table.where("metric = 'rows'").select("split", F.col("value").cast("long").alias("n_rows"))
    limit = F.when(F.col("metric") == "log_loss", F.lit(float("inf"))).otherwise(1.0)
    return (table.where("metric != 'rows'").join(sizes, "split")
            .withColumn("in_range", F.col("value").between(0, limit)).drop("value"))


@query
def train_cyclone(spark: SparkSession, sf: str) -> DataFrame:
    return checked_run(training.train(tracks_once(spark, sf), "cyclone", RUN_ID)[1])


@query
def train_heatwave(spark: SparkSession, sf: str) -> DataFrame:
    return checked_run(training.train(features_once(spark, sf), "heatwave", RUN_ID)[1])


@query
def train_rainfall(spark: SparkSession, sf: str) -> DataFrame:
    return checked_run(training.train(features_once(spark, sf), "rainfall", RUN_ID)[1])


@query
def feature_importances(spark: SparkSession, sf: str) -> DataFrame:
    matrix = materialize(matrices.cyclone_matrix(tracks_once(spark, sf)), "matrix")
    model = training.fit(matrix, "cyclone")
    return training.importances(model, CYCLONE_FEATURES).select(
        "feature", F.col("importance").between(0, 1).alias("in_range"))


@query
def score_heatwave(spark: SparkSession, sf: str) -> DataFrame:
    """Fit, score every station day in one batch, and count scored rows and broken rules."""
    processed = features_once(spark, sf)
    matrix = materialize(matrices.heatwave_matrix(processed), "matrix")
    scored, bad = scoring.score(training.fit(matrix, "heatwave"), processed, "heatwave")
    log = scoring.to_prediction_log(scored, "heatwave", F.lit("2024-01-01"))
    outcomes = log.select(F.lit("scored").alias("outcome")).unionAll(
        bad.select(F.explode("violations")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def score_log_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of two batches are logged, and the log itself is tested for drift."""
    tracks = tracks_once(spark, sf)
    graded = tracks.join(graded_tracks(spark, sf).select("point_id", "probabilities"), "point_id")
    log = new_path(spark, "prediction-log")
    middle = F.col("iso_time") < F.lit("2024-01-16").cast("timestamp")
    for day, part in (("2024-02-01", graded.where(middle)), ("2024-02-02", graded.where(~middle))):
        sinks.append(scoring.to_prediction_log(scoring.decide(part, "cyclone"), "cyclone",
                                               F.lit(day), F.col("point_id")), log)
    logged = spark.read.parquet(log)
    split = drift.window_split(logged, order=("timestamp", "id"), usable=F.size("features") > 0)
    found = drift.compute_drift(drift.feature_rows(split), "asymptotic")
    report = drift.drift_report(logged, method="asymptotic", order=("timestamp", "id"))
    return rounded(found.join(report.select("model_name", "samples"), "model_name").select(
        "model_name", "feature", "n_ref", "n_cur", "statistic", "p_value", "drifted", "samples"),
        4, ["statistic", "p_value"])


def beside_floor(table: DataFrame, prepared: DataFrame, label: str) -> DataFrame:
    """The run, with the sizes of the splits, next to what the class shares alone would reach.

    The floor is the share of the largest class for the accuracy and the entropy of the shares for
    the log loss; other metrics have none. ``reached`` says that the model does better.
    """
    shares = prepared.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n")).agg(
        (F.max("n") / F.sum("n")).alias("accuracy"),
        (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("log_loss"))
    floors = shares.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("floor"))
        for c in ("accuracy", "log_loss")])))
    sizes = table.where("metric = 'rows'").select("split", F.col("value").cast("long").alias("n_rows"))
    better = F.when(F.col("metric") == "log_loss", F.col("value") < F.col("floor")).otherwise(
        F.col("value") > F.col("floor"))
    return (table.where("metric != 'rows'").join(sizes, "split").join(floors, "metric", "left")
            .select("run_id", "model", "split", "metric", "n_rows", "floor", better.alias("reached"),
                    F.col("value").between(0, F.when(F.col("metric") == "log_loss", float("inf"))
                                           .otherwise(1.0)).alias("in_range")))


@query
def train_cyclone_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax boosting does better than the class shares, on the rows held out as well."""
    tracks = tracks_once(spark, sf)
    return beside_floor(boosted.train(tracks, "cyclone", RUN_ID)[1], tracks, "category")


@query
def train_heatwave_boosted(spark: SparkSession, sf: str) -> DataFrame:
    return checked_run(boosted.train(features_once(spark, sf), "heatwave", RUN_ID)[1])


@query
def train_rainfall_boosted(spark: SparkSession, sf: str) -> DataFrame:
    return checked_run(boosted.train(features_once(spark, sf), "rainfall", RUN_ID)[1])


@query
def tune_rainfall(spark: SparkSession, sf: str) -> DataFrame:
    """The whole adaptive search: all trials of the default ranges, three folds each."""
    matrix = matrices.rainfall_matrix(features_once(spark, sf))
    return boosted.search(matrix, "rainfall")[1].select(
        "trial", "metric", F.col("score").between(0, 1).alias("in_range"))


@query
def ablation_cyclone(spark: SparkSession, sf: str) -> DataFrame:
    return training.ablation(tracks_once(spark, sf), "cyclone", "pressure_min").select(
        "subset", "feature", F.col("accuracy").between(0, 1).alias("in_range"))
