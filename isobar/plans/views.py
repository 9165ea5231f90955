"""Panels and logs shaped from the star-schema tables the queries are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared columns of the tables the queries read; saves a job per table to find them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def dim_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation as station, region as zone."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("station_id"), F.col("n_name").alias("city"),
        F.col("r_name").alias("zone"))


# Daily measures of a station, from the line items shipped that day.
MEASURES = [
    "max(l_quantity) AS temp_max",
    "min(l_quantity) AS temp_min",
    "round(avg(l_quantity), 6) AS temp_mean",
    "round(sum(l_extendedprice), 2) AS precipitation",
    "round(max(l_discount) * 500, 6) AS wind_speed_10m_max",
    "round(max(l_discount) * 1000, 6) AS wind_gust_max",
    "round(1000 + min(l_tax) * 100, 6) AS pressure_msl_mean",
    "cast(sum(l_suppkey) % 100 AS double) AS relative_humidity_2m_mean",
    "cast(sum(l_partkey) % 100 AS double) AS cloud_cover_mean",
]


def station_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (city, time): supplier nation and ship date with daily measures.

    Rows are reduced to (nation, day) before names are looked up, so the large table meets one
    narrow join on integers and its aggregates combine ahead of the shuffle. AQE splits a
    supplier that owns a large share of the rows.
    """
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lineitem = table(spark, sf_dir, "lineitem")
    daily = (lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
             .groupBy("s_nationkey", F.expr("to_date(l_shipdate)").alias("time"))
             .agg(*[F.expr(measure) for measure in MEASURES]))
    station = dim_station(spark, sf_dir)
    return (daily.join(station, daily.s_nationkey == station.station_id)
            .select("city", "zone", *daily.columns[1:]))


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as storm fixes; some wind and pressure readings are missing."""
    e, value = F.col("event_id"), F.col("value")
    natures = F.create_map(*[F.lit(x) for pair in (
        ("click", "TS"), ("view", "mx"), ("purchase", "ET"), ("signup", "DS")) for x in pair])
    return table(spark, sf_dir, "events").select(
        e.alias("point_id"), F.col("user_id").alias("storm_id"),
        F.col("ts").cast("timestamp").alias("iso_time"),
        F.try_element_at(natures, F.col("event_type")).alias("nature"),
        F.when(e % 7 != 0, value).alias("wmo_wind"), value.alias("usa_wind"),
        F.when(e % 11 != 0, F.round(1010 - value * 0.5, 4)).alias("wmo_pres"),
        (F.col("user_id") % 60 - 30).cast("double").alias("lat"),
        (60 + e % 40).cast("double").alias("lon"),
        (e % 500).cast("double").alias("dist2land"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged predictions: event type is the model, two numeric features."""
    key = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("model_name"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("f_value"),
        key.try_cast("double").alias("f_k"), F.col("props").alias("features_json"))


def batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingest batches: a ``running`` record at the start and a closing one later.

    Open orders stay running; in-process ones fail with a long error text.
    """
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    started = F.col("o_orderdate").cast("timestamp")
    ended = F.timestamp_add("MINUTE", (key % 90).cast("int") + 1, started)
    error = F.when(status == "P", F.rpad(F.concat(F.lit("batch "), key.cast("string")), 500, "."))
    closing = F.when(status == "F", "completed").when(status == "P", "failed")
    record = F.array_compact(F.array(
        F.struct(F.lit(None).cast("timestamp").alias("completed_at"),
                 F.lit(0).cast("long").alias("rows_ingested"), F.lit("running").alias("status"),
                 F.lit(None).cast("string").alias("error_message"), started.alias("recorded_at")),
        F.when(closing.isNotNull(), F.struct(
            ended.alias("completed_at"), F.col("o_custkey").alias("rows_ingested"),
            closing.alias("status"), error.alias("error_message"), ended.alias("recorded_at")))))
    return (table(spark, sf_dir, "orders").withColumn("_record", F.explode(record))
            .select(key.alias("id"), started.alias("started_at"), F.lit(1).alias("cities_count"),
                    "_record.*"))
