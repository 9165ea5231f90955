from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from isobar.functions import columns as C
from isobar.functions import events as E
from isobar.operators import cyclone, quality, store
from isobar.plans import scoring
from isobar.schemas import (CYCLONE_FEATURES, CYCLONE_RULES, HEATWAVE_RULES, STATION,
                            station_dimension)


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_wind_buckets(spark):
    df = spark.createDataFrame([(w,) for w in (None, 33.9, 34.0, 63.9, 64.0, 82.9, 83.0, 95.9, 96.0,
                                               112.9, 113.0, 137.0)], "w double")
    assert values(df, E.cyclone_category(F.col("w"))) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_category_text(spark):
    df = spark.createDataFrame([(0,), (5,), (7,)], "c int")
    assert values(df, E.category_text(F.col("c"))) == [
        "Tropical Depression", "Category 5", "Unknown (category 7)"]


def test_severity(spark):
    df = spark.createDataFrame([(p,) for p in (0.29, 0.30, 0.49, 0.50, 0.74, 0.75)], "p double")
    assert values(df, E.severity_band(F.col("p"))) == [
        "none", "watch", "watch", "warning", "warning", "severe"]
    assert values(df, E.positive(F.col("p"))) == [False, False, False, True, True, True]
    one = spark.createDataFrame([(0.2,)], "p double")
    assert values(one, E.confidence(F.col("p"))) == [0.8]


def test_cyclone_decision(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4, 0.1, 0.0, 0.0],)], "probabilities array<double>")
    got = scoring.decide(df, "cyclone").first()
    assert (got["category"], got["description"], got["confidence"]) == (1, "Category 1", 0.4)
    assert got["probabilities"] == {"0": 0.1, "1": 0.4, "2": 0.4, "3": 0.1, "4": 0.0, "5": 0.0}


def test_nan_becomes_null_and_never_counts_as_hot(spark):
    df = spark.createDataFrame([(float("nan"),), (41.0,), (None,)], "t double")
    clean = C.normalise_nulls(df)
    assert values(clean, E.flag(F.col("t") > 40)) == [0, 1, 0]


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("",), (" ",), ("kts",), ("NaN",)], "x string")
    got = C.coerce_numeric(df, {"x": "y", "gone": "z"}, absent=0.0).collect()
    assert [(r["y"], r["z"]) for r in got] == [(1.5, 0.0)] + [(None, 0.0)] * 4
    dates = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("units",)], "d string")
    assert [v is None for v in values(dates, C.to_time(F.col("d")))] == [True, False, True]


def test_first_present(spark):
    df = spark.createDataFrame([(None, 2.0)], "usa_wind double, wind double")
    assert values(df, C.first_present(df, cyclone.WIND_COLUMNS)) == [None]
    assert values(df, C.first_present(df, cyclone.WIND_COLUMNS, per_row=True)) == [2.0]
    assert C.first_present(df, ["other"]) is None


def test_drop_all_null_and_projection(spark):
    df = spark.createDataFrame([(None, None, 1), (1.0, None, 2)], "a double, b double, i int")
    assert values(C.drop_all_null(df, ["a", "b"]), "i") == [2]
    kept, missing = C.project_available(df, ["b", "x", "a"])
    assert kept.columns == ["b", "a"] and missing == ["x"]


def test_prepare_tracks_golden(spark):
    df = spark.createDataFrame(
        [("2020-01-02 06:00:00", "TS", "-12.5", "80", "64", "990", "70", "12"),
         ("2020-12-31 00:00:00", "mx", "3", "81", " ", "", "40", ""),
         ("2020-01-02 06:00:00", "ET", "1", "1", "50", "1000", "50", "1"),
         ("2020-01-02 06:00:00", None, "1", "1", "50", "1000", "50", "1"),
         ("", "TS", "degrees_north", "degrees_east", "kts", "mb", "kts", "km")],
        "ISO_TIME string, NATURE string, LAT string, LON string, WMO_WIND string, "
        "WMO_PRES string, USA_WIND string, DIST2LAND string")
    got = rows(cyclone.prepare_tracks(df, dated_only=True), "lat")
    assert [(r["lat"], r["lat_abs"], r["lon"], r["wind_kts"], r["category"], r["pressure_min"],
             r["dist_to_land"], r["year"], r["dayofyear"]) for r in got] == [
        (-12.5, 12.5, 80.0, 64.0, 2, 990.0, 12.0, 2020, 2),
        (3.0, 3.0, 81.0, 0.0, 0, None, None, 2020, 366)]
    assert cyclone.prepare_tracks(df).count() == 3
    by_row = rows(cyclone.prepare_tracks(df, per_row_wind=True, dated_only=True), "lat")
    assert [r["category"] for r in by_row] == [2, 0]  # blank text is not NULL


def test_prepare_tracks_without_optional_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    got = cyclone.prepare_tracks(df).first()
    assert (got["wind_kts"], got["category"], got["pressure_min"], got["year"]) == (0.0, 0, None, 0)
    assert cyclone.prepare_tracks(df.limit(0)).columns == cyclone.prepare_tracks(df).columns


def test_validation_splits_and_fills(spark):
    base = dict(lat_abs=10.0, lon=80.0, lat=10.0, pressure_min=990.0, dist_to_land=None,
                year=None, month=1.0, dayofyear=12.0)
    bad = dict(base, lat=91.0, pressure_min=None, month=1.5)
    schema = ", ".join(f"{c} double" for c in base)
    df = spark.createDataFrame([tuple(base.values()), tuple(bad.values())], schema)
    valid, quarantine = quality.validate_features(df, CYCLONE_RULES)
    ok = valid.first()
    assert (ok["dist_to_land"], ok["year"], "violations" in valid.columns) == (0.0, 2024.0, False)
    assert quarantine.first()["violations"] == [
        "lat: above 90", "pressure_min: required", "month: not whole"]
    none, all_bad = quality.validate_features(df.select("month"), HEATWAVE_RULES)
    assert none.count() == 0 and all_bad.count() == 2


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2, 3)], "c int, a int, b int")
    assert quality.align_features(df, ["a", "b"], ["c"]).columns == ["c", "a", "b"]
    with pytest.raises(ValueError, match="pressure_min"):
        quality.align_features(df, CYCLONE_FEATURES)


def test_unique_key_check(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "city string, time int")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["city", "time"]).collect()] == [("a", 1, 2)]


def test_upsert_golden_and_idempotent(spark):
    schema = "city string, time string, v int, batch_id string, ingested_at string"
    first = spark.createDataFrame([("A", "d1", 1, "1", "t1"), ("B", "d1", 3, "1", "t1")], schema)
    second = spark.createDataFrame([("A", "d1", 2, "2", "t2")] * 50, schema)
    once = store.upsert_latest(first, second)
    assert [(r["city"], r["v"]) for r in rows(once, "city")] == [("A", 2), ("B", 3)]
    again = store.upsert_latest(once, second)
    assert rows(again, "city") == rows(once, "city")
    assert [(r["city"]) for r in store.new_rows(first, second).collect()] == ["B"]


def test_plan_ranges(spark):
    dim = spark.createDataFrame([("new",), ("behind",), ("edge",), ("done",)], "city string")
    stored = spark.createDataFrame([("behind", "2024-01-05"), ("edge", "2024-01-09"),
                                    ("done", "2024-01-10")], "city string, time string")
    plan = store.plan_ranges(dim, stored, "2010-01-01", "2024-01-10")
    got = {r["city"]: (r["action"], str(r["fetch_start"]), str(r["fetch_end"]))
           for r in plan.collect()}
    assert got == {"new": ("full", "2010-01-01", "2024-01-10"),
                   "behind": ("resume", "2024-01-06", "2024-01-10"),
                   "edge": ("resume", "2024-01-10", "2024-01-10"),
                   "done": ("skip", "None", "None")}
    forced = store.plan_ranges(dim, stored, "2010-01-01", "2024-01-10", force=True)
    assert {r["action"] for r in forced.collect()} == {"full"}


def test_station_dimension(spark):
    dim = station_dimension(spark)
    assert dim.count() == 15 and dim.groupBy("zone").count().count() == 4
    assert len(STATION) == 21
