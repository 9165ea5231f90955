"""Sources, sinks, ingest, streaming, ETL, training and scoring on files."""

from __future__ import annotations

import datetime as dt
import json
import re
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from isobar.operators import health
from isobar.plans import ingest, scoring, training, weather
from isobar.schemas import (CYCLONE_FEATURES, DAILY_VARIABLES, HEATWAVE_FEATURES, SHORT_NAMES,
                            STATION, station_dimension)
from isobar.session import materialize, shared_dir
from isobar.sources import files, jdbc, sinks
from isobar.streaming.landing import stream_landed


# A cycle of days on both sides of the heat limits, with a gap, and one of rain around its limits.
HEAT = [31.0, 38.5, 40.0, 40.1, 42.0, 45.0, 45.2, 46.0, None, 29.5, 33.0]
RAIN = [0.0, 0.2, 7.5, 49.9, 50.0, 50.1, 12.0, 100.1, 0.0, 3.3]
FIRST = dt.datetime(2021, 3, 1)


def station_days(spark, days, cities, shift=0):
    """Daily rows by rule: day ``d`` takes the ``d + shift``-th entry of every cycle."""
    data = []
    for place, city in enumerate(cities):
        for d in range(days):
            k = d + shift
            row = {v: 10.0 + (7 * k + i) % 40 for i, v in enumerate(DAILY_VARIABLES)}
            row |= {"temperature_2m_max": HEAT[k % 11], "temperature_2m_min": 18.0 + k % 5,
                    "precipitation_sum": 250.0 if d == 50 else RAIN[3 * k % 10], "pressure_msl_mean": 995.0 + k % 25,
                    "latitude": 8.0 + place, "longitude": 77.0 + place, "city": city,
                    "state": "none", "zone": "none", "time": FIRST + dt.timedelta(days=d)}
            data.append(tuple(row[c] for c in STATION.names))
    return spark.createDataFrame(data, STATION)


# -------------------------------------------------------------------------------- sources

def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "weather_a.csv").write_text(
        "city,extra,precipitation_sum,time,temperature_2m_max\n"
        "Pune,9,1.5,2024-01-01,30\nPune,9,oops,2024-01-02,\n")
    df, missing = files.read_station_csv(spark, str(tmp_path / "weather_*.csv"))
    got = rows(df, "time")
    assert [(r["precipitation_sum"], r["temperature_2m_max"]) for r in got] == [
        (1.5, 30.0), (None, None)]
    assert "extra" not in df.columns and "rain_sum" in missing
    assert df.schema["time"].dataType == STATION["time"].dataType
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_station_csv(spark, str(tmp_path / "none_*.csv"))


def test_files_of_other_column_order(spark, tmp_path):
    (tmp_path / "weather_a.csv").write_text("city,time,temperature_2m_max,precipitation_sum\n"
                                            "Pune,2024-01-01,30,7\n")
    (tmp_path / "weather_b.csv").write_text("precipitation_sum,city,rain_sum,time,temperature_2m_max\n"
                                            "5,Surat,1,2024-01-01,31\n")
    (tmp_path / "weather_c.csv").write_text("")
    df, missing = files.read_station_csv(spark, str(tmp_path / "weather_*.csv"))
    got = {r["city"]: (r["temperature_2m_max"], r["precipitation_sum"], r["rain_sum"])
           for r in df.collect()}
    assert got == {"Pune": (30.0, 7.0, None), "Surat": (31.0, 5.0, 1.0)}
    assert "rain_sum" not in missing


def test_corrupt_lines_are_kept_on_request(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n")
    got = rows(files.read_text_csv(spark, str(tmp_path / "x.csv"), keep_corrupt=True), "a")
    assert [r["_corrupt_record"] for r in got] == [None, "3"]


def test_latin1_tracks_plain_and_zipped(spark, tmp_path):
    text = ("ISO_TIME,NATURE,NAME,LAT,LON,WMO_WIND\n,,,degrees,degrees,kts\n"
            "2020-01-02 06:00:00,TS,José,1.5,80,64\n").encode("latin1")
    (tmp_path / "t.csv").write_bytes(text)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("t.csv", text)
        z.writestr("more/u.csv", "LAT,NATURE,ISO_TIME\n7.5,DS,2020-01-03 00:00:00\n")
    plain = files.read_tracks_csv(spark, str(tmp_path / "t.csv"))
    assert plain.columns == ["ISO_TIME", "NATURE", "LAT", "LON", "WMO_WIND"]
    zipped = files.read_tracks_zip(spark, str(tmp_path / "t.zip"))
    for df in (plain, zipped):
        assert [r["LAT"] for r in df.where("NATURE = 'TS'").collect()] == ["1.5"]
    assert [r["LAT"] for r in zipped.where("NATURE = 'DS'").collect()] == ["7.5"]
    name = files.read_text_csv(spark, str(tmp_path / "t.csv"), "ISO-8859-1").where("NAME IS NOT NULL")
    assert name.first()["NAME"] == "José"


def test_daily_json(spark):
    body = {"city": "Pune", "latitude": 1.0, "longitude": 2.0, "start": 0, "end": 3 * 86400,
            "interval": 86400, "daily": {"temperature_2m_max": [1.0, None, 3.0], "rain_sum": [5.0]}}
    empty = dict(body, city="Void", end=0)
    df = spark.createDataFrame([(json.dumps(body),), (json.dumps(empty),), ("{",)], "value string")
    got = rows(files.parse_daily_json(df), "time")
    assert [(str(r["time"]), r["temperature_2m_max"], r["rain_sum"], r["cloud_cover_mean"])
            for r in got] == [("1970-01-01 00:00:00", 1.0, 5.0, None),
                              ("1970-01-02 00:00:00", None, None, None),
                              ("1970-01-03 00:00:00", 3.0, None, None)]


def test_processed_or_raw(spark, tmp_path):
    raw = station_days(spark, 3, ("Mumbai", "Delhi")).drop("zone")
    raw.write.option("header", True).csv(str(tmp_path / "raw"))
    dim = station_dimension(spark)
    got = files.read_processed_or_raw(spark, str(tmp_path / "nope"), str(tmp_path / "raw"), dim)
    assert {"temp_max", "temperature_2m_max"} <= set(got.columns)
    got.write.option("header", True).csv(str(tmp_path / "done"))
    again = files.read_processed_or_raw(spark, str(tmp_path / "done"), str(tmp_path / "raw"), dim)
    assert {r["zone"] for r in again.select("zone").distinct().collect()} == {"coastal", "inland"}


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert [tuple(r) for r in files.union_by_name([a, b]).orderBy("b").collect()] == [
        (1, "x", None), (None, "y", 2.0)]


def test_page_options():
    got = jdbc.page_options("jdbc:x", "weather_data", "id", 1, 5000, 5)
    assert got["partitionColumn"] == "id" and got["numPartitions"] == "5"
    assert got["fetchsize"] == "1000"


# ---------------------------------------------------------------------------------- sinks

def test_partitioned_write_prunes_and_spreads(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_partitioned(station_days(spark, 800, ("Mumbai", "Pune")), path)
    table = spark.read.parquet(path)
    assert table.count() == 1600
    one = table.where("city = 'Pune'").select("time")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city" in plan and "ReadSchema: struct<time:timestamp>" in plan


def test_only_the_given_cities_are_replaced(spark, tmp_path):
    path = str(tmp_path / "backup")
    df = station_days(spark, 5, ("Pune", "Surat"))
    sinks.overwrite_touched(df, path, ["city"])
    sinks.overwrite_touched(df.where("city = 'Pune'").limit(2), path, ["city"])
    got = {r["city"]: r["count"] for r in spark.read.parquet(path).groupBy("city").count().collect()}
    assert got == {"Pune": 2, "Surat": 5}


def test_json_records(spark):
    df = spark.sql("SELECT 'x' AS city, timestamp'2024-01-02 00:00:00' AS time, "
                   "double('NaN') AS a, CAST(NULL AS DOUBLE) AS b")
    assert json.loads(sinks.json_records(df).first()[0]) == {
        "city": "x", "time": "2024-01-02T00:00:00.000Z", "a": None, "b": None}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = materialize(spark.range(5), "x")
    assert kept.inputFiles()[0].split("file://")[-1].startswith(shared_dir(spark))


# ------------------------------------------------------------------------------------ ETL

def test_etl_writes_labelled_table(spark, tmp_path):
    station_days(spark, 66, ("Jaipur", "Kochi")).write.option("header", True).csv(str(tmp_path / "raw"))
    for kind in ("parquet", "csv"):
        out = str(tmp_path / kind)
        totals = weather.run_etl(spark, str(tmp_path / "raw"), out, kind).first()
        # of each cycle above 40 for five days, the last three; the first day has no full lags
        assert totals["heatwave_days"] == 2 * 6 * 3
        assert totals["extreme_rain_days"] >= 2
    table = spark.read.parquet(str(tmp_path / "parquet"))
    assert table.count() == 2 * 65
    assert {"temp_max_lag_7", "precipitation_roll_std_7", "wind_speed_10m_max_lag_3", "month_cos",
            "heavy_rainfall", "wind_gust_max"} <= set(table.columns)
    with pytest.raises(ValueError):
        weather.run_etl(spark, str(tmp_path / "raw"), str(tmp_path / "x"), "xml")


def test_targets_are_the_next_days_flags(spark):
    named = weather.with_short_names(station_days(spark, 66, ("Jaipur", "Kochi")))
    wide = weather.weather_features(named, targets=True, drop_unlagged=False)
    got = rows(wide.where("city = 'Kochi'"), "time")
    for a, b in zip(got, got[1:]):
        assert a["heatwave_flag_next"] == b["heatwave_flag"]
        assert a["extreme_rainfall_next"] == b["extreme_rainfall"]
    assert got[-1]["heatwave_flag_next"] is None and got[-1]["extreme_rainfall_next"] is None


def test_short_names_fill_absent_columns(spark):
    got = weather.with_short_names(spark.createDataFrame([("x",)], "city string")).first()
    assert (got["temp_max"], got["precipitation"]) == (None, 0.0)
    assert weather.with_short_names(station_days(spark, 1, ("Pune",))).columns.count("temp_max") == 1
    assert set(SHORT_NAMES) & set(DAILY_VARIABLES) == set(SHORT_NAMES)


def test_preprocess_all_keeps_sources_and_rows(spark, tmp_path):
    station_days(spark, 66, ("Jaipur", "Kochi")).write.option("header", True).csv(str(tmp_path / "raw"))
    (tmp_path / "t.csv").write_text("ISO_TIME,NATURE,LAT,LON,WMO_WIND\n"
                                    "2020-01-02 06:00:00,TS,1.5,80,64\n")
    days, storms = weather.preprocess_all(spark, str(tmp_path / "raw"), str(tmp_path / "t.csv"),
                                          str(tmp_path / "out"))
    assert days.count() == 132 and storms.first()["category"] == 2
    assert {"temperature_2m_max", "temp_max", "precipitation", "cyclonic_flag"} <= set(days.columns)
    assert spark.read.csv(str(tmp_path / "out" / "weather_processed"), header=True).count() == 132
    assert days.agg(F.sum("cyclonic_flag")).first()[0] == 0  # gusts stay below 60
    assert weather.preprocess_all(spark) == (None, None)


# --------------------------------------------------------------------------------- ingest

def land(df, path):
    df.select(*STATION.names).write.option("header", True).csv(path)


def paths(tmp_path):
    return {k: str(tmp_path / k) for k in ("table", "ledger", "quarantine")}


def test_batches_merge_and_close(spark, tmp_path):
    first = station_days(spark, 40, ("Pune",))
    later = (first.where(F.col("time") >= "2021-04-01")
             .withColumn("precipitation_sum", F.lit(1.0)))
    broken = later.limit(1).withColumn("city", F.lit(None).cast("string"))
    land(first, str(tmp_path / "in1"))
    land(later.unionByName(later).unionByName(broken), str(tmp_path / "in2"))
    p = paths(tmp_path)
    run1 = ingest.run_batch(spark, str(tmp_path / "in1"), **p, batch_id=1,
                            started_at="2024-03-01 00:00:00", finished_at="2024-03-01 00:10:00")
    assert [tuple(r) for r in run1.collect()] == [("Pune", "ingested", 40)]
    run2 = ingest.run_batch(spark, str(tmp_path / "in2"), **p, batch_id=2,
                            started_at="2024-03-02 00:00:00", finished_at="2024-03-02 00:10:00")
    assert {(r["status"], r["n_rows"]) for r in run2.collect()} == {("ingested", 18),
                                                                   ("quarantined", 1)}
    table = ingest.read_table(spark, p["table"])
    assert table.count() == 40
    assert table.where("batch_id = '2' AND precipitation_sum = 1.0").count() == 9
    states = rows(ingest.ledger_states(spark, p["ledger"]), "id")
    assert [(r["status"], r["rows_ingested"], r["cities_count"]) for r in states] == [
        ("completed", 40, 1), ("completed", 9, 1)]
    before = rows(table, "time")
    ingest.run_batch(spark, str(tmp_path / "in2"), **p, batch_id=2,
                     started_at="2024-03-02 00:00:00", finished_at="2024-03-02 00:10:00")
    assert spark.read.parquet(p["quarantine"]).count() == 1  # a repeated run replaces its rows
    assert rows(ingest.read_table(spark, p["table"]), "time") == before


def test_untouched_partitions_are_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "table")
    df = ingest.as_observations(station_days(spark, 400, ("Pune", "Surat")), "1",
                                F.lit("2024-03-01").cast("timestamp"))
    ingest.upsert_into(spark, path, df)
    old = set(spark.read.parquet(path).inputFiles())
    ingest.upsert_into(spark, path, df.where("city = 'Pune' AND time < '2021-06-01'"))
    kept = old & set(spark.read.parquet(path).inputFiles())
    assert kept and all("city=Pune/_year=2021" not in f for f in kept)
    assert spark.read.parquet(path).count() == 800


def test_a_tie_goes_to_the_higher_batch_number(spark, tmp_path):
    path = str(tmp_path / "table")
    day = station_days(spark, 1, ("Pune",))
    for batch, rain in (("9", 1.0), ("10", 2.0), ("9", 3.0)):
        ingest.upsert_into(spark, path, ingest.as_observations(
            day.withColumn("precipitation_sum", F.lit(rain)), batch,
            F.lit("2024-03-01").cast("timestamp")))
    assert ingest.read_table(spark, path).first()["batch_id"] == "10"


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "table")
    df = ingest.as_observations(station_days(spark, 400, ("Pune", "Surat")), "1",
                                F.lit("2024-03-01").cast("timestamp"))
    ingest.upsert_into(spark, path, df)
    touched = spark.createDataFrame([("Pune", 2022)], "city string, _year int")
    stored = ingest.stored_partitions(spark.read.parquet(path), touched)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*city[^\]]*Pune[^\]]*_year[^\]]*2022", plan)
    assert stored.count() == 400 - 306


def test_empty_and_failing_batches_close(spark, tmp_path):
    p = paths(tmp_path)
    land(station_days(spark, 1, ("Pune",)).limit(0), str(tmp_path / "empty"))
    (tmp_path / "empty" / "weather.csv").write_text(",".join(STATION.names) + "\n")
    at = dict(started_at="2024-03-01 00:00:00", finished_at="2024-03-01 00:01:00")
    ingest.run_batch(spark, str(tmp_path / "empty"), **p, batch_id=1, **at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest.run_batch(spark, str(tmp_path / "absent"), **p, batch_id=2, **at)
    states = rows(ingest.ledger_states(spark, p["ledger"]), "id")
    assert [(r["status"], r["rows_ingested"]) for r in states] == [("completed", 0), ("failed", 0)]
    assert 0 < len(states[1]["error_message"]) <= 500
    assert health.latest_batches(ingest.ledger_states(spark, p["ledger"])).count() == 2


def test_a_city_that_fails_does_not_stop_the_others(spark, tmp_path):
    p = paths(tmp_path)
    land(station_days(spark, 5, ("Pune",)), str(tmp_path / "pune"))
    got = ingest.run_batch(spark, {"Pune": str(tmp_path / "pune"), "Surat": str(tmp_path / "no")},
                           **p, batch_id=1, started_at="2024-03-01 00:00:00",
                           finished_at="2024-03-01 00:01:00")
    assert {tuple(r) for r in got.collect()} == {("Pune", "ingested", 5), ("Surat", "failed", 0)}
    state = ingest.ledger_states(spark, p["ledger"]).first()
    assert (state["status"], state["cities_count"], state["error_message"]) == (
        "completed", 1, "failed: Surat")


def test_stream_equals_batch_and_takes_files_once(spark, tmp_path):
    path, state, inbox, bad = (str(tmp_path / k) for k in ("table", "state", "inbox", "bad"))
    first, second = (station_days(spark, n, ("Pune",), shift) for n, shift in ((30, 0), (45, 4)))
    land(first, inbox)
    stream_landed(spark, inbox, path, state, bad).awaitTermination()
    assert ingest.read_table(spark, path).count() == 30
    second.select(*STATION.names).write.mode("append").option("header", True).csv(inbox)
    stream_landed(spark, inbox, path, state, bad, max_files=1).awaitTermination()
    merged = ingest.read_table(spark, path)
    assert merged.count() == 45
    total = merged.agg(F.sum("precipitation_sum")).first()[0]
    assert total == pytest.approx(second.agg(F.sum("precipitation_sum")).first()[0])
    odd = "time,city,precipitation_sum\nno day,Pune,3\n2021-08-01,Pune,4\n"
    (tmp_path / "inbox" / "odd.csv").write_text(odd)
    stream_landed(spark, inbox, path, state, bad).awaitTermination()
    assert ingest.read_table(spark, path).count() == 46
    kept = spark.read.parquet(bad).collect()
    assert [(r["city"], r["time"], r["precipitation_sum"]) for r in kept] == [("Pune", None, 3.0)]


# ------------------------------------------------------------------- training and scoring

def tracks(spark, n=600):
    """Storms of twenty fixes whose wind rises and falls; pressure drops with its square."""
    data = []
    for i in range(n):
        storm, step = divmod(i, 20)
        wind = 20.0 + (25 + 13 * storm % 110) * (1 - abs(step - 9.5) / 10)
        lat = 4.0 + storm % 17 + 0.4 * step
        data.append((i, lat, 92.0 - 0.5 * step - storm % 7, lat,
                     1014.0 - (wind / 14) ** 2 + 0.3 * (37 * i % 11 - 5), 40.0 * ((storm + step) % 12),
                     1990 + storm % 30, 1 + storm % 12, 1 + 11 * i % 365, wind))
    df = spark.createDataFrame(
        data, "point_id long, " + ", ".join(
            f"{c} {'int' if c in ('year', 'month', 'dayofyear') else 'double'}"
            for c in CYCLONE_FEATURES) + ", wind_kts double")
    from isobar.functions.events import cyclone_category
    return df.withColumn("category", cyclone_category(F.col("wind_kts")))


SMALL = {"n_estimators": 5, "max_depth": 4}


def test_train_score_and_reload(spark, tmp_path):
    model, table = training.train(tracks(spark), "cyclone", "r1", **SMALL)
    got = {(r["split"], r["metric"]): r["value"] for r in table.collect()}
    assert len(got) == 14 and got["test", "accuracy"] > 0.6 and got["test", "roc_auc"] > 0.8
    ranked = training.importances(model, CYCLONE_FEATURES).orderBy("rank").collect()
    assert len(ranked) == 8 and ranked[0]["feature"] == "pressure_min"
    training.save(model, str(tmp_path / "m"))
    again = training.load(str(tmp_path / "m"))
    scored, bad = scoring.score(again, tracks(spark, 50), "cyclone")
    assert scored.count() + bad.count() == 50
    first = scored.first()
    assert sum(first["probabilities"].values()) == pytest.approx(1)
    assert first["confidence"] == max(first["probabilities"].values())
    log = scoring.to_prediction_log(scored, "cyclone", F.lit("2024-01-01"))
    path = str(tmp_path / "log")
    sinks.append(log, path)
    sinks.append(log, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 * scored.count()
    assert set(back.first()["features"]) == set(CYCLONE_FEATURES) and "id" in back.columns


def test_heatwave_model_beats_chance(spark):
    named = weather.with_short_names(station_days(spark, 200, ("Jaipur", "Kochi", "Pune")))
    processed = materialize(weather.weather_features(named, targets=True), "p")
    model, table = training.train(processed, "heatwave", "r1", n_estimators=3, max_depth=3)
    got = {(r["split"], r["metric"]): r["value"] for r in table.collect()}
    assert got["train", "roc_auc"] > 0.7
    scored, quarantine = scoring.score(model, processed, "heatwave")
    assert scored.count() > 0
    assert set(scored.columns) >= {"severity", "is_heatwave", "confidence"}


def test_train_all(spark):
    models, table = training.train_all({"cyclone": tracks(spark, 200)}, "r2", {"cyclone": SMALL})
    assert set(models) == {"cyclone"} and {r["run_id"] for r in table.collect()} == {"r2"}


def test_fit_needs_every_feature_and_known_parameters(spark):
    matrix = tracks(spark, 50).withColumn("label", F.col("category"))
    with pytest.raises(ValueError, match="pressure_min"):
        training.fit(matrix.drop("pressure_min"), "cyclone")
    with pytest.raises(ValueError, match="colsample"):
        training.build_estimator("cyclone", colsample=1)


def test_default_settings_and_draws():
    assert training.DEFAULTS["heatwave"]["n_estimators"] == 150
    one, two = (training.draw(training.SPACES["heatwave"], 20) for _ in range(2))
    assert one == two and len(one) == 20
    assert all(3 <= s["max_depth"] <= 10 and s["n_estimators"] % 50 == 0
               and 0.01 <= s["learning_rate"] <= 0.3 for s in one)


def test_tuning_picks_the_best_trial(spark):
    matrix = tracks(spark, 300).withColumn("label", F.col("category"))
    best, trials = training.tune(matrix, "cyclone", trials=2, folds=2,
                                 space={"max_depth": (2, 4, 1), "n_estimators": (2, 4, 2)})
    top = max(trials.collect(), key=lambda r: r["score"])
    assert top["settings"]["max_depth"] == best["max_depth"]


def test_heatwave_contract_excludes_same_day_temperature():
    assert not {"temp_max", "temp_min", "precipitation"} & set(HEATWAVE_FEATURES)
