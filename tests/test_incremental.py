"""The feature store after updates against the full job over the same rows."""

from __future__ import annotations

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from isobar.operators.panel import streak_length
from isobar.plans import incremental, weather
from conftest import rows

COLUMNS = "city string, time date, temp_max double, temp_min double, precipitation double, " \
          "wind_speed_10m_max double, wind_gust_max double, pressure_msl_mean double"


def days(seed, cities, first, n, share=1.0):
    rng = random.Random(seed)
    out = []
    for c in cities:
        for k in range(n):
            if rng.random() < share:
                hot = rng.choice([30.0, 41.0, 41.0, 46.0, None]) if k % 400 < 380 else 42.0
                out.append((c, first + dt.timedelta(days=k), hot, 20.0 + k % 7,
                            rng.choice([None, 0.0, 0.0, 1.5, rng.randrange(900) / 10]),
                            float(k % 11), rng.uniform(20, 90), rng.uniform(990, 1020)))
    return out


def latest(batches):
    merged = {}
    for batch in batches:
        merged.update({(r[0], r[1]): r for r in batch})
    return list(merged.values())


def same(spark, store, batches, targets):
    everything = spark.createDataFrame(latest(batches), COLUMNS)
    got = incremental.read_features(spark, store)
    want = weather.weather_features(everything, targets=targets)
    want = want.join(streak_length(everything, F.col("temp_max") > 40.0, "hot_streak")
                     .select("city", "time", "hot_streak"), ["city", "time"])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    numbers = [c for c, t in want.dtypes if t == "double"]
    got, want = (rows(x.select(*columns).withColumns({c: F.round(c, 9) for c in numbers}),
                      "city", "time") for x in (got, want))
    assert got == want


@pytest.mark.parametrize("targets", [True, False])
def test_store_equals_the_full_job_after_every_update(spark, tmp_path, targets):
    first = dt.date(2018, 11, 1)
    history = days(1, ["Agra", "Pune"], first, 1_200, 0.9)
    sparse = [r for k, r in enumerate(days(2, ["Leh"], first, 2_000)) if k % 90 == 0]  # few a year
    batches = [history + sparse]
    rng = random.Random(3)
    corrected = [(c, t, 47.0, *rest) for c, t, _, *rest in rng.sample(history, 5)]
    batches.append(days(4, ["Agra"], dt.date(2020, 12, 25), 14) + corrected)      # over a border
    batches.append([r for r in days(5, ["Leh", "Kochi"], dt.date(2019, 3, 1), 3)])  # a new station
    batches.append(days(6, ["Pune"], dt.date(2025, 1, 1), 2))                     # after a gap
    for no, batch in enumerate(batches):
        df = spark.createDataFrame(batch, COLUMNS)
        incremental.update_features(spark, str(tmp_path), df, no, targets=targets)
        if no % 2:
            incremental.update_features(spark, str(tmp_path), df, no, targets=targets)  # repeated
            same(spark, str(tmp_path), batches[:no + 1], targets)


def test_untouched_partitions_are_not_read(spark, tmp_path):
    history = days(7, ["Agra", "Pune"], dt.date(2015, 1, 1), 2_900)
    incremental.update_features(spark, str(tmp_path), spark.createDataFrame(history, COLUMNS), 0)

    def files(table):
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path / table) for f in names
                if f.endswith(".parquet")}

    before = files("features")
    for path in ("rows/city=Pune", "rows/city=Agra/_year=2015", "rows/city=Agra/_year=2021"):
        shutil.rmtree(tmp_path / path)  # reading one of these would lose its rows
    late = spark.createDataFrame(days(8, ["Agra"], dt.date(2018, 12, 29), 3), COLUMNS)
    again = incremental.update_features(spark, str(tmp_path), late, 1)
    # The last day of 2017 has its target in 2018, the first ones of 2019 their lags.
    assert {tuple(r) for r in again.collect()} == {("Agra", y) for y in (2017, 2018, 2019)}
    kept = {f for f in before if not any(f"Agra/_year={y}" in f for y in (2017, 2018, 2019))}
    assert kept < before and kept <= files("features")
    assert incremental.read_features(spark, str(tmp_path)).count() == len(history) - 2  # first days


def test_reach_counts_rows_not_days(spark):
    summary = spark.createDataFrame(
        [("a", y, n) for y, n in ((2010, 9), (2011, 2), (2012, 3), (2013, 1), (2014, 50), (2015, 9))],
        "city string, _year int, n_rows bigint")
    got = incremental.reached(summary, F.col("_year") == 2011, 7, 1, "city")
    assert sorted(r["_year"] for r in got.collect()) == [2010, 2011, 2012, 2013, 2014]
    got = incremental.reached(summary, F.col("_year") == 2015, 7, 12, "city")
    assert sorted(r["_year"] for r in got.collect()) == [2014, 2015]


def test_rows_without_keys_and_empty_updates(spark, tmp_path):
    none = spark.createDataFrame([(None, dt.date(2020, 1, 1), *[1.0] * 6), ("x", None, *[1.0] * 6)],
                                 COLUMNS)
    assert incremental.update_features(spark, str(tmp_path), none, 0).count() == 0
    batch = days(9, ["Agra"], dt.date(2020, 1, 1), 20)
    incremental.update_features(spark, str(tmp_path), spark.createDataFrame(batch, COLUMNS), 0)
    incremental.update_features(spark, str(tmp_path), none, 1)
    same(spark, str(tmp_path), [batch], True)
