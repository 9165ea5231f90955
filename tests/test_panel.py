from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from conftest import panel, rows
from pyspark.sql import functions as F

from isobar.functions.columns import date_grid, seasonal_features, year_chunks
from isobar.operators.chunks import with_chunk
from isobar.operators.explore import monthly_trend
from isobar.operators.health import gaps
from isobar.operators.labels import (label_cyclonic, label_heatwave, label_rainfall)
from isobar.operators.panel import lag_features, lead_target, rolling_stats, streak_length

GOLDEN = [41, 42, 43, 40, 46, 46, 46, 46, None]


def random_series(seed=3):
    """Cities with very different lengths, sparse days and missing values."""
    rng = random.Random(seed)
    out = []
    for city, n, share in (("a", 900, 0.9), ("b", 40, 0.02), ("c", 1, 1.0), ("d", 400, 0.3)):
        day = dt.date(2019, 11, 1)
        for _ in range(n):
            day += dt.timedelta(days=1 + (rng.random() > share) * rng.randint(0, 300))
            value = None if rng.random() < 0.1 else float(rng.randint(30, 50))
            out.append((city, day, value))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def series(spark):
    data = random_series()
    return (spark.createDataFrame(data, "city string, time date, v double"),
            pd.DataFrame(data, columns=["city", "time", "v"]).sort_values(["city", "time"]))


def as_pandas(df, *cols):
    return df.select("city", "time", *cols).toPandas().sort_values(["city", "time"])


def test_streak_golden(spark):
    df = panel(spark, {"x": GOLDEN})
    got = rows(streak_length(df, F.col("temp_max") > 40), "time")
    assert [r["streak"] for r in got] == [1, 2, 3, 0, 1, 2, 3, 4, 0]


def test_heatwave_golden_across_a_year_end(spark):
    df = panel(spark, {"x": GOLDEN}, start="2023-12-28")
    got = rows(label_heatwave(df), "time")
    assert [r["heatwave_flag"] for r in got] == [0, 0, 1, 0, 0, 0, 1, 1, 0]
    assert [r["severe_heatwave_flag"] for r in got] == [0, 0, 0, 0, 0, 0, 1, 1, 0]


def test_next_day_golden(spark):
    df = label_heatwave(panel(spark, {"x": GOLDEN}))
    got = rows(lead_target(df, "heatwave_flag"), "time")
    assert [r["label"] for r in got] == [0, 1, 0, 0, 0, 1, 1, 0]


def test_rolling_golden(spark):
    df = panel(spark, {"x": [10, 20, None, 40]})
    prior = rows(rolling_stats(df, ["temp_max"], [3]), "time")
    assert [r["temp_max_roll_mean_3"] for r in prior] == [None, 10, 15, 15]
    assert [round(r["temp_max_roll_std_3"], 6) for r in prior] == [0, 0, 7.071068, 7.071068]
    current = rows(rolling_stats(df, ["temp_max"], [3], include_current=True), "time")
    assert [r["temp_max_roll_mean_3"] for r in current] == [10, 15, 15, 30]
    assert [round(r["temp_max_roll_std_3"], 6) for r in current] == [0, 7.071068, 7.071068,
                                                                    14.142136]


@pytest.mark.parametrize("unit", ["year", "month", "day"])
def test_lags_equal_pandas_for_any_chunk(series, unit):
    df, want = series
    got = as_pandas(lag_features(df, ["v"], unit=unit), *[f"v_lag_{k}" for k in (1, 3, 7)])
    for k in (1, 3, 7):
        shifted = want.groupby("city")["v"].shift(k).to_numpy(dtype=float)
        np.testing.assert_allclose(got[f"v_lag_{k}"].to_numpy(dtype=float), shifted)


@pytest.mark.parametrize("unit", ["year", "day"])
def test_rolling_equals_pandas(series, unit):
    df, want = series
    got = as_pandas(rolling_stats(df, ["v"], unit=unit),
                    *[f"v_roll_{s}_{w}" for s in ("mean", "std") for w in (3, 7)])
    prior = want.groupby("city")["v"].shift(1)
    for w in (3, 7):
        grouped = prior.groupby(want["city"])
        mean = grouped.transform(lambda s, w=w: s.rolling(w, min_periods=1).mean())
        std = grouped.transform(lambda s, w=w: s.rolling(w, min_periods=1).std()).fillna(0)
        np.testing.assert_allclose(got[f"v_roll_mean_{w}"].to_numpy(dtype=float), mean)
        np.testing.assert_allclose(got[f"v_roll_std_{w}"].to_numpy(dtype=float), std, atol=1e-9)


@pytest.mark.parametrize("gap_breaks", [False, True])
@pytest.mark.parametrize("unit", ["year", "month", "day"])
def test_streaks_equal_brute_force(series, unit, gap_breaks):
    df, want = series
    got = as_pandas(streak_length(df, F.col("v") > 33, gap_breaks=gap_breaks, unit=unit), "streak")
    expected, last, run = [], None, 0
    for city, day, value in want.itertuples(index=False):
        apart = last is None or last[0] != city or (gap_breaks and (day - last[1]).days > 1)
        run = 0 if not value > 33 else (1 if apart else run + 1)
        expected.append(run)
        last = (city, day)
    assert got["streak"].tolist() == expected


def test_a_run_may_span_many_chunks(spark):
    df = panel(spark, {"x": [50] * 800}, start="2020-05-01")
    got = rows(streak_length(df, F.col("temp_max") > 40, unit="month"), "time")
    assert [r["streak"] for r in got] == list(range(1, 801))


def test_features_ignore_present_and_future(spark):
    base = [float(x) for x in range(30, 60)]
    changed = base[:20] + [v + 100 for v in base[20:]]
    a, b = (rows(rolling_stats(lag_features(panel(spark, {"x": s}), ["temp_max"]), ["temp_max"]),
                 "time") for s in (base, changed))
    features = [c for c in a[0] if "_lag_" in c or "_roll_" in c]
    assert [[r[c] for c in features] for r in a[:21]] == [[r[c] for c in features] for r in b[:21]]


def test_result_does_not_depend_on_partitioning(series):
    df, _ = series
    a = as_pandas(label_heatwave(df.withColumnRenamed("v", "temp_max")), "heatwave_flag")
    b = as_pandas(label_heatwave(df.withColumnRenamed("v", "temp_max").repartition(13)),
                  "heatwave_flag")
    assert a.equals(b.set_axis(a.index))


def test_missing_columns_raise_unless_skipped(spark):
    df = panel(spark, {"x": [1, 2]})
    with pytest.raises(ValueError, match="nope"):
        lag_features(df, ["nope"])
    assert lag_features(df, ["temp_max", "nope"], skip_missing=True).count() == 2


def test_rainfall_is_relative_to_the_city(spark):
    df = panel(spark, {"wet": range(100, 200), "dry": range(0, 100), "none": [None] * 5},
               col="precipitation")
    got = rows(label_rainfall(df).groupBy("city").agg(
        F.sum("extreme_rainfall").alias("e"), F.sum("heavy_rainfall").alias("h")), "city")
    assert [(r["city"], r["e"], r["h"]) for r in got] == [
        ("dry", 5, 1), ("none", 0, 0), ("wet", 5, 1)]


def test_cyclonic_needs_both_columns_and_fills_nulls(spark):
    df = spark.createDataFrame([(61.0, 1004.0), (60.0, 1004.0), (61.0, 1005.0), (None, 1000.0),
                                (99.0, None), (float("nan"), 1000.0)],
                               "wind_gust_max double, pressure_msl_mean double")
    assert [r[2] for r in label_cyclonic(df).collect()] == [1, 0, 0, 0, 0, 0]
    assert {r["cyclonic_flag"] for r in label_cyclonic(df.drop("pressure_msl_mean")).collect()} == {0}


def test_monthly_trend_needs_twelve_months(spark):
    df = panel(spark, {"x": [float(i % 7) for i in range(400)]}, start="2020-01-01")
    got = rows(monthly_trend(df, "temp_max"), "month")
    assert [r["annual_mean"] is None for r in got] == [True] * 11 + [False] * 3


def test_gaps_and_grid(spark):
    df = panel(spark, {"x": [1, 1, 1]}, start="2020-12-30", step="2D")
    assert [(str(r["gap_start"]), str(r["gap_end"]), r["missing_days"])
            for r in rows(gaps(df), "gap_start")] == [
        ("2020-12-31", "2020-12-31", 1), ("2021-01-02", "2021-01-02", 1)]
    spans = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 4)),
                                   (dt.date(2020, 1, 1), dt.date(2020, 1, 1))], "a date, b date")
    assert [str(r["time"]) for r in rows(date_grid(spans, "a", "b"), "time")] == [
        "2020-01-01", "2020-01-02", "2020-01-03"]


def test_year_chunks(spark):
    def chunks(a, b):
        df = spark.createDataFrame([(dt.date.fromisoformat(a), dt.date.fromisoformat(b))],
                                   "s date, e date")
        return [(str(r["chunk_start"]), str(r["chunk_end"]))
                for r in rows(year_chunks(df, "s", "e"), "chunk_start")]

    assert chunks("2010-06-01", "2012-03-01") == [
        ("2010-06-01", "2010-12-31"), ("2011-01-01", "2011-12-31"), ("2012-01-01", "2012-03-01")]
    assert chunks("2010-06-01", "2010-06-01") == [("2010-06-01", "2010-06-01")]
    assert chunks("2010-06-01", "2011-01-01")[-1] == ("2011-01-01", "2011-01-01")
    assert chunks("2011-01-02", "2011-01-01") == []


def test_season_in_local_time(spark):
    df = spark.sql("SELECT timestamp'2020-01-31 18:30:00' AS time")
    assert seasonal_features(df).first()["month"] == 1
    assert seasonal_features(df, tz="Asia/Kolkata").first()["month"] == 2


def test_one_heavy_shuffle_for_windows(spark):
    """The panel is shuffled by (entity, chunk) and nothing is windowed by entity alone."""
    df = panel(spark, {"x": range(50)})
    plan = label_heatwave(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(city" in plan and "_chunk" in plan
    windows = [line for line in plan.splitlines() if "windowspecdefinition(city" in line
               and "collect_list" not in line]
    assert windows and all("_chunk" in line for line in windows)
    above_union = plan[:plan.index("Union")]
    assert "Exchange" not in above_union


def test_chunks_bound_the_group(spark):
    df = panel(spark, {"hot": [1] * 1500})
    sizes = with_chunk(df).groupBy("city", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 366
