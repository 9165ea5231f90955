from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from isobar.operators import lookup, ranking
from isobar.operators.labels import label_rainfall
from isobar.operators.matrices import impute_median

QS = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


@pytest.fixture
def bracketed(monkeypatch):
    """Coarse sketches and no small-group shortcut, so that brackets and gaps are used."""
    monkeypatch.setattr(ranking, "ACCURACY", 200)
    monkeypatch.setattr(ranking, "MARGIN", 4.0 / 200)
    monkeypatch.setattr(ranking, "FULL_GROUP", 200)


def groups(seed=5):
    rng = random.Random(seed)
    data = {"hot": [rng.gauss(0, 1) for _ in range(6000)],
            "ties": [float(rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(3000)],
            "tail": [rng.paretovariate(0.5) for _ in range(2000)],
            "few": [1.0, 2.0, 3.0, 10.0], "one": [7.0]}
    return data


@pytest.mark.parametrize("coarse", [False, True])
def test_quantiles_equal_numpy(spark, request, coarse):
    if coarse:
        request.getfixturevalue("bracketed")
    data = groups()
    flat = [(g, i, v) for g, vs in data.items() for i, v in enumerate(vs)]
    flat += [("hot", -1, None), ("hot", -2, float("nan")), ("void", 0, None)]
    df = spark.createDataFrame(flat, "g string, i long, v double")
    got = {r["g"]: r for r in ranking.group_quantiles(df, "v", QS, ["g"], spread=["i"]).collect()}
    assert set(got) == set(data)
    for g, values in data.items():
        for name, q in QS.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12), (g, name)


def test_brackets_keep_few_candidates(spark, bracketed):
    df = spark.range(20_000).select(F.lit("x").alias("g"), "id", F.rand(3).alias("v"))
    brackets = df.groupBy("g").agg(ranking._bracket("v", [0.95]).alias("_b"))
    joined = lookup.lookup_join(df, brackets, ["g"])
    assert ranking._compress(joined, ["g"], "v", 1).count() < 20_000 * 0.08


def test_approx_returns_an_element(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, 10.0)], "g string, v double")
    exact = ranking.group_quantiles(df, "v", {"p": 0.95}, ["g"]).first()["p"]
    approx = ranking.group_quantiles(df, "v", {"p": 0.95}, ["g"], method="approx").first()["p"]
    assert (round(exact, 6), approx) == (8.95, 10.0)
    with pytest.raises(ValueError):
        ranking.group_quantiles(df, "v", {"p": 0.95}, ["g"], method="other")


def test_column_quantiles(spark, bracketed):
    rng = random.Random(1)
    data = [(rng.gauss(5, 2), None if rng.random() < 0.3 else float(rng.randint(0, 3)), None)
            for _ in range(3000)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {r["feature"]: r["value"] for r in
           ranking.column_quantiles(df, ["a", "b", "c"], 0.5).collect()}
    assert got == {"a": pytest.approx(np.median([r[0] for r in data])),
                   "b": np.median([r[1] for r in data if r[1] is not None])}


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_lookup_join_keeps_every_row(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    left = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    got = lookup.lookup_join(left, right, ["k"])
    assert got.count() == 500 and got.where("name IS NULL").count() == 166


def test_cumulative_equals_one_window(spark):
    df = spark.createDataFrame([("g", v // 10, v, v + 1) for v in range(95)],
                               "g string, s int, v int, n long")
    got = rows(ranking.cumulative(df, ["g"], "s", [F.col("v")], {"c": "n"}), "v")
    assert [r["c"] for r in got] == list(np.cumsum(range(1, 96)))


def test_infinite_values_and_ranges(spark):
    values = [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]
    df = spark.createDataFrame([("x", v) for v in values], "g string, v double")
    got = ranking.group_quantiles(df, "v", {"lo": 0.25, "hi": 0.9}, ["g"]).first()
    assert (got["lo"], got["hi"]) == (1.0, float("inf"))


def test_ranges_stay_small_as_rows_grow(spark):
    for n in (2_000, 20_000):
        df = spark.range(n).selectExpr("id % 7 AS g", "cast(id * 37 % 1009 + id / 1e6 AS double) AS v")
        sizes = ranking.by_ranges(df, ["g", "v"], 500).groupBy("_slice").count().collect()
        assert len(sizes) >= n // 1_000 and max(r["count"] for r in sizes) < 2_000


def test_impute_median(spark):
    df = spark.createDataFrame([(1.0, None, None, 1), (None, None, None, None), (4.0, None, 8.0, 3)],
                               "a double, b double, c double, n int")
    got = rows(impute_median(df, ["a", "b", "c", "n"]), "c", "a")
    assert [(r["a"], r["b"], r["c"], r["n"]) for r in got] == [
        (1.0, 0.0, 8.0, 1.0), (2.5, 0.0, 8.0, 2.0), (4.0, 0.0, 8.0, 3.0)]
    kept = impute_median(df, ["a", "b", "n"], all_null_value=None, float_only=True).collect()
    assert all(r["b"] is None for r in kept) and any(r["n"] is None for r in kept)


def test_large_lookups_are_shuffled(spark, monkeypatch, bracketed):
    from isobar.plans.weather import label_events

    rng = random.Random(9)
    data = [("hot" if i % 3 else f"c{i % 7}", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00",
             rng.uniform(30, 50), rng.expovariate(1)) for i in range(1200)]
    df = spark.createDataFrame(data, "city string, t string, temp_max double, precipitation double")
    df = df.withColumn("time", F.col("t").cast("timestamp"))

    def flags():
        alone = rows(label_rainfall(df), "time")
        shared = rows(label_events(df, unit="hour"), "time")
        return [[r[c] for r in f] for f in (alone, shared)
                for c in ("extreme_rainfall", "heavy_rainfall")]

    small = flags()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    assert flags() == small
    assert small[0] == small[2] and sum(small[0]) > 40
