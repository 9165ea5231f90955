from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from isobar.functions.ks import asymptotic_p, exact_p_value, p_value
from isobar.operators import drift, health, matrices, metrics, weights


def test_class_weights_golden(spark):
    df = spark.createDataFrame([(x,) for x in (0, 0, 0, 1, 1, 2)], "label int")
    got = rows(weights.class_weights(df), "label")
    assert [round(r["weight"], 6) for r in got] == [0.666667, 1.0, 2.0]
    one = weights.class_weights(df.where("label = 0")).first()
    assert (one["label"], one["weight"]) == (0, 1.0)
    assert weights.with_balanced_weight(df).agg(F.sum("weight")).first()[0] == pytest.approx(6)


def test_pos_weight(spark):
    df = spark.createDataFrame([(0,)] * 7 + [(1,)] * 2, "label int")
    got = weights.pos_weight(df).first()
    assert (got["n_neg"], got["n_pos"], got["scale_pos_weight"]) == (7, 2, 3)
    assert weights.pos_weight(df.where("label = 0")).first()["scale_pos_weight"] == 7
    assert weights.with_pos_weight(df).agg(F.sum("weight")).first()[0] == 13


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in weights.standardize(df, ["a", "b"]).orderBy("a").collect()] == [
        (-1.0, 0.0), (1.0, 0.0)]


def labelled(n=4000, seed=2):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(n)]


def brute_auc(data):
    pos = np.array([s for y, s in data if y])
    neg = np.array([s for y, s in data if not y])
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


@pytest.mark.parametrize("size", [5, 40, 200_000])
def test_auc_equals_all_pairs(spark, size):
    data = labelled()
    df = spark.createDataFrame(data, "label int, score double")
    assert metrics.roc_auc(df, range_rows=size).first()["roc_auc"] == pytest.approx(brute_auc(data))


def test_auc_of_one_class_is_half(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.5


def test_classification_metrics_with_an_unseen_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    by_class = {r["class"]: r for r in metrics.per_class_metrics(df).collect()}
    assert (by_class[2]["precision"], by_class[2]["recall"], by_class[2]["f1"]) == (0, 0, 0)
    got = metrics.classification_metrics(df).first()
    assert got["accuracy"] == 0.5 and got["recall"] == 0.5
    assert got["precision"] == pytest.approx((2 * 1 + 1 / 3) / 4)
    wide = rows(metrics.confusion_matrix(df, range(3)), "label")
    assert [(r["p0"], r["p1"], r["p2"]) for r in wide] == [(1, 1, 0), (0, 1, 0), (0, 1, 0)]


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.5)], "label int, score double")
    want = (-math.log(2.220446049250313e-16) + math.log(2)) / 2
    assert metrics.log_loss(df).first()["log_loss"] == pytest.approx(want)


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.range(3000).select(F.col("id").alias("city"), F.col("id").alias("time"),
                                  (F.col("id") % 7 == 0).cast("int").alias("label"))
    train, test = matrices.stratified_split(df)
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    got = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    assert got == {k: round(0.2 * v) for k, v in n.items()}
    assert train.count() + test.count() == 3000
    again = matrices.stratified_split(df.repartition(9))[1]
    assert {r["city"] for r in test.collect()} == {r["city"] for r in again.collect()}
    other = matrices.stratified_split(df, seed=7)[1]
    assert {r["city"] for r in test.collect()} != {r["city"] for r in other.collect()}


def test_missing_labels_are_a_class(spark):
    df = spark.createDataFrame([(str(i), "2024-01-01", None if i % 2 else 1) for i in range(100)],
                               "city string, time string, label int")
    got = matrices.split_test(df).groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("n"))
    assert {r["label"]: r["n"] for r in got.collect()} == {1: 10, None: 10}


def test_temporal_split(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i // 2),) for i in range(20)]
    train, test = matrices.temporal_split(spark.createDataFrame(days, "time date"))
    assert (train.count(), test.count()) == (16, 4)
    assert train.agg(F.max("time")).first()[0] < test.agg(F.min("time")).first()[0]


# ---------------------------------------------------------------------------------- drift

def long_rows(spark, ref, cur, feature="f"):
    data = [("m", feature, "reference", v) for v in ref] + [("m", feature, "current", v) for v in cur]
    return spark.createDataFrame(
        [r if r[3] is None else (*r[:3], float(r[3])) for r in data],
        "model_name string, feature string, side string, value double").where("value IS NOT NULL")


def brute_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, at, "right") / len(a)
                  - np.searchsorted(b, at, "right") / len(b)).max()


@pytest.mark.parametrize("size", [60, 200_000])
def test_ks_statistic(spark, size):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 1500).round(2), rng.normal(0.2, 1, 700).round(2)
    got = drift.ks_two_sample(long_rows(spark, a, b), range_rows=size).first()
    assert got["statistic"] == pytest.approx(brute_ks(a, b))
    assert (got["n_ref"], got["n_cur"]) == (1500, 700)


def test_ks_extremes(spark):
    apart = drift.compute_drift(long_rows(spark, range(1, 11), range(11, 21)), "exact").first()
    assert apart["statistic"] == 1.0 and apart["drifted"]
    assert apart["p_value"] == pytest.approx(2 / math.comb(20, 10))
    same = drift.compute_drift(long_rows(spark, range(1, 11), range(1, 11)), "exact").first()
    assert (same["statistic"], same["p_value"], same["drifted"]) == (0.0, 1.0, False)


def test_small_samples_and_nulls_are_skipped(spark):
    assert drift.ks_two_sample(long_rows(spark, range(9), range(20))).count() == 0
    padded = long_rows(spark, [*range(9), None, None, None], range(20))
    assert drift.ks_two_sample(padded).count() == 0


def brute_p(d, n, m):
    """Share of all orderings of the pooled sample whose distance reaches ``d``."""
    from itertools import combinations
    hits = total = 0
    for first in combinations(range(n + m), n):
        chosen, i, worst = set(first), 0, 0.0
        for k in range(n + m):
            i += k in chosen
            worst = max(worst, abs(i / n - (k + 1 - i) / m))
        hits += worst >= d - 1e-12
        total += 1
    return hits / total


@pytest.mark.parametrize("n,m,d", [(4, 4, 0.5), (5, 3, 0.6), (6, 4, 7 / 12), (3, 7, 1.0)])
def test_exact_p_value(n, m, d):
    assert exact_p_value(d, n, m) == pytest.approx(brute_p(d, n, m))


def test_asymptotic_p_value(spark):
    df = spark.createDataFrame([(0.136, 200, 200), (0.0, 50, 50), (1.0, 500, 500)],
                               "d double, n long, m long")
    got = [r[0] for r in df.select(asymptotic_p(F.col("d"), F.col("n"), F.col("m"))).collect()]
    assert got[0] == pytest.approx(0.0495, abs=5e-4)  # 1.36 is the 5 % point of the limit
    assert got[1] == 1.0 and got[2] == pytest.approx(0, abs=1e-12)
    exact = exact_p_value(0.136, 200, 200)
    assert abs(exact - got[0]) < 0.01


def test_the_method_is_a_choice(spark):
    df = spark.createDataFrame([(0.3, 40, 50)], "d double, n long, m long")
    args = (F.col("d"), F.col("n"), F.col("m"))
    exact, limit = df.select(p_value(*args, "exact"), p_value(*args, "asymptotic")).first()
    assert exact == pytest.approx(exact_p_value(0.3, 40, 50)) and exact != limit
    with pytest.raises(ValueError):
        p_value(*args, "other")


def test_null_models_are_tested(spark):
    named = long_rows(spark, range(30), range(5, 40))
    both = named.unionByName(named.withColumn("model_name", F.lit(None).cast("string")))
    got = {r["model_name"]: r["statistic"] for r in drift.compute_drift(both, "exact").collect()}
    assert len(got) == 2 and len(set(got.values())) == 1


@pytest.mark.parametrize("labels,area", [([0, 1, 2, 2], None), ([0, 1, 1], 1.0), ([2, 2], 0.5)])
def test_ovr_area_of_absent_classes(spark, labels, area):
    data = [(y, [0.1, 0.2 + 0.1 * y, 0.3 * (y == 2)]) for y in labels]
    df = spark.createDataFrame(data, "label int, p array<double>")
    got = metrics.roc_auc_ovr(df, "label", "p", 3).first()["roc_auc"]
    mean = metrics.roc_auc_by_class(df, "label", "p", 3).agg(F.avg("roc_auc")).first()[0]
    assert got == (mean if area is None else area)


def test_report_on_the_own_log(spark):
    rng = np.random.default_rng(7)
    data = [(i % 10, "m", f"2024-01-{1 + i // 10:02d} 00:00:00",
             None if i % 6 == 5 else {"a": float(rng.normal(9 if i >= 60 else 0, 1)), "b": 1.0 * i})
            for i in range(90)] + [(1, "n", "2024-01-01 00:00:00", {"a": 1.0})]
    log = spark.createDataFrame(data, "id long, model_name string, timestamp string, "
                                      "features map<string,double>")
    got = {r["model_name"]: r for r in drift.drift_report(
        log, order=("timestamp", "id"), as_of=F.lit("2024-05-01")).collect()}
    m, n = got["m"], got["n"]
    assert (m["samples"], m["total_features"], m["drifted_features"], m["alert"]) == (90, 2, 2, True)
    assert m["message"] is None and str(m["timestamp"]) == "2024-05-01 00:00:00"
    assert n["status"] == "insufficient_data" and n["message"].endswith("found 1")
    side = drift.window_split(log, order=("timestamp", "id"), usable=F.col("features").isNotNull())
    assert {r["side"]: r["count"] for r in side.where("model_name = 'm'").groupBy("side").count()
            .collect()} == {"reference": 50, "current": 25, None: 15}


def log_of(spark, n, model="m", shift=0.0):
    rng = np.random.default_rng(1)
    cut = n * 2 // 3
    data = [(i, model, float(rng.normal(shift if i >= cut else 0, 1)), float(rng.normal()))
            for i in range(n)]
    return spark.createDataFrame(data, "id long, model_name string, f_value double, f_k double")


def test_window_split(spark):
    log = log_of(spark, 1000).unionByName(log_of(spark, 30, "small"))
    split = drift.window_split(log)
    got = {(r["model_name"], r["side"]): (r["n"], r["lo"], r["hi"]) for r in split.groupBy(
        "model_name", "side").agg(F.count("*").alias("n"), F.min("id").alias("lo"),
                                  F.max("id").alias("hi")).collect()}
    assert got == {("m", "reference"): (333, 500, 832), ("m", "current"): (167, 833, 999),
                   ("small", "reference"): (20, 0, 19), ("small", "current"): (10, 20, 29)}
    newest = drift.window_split(log, parity_order=True).where("model_name = 'small'")
    assert newest.where("side = 'reference'").agg(F.min("id")).first()[0] == 10


def test_report(spark):
    log = (log_of(spark, 300, "moved", shift=5).unionByName(log_of(spark, 300, "still"))
           .unionByName(log_of(spark, 19, "young")))
    got = {r["model_name"]: r for r in drift.drift_report(log, ["f_value", "f_k"]).collect()}
    moved, young = got["moved"], got["young"]
    assert (moved["total_features"], moved["drifted_features"], moved["drift_score"],
            moved["alert"]) == (2, 1, 0.5, False)
    assert [f["feature"] for f in moved["features"]] == ["f_k", "f_value"]
    assert got["still"]["drifted_features"] == 0
    assert (young["status"], young["samples"], young["features"], young["alert"],
            young["drift_score"]) == ("insufficient_data", 19, [], False, 0.0)


@pytest.mark.parametrize("tested,needed", [(1, 2), (4, 2), (8, 2), (9, 3), (14, 4)])
def test_alert_rule(spark, tested, needed):
    rng = np.random.default_rng(4)
    n, names = 60, [f"f{i}" for i in range(tested)]
    moved = min(needed, tested)
    data = []
    for i in range(n):
        late = i >= 40
        data.append((i, "m", *[float(rng.normal(9 if late and j < moved else 0, 0.1))
                               if j < moved else float((i * 7) % 20) for j in range(tested)]))
    log = spark.createDataFrame(data, "id long, model_name string, "
                                + ", ".join(f"{c} double" for c in names))
    got = drift.drift_report(log, names).first()
    assert got["drifted_features"] == moved
    assert got["alert"] == (moved >= needed)


def test_parse_features(spark):
    df = spark.createDataFrame([(1, "m", '{"a": 1, "b": 2.5}'), (2, "m", "not json")],
                               "id long, model_name string, features_json string")
    assert [tuple(r) for r in drift.parse_features(df).orderBy("feature").collect()] == [
        (1, "m", "a", 1.0), (1, "m", "b", 2.5)]


# --------------------------------------------------------------------------------- health

def test_freshness_golden(spark):
    as_of = dt.date(2024, 1, 20)
    data = [(f"c{age}", as_of - dt.timedelta(days=age)) for age in (2, 3, 7, 8)]
    df = spark.createDataFrame(data, "city string, time date")
    dim = spark.createDataFrame([(c,) for c, _ in data] + [("void",)], "city string")
    got = rows(health.freshness(df, F.lit(as_of), dimension=dim), "city")
    assert [r["status"] for r in got] == ["OK", "aging", "aging", "stale", "empty"]


def test_batches(spark):
    ts = dt.datetime
    states = spark.createDataFrame(
        [(1, ts(2024, 1, 1), ts(2024, 1, 1, 0, 28), "completed", 10, None),
         (2, ts(2024, 1, 2), ts(2024, 1, 2, 0, 3), "failed", 0, "x" * 400),
         (3, ts(2024, 1, 3), None, "running", 0, None)],
        "id long, started_at timestamp, completed_at timestamp, status string, "
        "rows_ingested long, error_message string")
    got = health.latest_batches(states, 2).collect()
    assert [(r["id"], r["minutes"]) for r in got] == [(3, None), (2, 3.0)]
    assert len(got[1]["error_message"]) == 200
    late = health.stale_batches(states, F.lit("2024-01-05").cast("timestamp"))
    assert [r["id"] for r in late.collect()] == [3]
