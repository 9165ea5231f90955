"""Boosted trees against a plain version, over one block and several, and the adaptive search."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import boosting
from isobar.operators.boosting import Settings
from isobar.plans import boosted

FEATURES = ["a", "b", "c"]


def samples(n, classes, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.choice([None, *range(9)]), rng.uniform(-1, 1), float(rng.randrange(3))
        score = (a or 4) / 3 + 2 * b * (c - 1) + rng.gauss(0, 0.3)
        rows.append((k, None if a is None else float(a), float("nan") if k % 29 == 0 else b, c,
                     int(min(max(score, 0), classes - 1))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, a double, b double, c double, label int")


def plain_tree(rows, g, h, s, cuts, depth):
    """The best split of the rows over all features, bins and sides, and so on below."""
    total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
    leaf = -s.learning_rate * total_g / (total_h + s.reg_lambda)
    best = (s.min_gain, None)
    for f in range(len(FEATURES)) if depth else ():
        for side in (0, 1):
            for cut in range(1, s.bins):
                left = [i for i in rows if (cuts[f][i] <= cut if cuts[f][i] else side)]
                lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                rg, rh = total_g - lg, total_h - lh
                if min(lh, rh) >= s.min_child_weight:
                    gain = (lg ** 2 / (lh + s.reg_lambda) + rg ** 2 / (rh + s.reg_lambda)
                            - total_g ** 2 / (total_h + s.reg_lambda))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, left)
    if best[1] is None:
        return {i: leaf for i in rows}
    inside = set(best[1])
    return {**plain_tree(best[1], g, h, s, cuts, depth - 1),
            **plain_tree([i for i in rows if i not in inside], g, h, s, cuts, depth - 1)}


def plain_fit(bins, label, s):
    n = len(label)
    margin = [[0.0] * s.margins for _ in range(n)]
    for _ in range(s.n_estimators):
        trees = []
        for k in range(s.margins):
            g, h = [], []
            for i in range(n):
                if s.margins == 1:
                    p, w = 1 / (1 + math.exp(-margin[i][0])), s.scale_pos_weight if label[i] else 1
                    g.append((p - label[i]) * w)
                    h.append(p * (1 - p) * w)
                else:
                    e = [math.exp(x) for x in margin[i]]
                    p = e[k] / sum(e)
                    g.append(p - (label[i] == k))
                    h.append(2 * p * (1 - p))
            g, h = ([round(x / boosting.STEP) * boosting.STEP for x in y] for y in (g, h))
            trees.append(plain_tree(list(range(n)), g, h, s, bins, s.max_depth))
        for i in range(n):
            for k, tree in enumerate(trees):
                margin[i][k] += tree[i]
    return np.array(margin)


@pytest.mark.parametrize("classes,weight", [(2, 1.0), (2, 3.0), (4, 1.0)])
def test_trees_equal_a_plain_version(classes, weight):
    rows = samples(90, classes, seed=classes)
    cuts = [np.array([1.0, 3, 4, 6]), np.array([-0.6, -0.2, 0.1, 0.5]), np.array([0.0, 1])]
    bins = np.stack([boosting.binned(np.array([np.nan if r[k + 1] is None else r[k + 1] for r in rows]), c)
                     for k, c in enumerate(cuts)])
    s = Settings(classes=classes, n_estimators=4, max_depth=3, learning_rate=0.4, bins=6,
                 scale_pos_weight=weight, min_child_weight=0.7)
    label = np.array([r[4] for r in rows], dtype=np.int32)
    margin = np.zeros((90, s.margins))
    found = boosting.fit_rows(boosting.Rows(bins, label, np.arange(90, dtype=np.uint64), margin, s))
    np.testing.assert_allclose(margin, plain_fit(bins, label, s), atol=1e-5)
    model = boosting.Boosted(FEATURES, cuts, s, found)
    np.testing.assert_allclose(boosting.margins(model, bins), margin)
    again = boosting.loads(boosting.dumps(model))
    np.testing.assert_array_equal(boosting.margins(again, bins), boosting.margins(model, bins))
    assert abs(model.importances().sum() - 1) < 1e-9


@pytest.mark.parametrize("classes", [2, 3])
def test_sums_of_several_blocks_give_the_same_trees(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "REWRITE", 2)
    df = frame(spark, samples(400, classes))
    s = Settings(classes=classes, n_estimators=5, max_depth=3, subsample=0.7, colsample_bytree=0.7,
                 bins=16)
    one = boosting.fit(df, FEATURES, s)
    many = boosting.fit(df.repartition(3), FEATURES, s, block_rows=90)
    assert boosting.dumps(one) == boosting.dumps(many)
    assert boosting.nodes_table(spark, one).where("feature >= 0").count() > 10


def test_classes_grown_in_tasks_of_their_own_give_the_same_trees(spark, monkeypatch):
    df = frame(spark, samples(400, 4))
    settings = Settings(classes=4, n_estimators=4, max_depth=4, subsample=0.8, colsample_bytree=0.7,
                        bins=16)
    one = boosting.fit(df, FEATURES, settings)
    monkeypatch.setattr(boosting, "SIDE_ROWS", 1)
    for tasks in (4, 3):
        monkeypatch.setattr(boosting, "_together", lambda *_: tasks)
        side = boosting.fit(df, FEATURES, settings)
        assert boosting.dumps(side) == boosting.dumps(one)


def test_tasks_add_up_the_sums_of_their_rows(spark, monkeypatch):
    df = frame(spark, samples(500, 3))
    settings = Settings(classes=3, n_estimators=3, max_depth=5, bins=16)
    one = boosting.fit(df, FEATURES, settings)
    monkeypatch.setattr(boosting, "SIDE_ROWS", 1)
    monkeypatch.setattr(boosting, "WHOLE_BYTES", 0)  # every task adds up a share
    monkeypatch.setattr(boosting, "_side_by_side", side := counted(boosting._side_by_side))
    many = boosting.fit(df.repartition(3), FEATURES, settings, block_rows=60)  # several blocks a task
    assert boosting.dumps(many) == boosting.dumps(one) and len(side.results) == 1
    assert side.results[0] is not None


def counted(fn):
    def run(*args):
        run.results.append(fn(*args))
        return run.results[-1]

    run.results = []
    return run


def test_a_child_is_the_rest_of_its_parent():
    rng = np.random.default_rng(4)
    bins, label = rng.integers(0, 6, (3, 300)).astype(np.uint8), rng.integers(0, 2, 300).astype(np.int32)
    s = Settings(n_estimators=1, max_depth=3, bins=5)
    rows = boosting.Rows(bins, label, np.arange(300, dtype=np.uint64), np.zeros((300, 1)), s)
    seen = []

    def histograms(no, levels, wanted):
        rows.move(levels[-1]) if levels else rows.start(no)
        seen.append(int(wanted[0].sum()))
        return rows.histograms(wanted)

    tree = boosting._round(0, histograms, s, 3)[0]
    assert seen == [1] + [(level.feature >= 0).sum() for level in tree[:2]]  # one of two children


def test_a_fit_of_many_rows_uses_a_task_per_class(spark):
    assert boosting._together(spark, 6) == min(6, spark.sparkContext.defaultParallelism) > 1
    assert boosting._together(spark, 1) == 1


def test_learns_and_stores(spark, tmp_path):
    df = frame(spark, samples(600, 3))
    model = boosting.fit(df.where("k < 400"), FEATURES, Settings(classes=3, n_estimators=30, max_depth=3))
    boosting.save(spark, model, str(tmp_path / "m"))
    scored = boosting.predict(boosting.load(spark, str(tmp_path / "m")), df.where("k >= 400"))
    got = scored.select(F.avg((F.col("prediction") == F.col("label")).cast("int")),
                        F.avg(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda x, y: x + y) - 1)),
                        F.count("*")).first()
    held = [r[4] for r in samples(600, 3)[400:]]
    assert got[0] > max(held.count(c) for c in range(3)) / 200 + 0.15  # well above the largest class
    assert got[1] < 1e-9 and got[2] == 200
    assert scored.columns == [*df.columns, "prediction", "probabilities"]


def test_nothing_to_learn_from(spark):
    df = frame(spark, samples(30, 2))
    s = Settings(n_estimators=3)
    none = boosting.fit(df.where("false"), FEATURES, s)
    assert {tuple(r["probabilities"]) for r in boosting.predict(none, df).collect()} == {(0.5, 0.5)}
    assert boosting.predict(none, df.where("false")).collect() == []
    same = boosting.fit(df.withColumn("label", F.lit(1)), FEATURES, s)
    assert {r["prediction"] for r in boosting.predict(same, df).collect()} == {1}
    blank = boosting.fit(df.withColumn("a", F.lit(None).cast("double")), FEATURES, s)
    assert len(blank.cuts[0]) == 0
    assert boosting.fit(df.withColumn("label", F.lit(None).cast("int")), FEATURES, s).rounds == []


def test_settings_are_checked():
    assert boosted.settings_for("heatwave").scale_pos_weight == 5
    assert boosted.settings_for("cyclone", max_depth=4.0).max_depth == 4
    with pytest.raises(ValueError, match="unknown"):
        boosted.settings_for("cyclone", depth=3)


def test_search_narrows_on_the_best_part():
    space = {"x": (0.0, 1.0, None), "n": (100, 300, 50), "flat": (2, 2, 1)}

    def score(some):
        return [-(s["x"] - 0.3) ** 2 - ((s["n"] - 200) / 400) ** 2 for s in some]

    gaps = []
    for seed in range(12):
        done = boosted.adapt(space, score, 40, seed)
        assert len(done) == 40 and done == boosted.adapt(space, score, 40, seed)
        assert all(0 <= s["x"] <= 1 and s["n"] in range(100, 301, 50) and s["flat"] == 2
                   for s, _ in done)
        early, late = ([abs(s["x"] - 0.3) for s, _ in part] for part in (done[:8], done[20:]))
        gaps.append(np.mean(early) - np.mean(late))
    assert np.mean(gaps) > 0.05  # later draws lie nearer to the best point than the first ones


@pytest.mark.parametrize("task,metric", [("cyclone", "f1"), ("heatwave", "areaUnderROC")])
def test_search_scores_folds(spark, task, metric):
    from isobar.plans.scoring import CONTRACTS
    contract = CONTRACTS[task]
    rng = random.Random(3)
    rows = []
    for k in range(240):
        values = [rng.uniform(0, 1) for _ in contract]
        rows.append((k, *values, int(values[0] * (5.99 if task == "cyclone" else 1.99))))
    key = "point_id" if task == "cyclone" else "time"
    df = spark.createDataFrame(rows, ", ".join(
        [f"{key} int", *[f"{c} double" for c in contract], "label int"]))
    df = df if task == "cyclone" else df.withColumn("city", F.lit("x"))
    space = {"n_estimators": (3, 9, 3), "max_depth": (1, 3, 1)}
    best, table = boosted.search(df, task, trials=5, folds=2, space=space)
    got = table.orderBy("trial").collect()
    assert [r["trial"] for r in got] == list(range(5)) and {r["metric"] for r in got} == {metric}
    assert max(r["score"] for r in got) > 0.8 and set(best) == set(space)
