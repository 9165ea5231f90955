from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from isobar.operators import forest
from isobar.plans import training
from test_jobs import tracks


def test_a_forest_takes_no_more_jobs_for_deeper_trees(spark):
    matrix = tracks(spark).withColumn("label", F.col("category"))
    used = []
    for depth in (2, 12):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        training.fit(matrix, "cyclone", n_estimators=20, max_depth=depth)
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    spark.sparkContext.setJobGroup("", "")
    assert used[0] == used[1]


def test_trees_do_not_depend_on_how_rows_and_trees_are_dealt(spark):
    matrix = tracks(spark).withColumn("label", F.col("category"))
    found = [training.fit(m, "cyclone", n_estimators=6, max_depth=5).trees.orderBy("no").collect()
             for m in (matrix, matrix.repartition(7, "lon"))]
    assert found[0] == found[1] and [r["no"] for r in found[0]] == list(range(6))


def test_first_split_is_the_best_by_plain_counting():
    rng = np.random.default_rng(3)
    bins, label = rng.integers(1, 9, (1, 400)).astype(np.uint8), rng.integers(0, 3, 400)
    label[bins[0] > 5] = 2
    s = forest.Settings(classes=3, max_depth=1, min_rows=2, balanced=False, random_state=9)
    tree, times = forest.grow(bins, label, s, 4), np.random.default_rng([9, 4]).poisson(1.0, 400)

    def impurity(rows):
        n = np.bincount(label[rows], times[rows], 3)
        return n.sum() - (n ** 2).sum() / n.sum()

    lost = {cut: impurity(bins[0] <= cut) + impurity(bins[0] > cut) for cut in range(1, 8)}
    assert tree.bin[0] == min(lost, key=lost.get) == 5
    left = np.bincount(label[bins[0] <= 5], times[bins[0] <= 5], 3)
    assert np.allclose(forest.fall(tree, np.array([[1]], np.uint8))[0], left / left.sum())


def test_pure_rows_and_no_rows_give_leaves():
    s = forest.Settings(classes=2)
    assert forest.grow(np.ones((2, 50), np.uint8), np.ones(50, int), s, 0).feature.tolist() == [-1]
    one = forest.grow(np.ones((2, 50), np.uint8), np.arange(50) % 2, s, 0)
    assert one.feature.tolist() == [-1] and abs(one.shares.sum() - 1) < 1e-6


def test_fits_take_all_rows_of_a_large_matrix(spark, monkeypatch):
    from isobar.operators import boosting
    from isobar.plans import boosted
    rows = training.FIT_ROWS + 50_000
    matrix = spark.range(rows).selectExpr("cast(id % 97 as double) as x", "cast(id % 3 as int) as label")
    for module, fit in ((forest, training.fit), (boosting, boosted.fit)):
        monkeypatch.setattr(module, "fit", lambda df, *_, **__: df.count())
        assert fit(matrix, "cyclone", ["x"]) == rows


def test_rows_in_several_blocks_files_and_chunks_give_the_same_trees(spark, monkeypatch):
    from isobar.operators import boosting
    matrix = tracks(spark).withColumn("label", F.col("category")).select("lat", "lon", "label")
    # Many equal rows, which lie in several blocks.
    df = matrix.unionAll(spark.range(300).selectExpr("1.0D", "cast(null as double)", "cast(2 as int)"))
    s = forest.Settings(classes=6, n_estimators=5, max_depth=6, min_rows=2)
    one = forest.fit(df, ["lat", "lon"], s).trees.orderBy("no").collect()
    many = forest.fit(df.repartition(3), ["lat", "lon"], s, block_rows=70).trees.orderBy("no").collect()
    assert many == one
    block = boosting.blocks(df, ["lat", "lon"], boosting.cut_points(df, ["lat", "lon"], s.bins),
                            in_order=True).first()
    bins = np.frombuffer(block["bins"], np.uint8).reshape(2, -1)
    label = np.frombuffer(block["label"], np.int32)
    monkeypatch.setattr(forest, "CHUNK", 64)
    monkeypatch.setattr(forest, "CELLS", 500)
    monkeypatch.setattr(forest, "PASS_CELLS", 900)
    monkeypatch.setattr(boosting, "ROOM", 100)  # in temporary files
    for row in one:
        assert forest._packed(row["no"], forest.grow(bins, label, s, row["no"]))["feature"] == row["feature"]
