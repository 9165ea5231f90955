"""Packed products and mined negatives against plain integer arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("top,dims", [(1, 1), (3, 5), (150, 64), (2 ** 12, 64), (2 ** 20, 7),
                                      (2 ** 30, 64), (10 ** 40, 3), (0, 4)])
def test_packed_products_are_exact(top, dims):
    rng = random.Random(top % 97 + dims)
    kind = object if top > 2 ** 31 else np.int64
    a, b = (np.array([[rng.randint(-top, top // 3) for _ in range(dims)] for _ in range(n)],
                     dtype=kind) for n in (7, 23))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert negatives.packed_scores(a, b).tolist() == want
    assert negatives.packed_scores(a[:0], b).shape == (0, 23)


def plain(rows):
    """The contract over (vec_id, embedding, label), as a sorted list."""
    part = [(i, v, [math.floor(256 * x) for x in e], lab) for i, (v, e, lab) in enumerate(rows)
            if lab is not None and e is not None
            and all(x is not None and math.isfinite(x) for x in e)]
    part = [(i, v, e, (lab + 1) % 10 if v is not None and v % 7 == 0 else lab)
            for i, v, e, lab in part]
    out = []
    for i, v, e, lab in part:
        if v is None or v % 100:
            continue
        others = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(e, f)))),
                         math.inf if w is None else w, m == lab)
                        for j, w, f, m in part if j != i and len(f) == len(e))
        for p, positive, _ in [x for x in others if x[2]][:5]:
            fit = [x for x in others if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(v, positive, r, w, -p, -s) for r, (s, w, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(docs):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(docs, F.col("vec_id") % 100 == 0, label).collect()
    return sorted(tuple(math.inf if x is None else x for x in r) for r in got)


@pytest.mark.parametrize("candidates,anchors,strip", [(1 << 15, 1 << 11, 1 << 22), (17, 3, 40)])
def test_negatives_equal_brute_force(spark, monkeypatch, candidates, anchors, strip):
    for name, value in (("CANDIDATES", candidates), ("ANCHORS", anchors), ("STRIP", strip)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(candidates)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for k in range(240):
        centre = rng.choice(centres)
        rows.append((25 * k, [round(x + rng.uniform(-.3, .3), 2) for x in centre], rng.randrange(3)))
    same = [0.5] * 6  # a third of the rows are equal but for their ids and labels
    rows += [(10_000 + k, same, rng.randrange(10)) for k in range(100)]
    rows += [(100, same, 1), (100, same, 1), (300, [1.0, 2.0], 1), (301, [1.0, 1.0], 2),
             (302, [1.0, 1.9], 1), (None, same, 1), (None, same, 2), (600, [], 4), (601, [], 4),
             (602, [], 5), (400, None, 2), (500, same, None), (700, [float("nan")] * 6, 1),
             (800, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (900, [float("inf")] * 6, 1), (-100, same, 3)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_wide_components_and_clashing_names(spark):
    rows = [(100 * k, [2.0 ** 40 + k, -3.5, 0.25], k % 2) for k in range(6)]
    rows += [(100 * k, [2.0 ** 20 + k, -3.5, 0.25, 0.0], k % 2) for k in range(6)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    rows = [(k, [k % 5 / 7, 0.5], k % 3) for k in range(0, 1_000, 20)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[
        f"'!' AS `{c}`" for c in "row x y leads asked values score anchor rank nth id".split()])
    assert mined(docs) == plain(rows)
    assert mined(docs.filter("false")) == mined(docs.filter("vec_id % 100 > 0")) == []
