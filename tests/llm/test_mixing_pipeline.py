"""Targets and samples of the mix against plain versions; the stages of the pipeline."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as pipeline
from isobar.llm import mixing

TINY = "/root/testdata/sf0.01"


def plain_targets(sizes, budget=1.5, repeats=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > repeats * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: float(repeats * sizes[s]) for s in full}
        rest -= sum(out[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 500, None: 40}, {"é": 5, "z": 5},
                                   {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 9_000, "d": 1}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_flight_keeps_both_totals_and_all_probabilities():
    rng = np.random.default_rng(1)
    prob, size = rng.uniform(0.05, 0.95, 300), rng.integers(1, 900, 300)
    out = np.array(mixing.flight(prob, size, rng, land=False))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(prob.sum()) and out @ size == pytest.approx(prob @ size)
    equal = mixing.flight([0.25] * 40, [7] * 40, rng, land=True)
    assert sorted(set(equal)) == [0.0, 1.0] and sum(equal) == 10
    small = np.array([0.3, 0.8, 0.5, 0.6, 0.2])
    mean = np.mean([mixing.flight(small, [5, 90, 30, 60, 2], rng, land=True)
                    for _ in range(6_000)], axis=0)
    assert mean == pytest.approx(small, abs=0.03)


def test_landing_of_few_texts_of_very_different_lengths():
    """50 texts, the longest of 13 times the median, end near their words, with unchanged means."""
    size = np.sort(np.ceil(np.exp(np.random.default_rng(7).normal(6, 1.1, 50))))[::-1]
    prob = np.full(50, 0.37)
    drawn = np.array([mixing.flight(prob, size, np.random.default_rng(k), land=True)
                      for k in range(600)])
    words = np.abs((drawn - prob) @ size) / (prob @ size)
    assert words.mean() < 0.01 and np.quantile(words, 0.95) < 0.03
    assert np.abs(drawn.sum(axis=1) - prob.sum()).mean() < 6
    assert drawn.mean(axis=0) == pytest.approx(prob, abs=0.1)
    lone = np.array(mixing.flight([0.5] * 4, [9, 2, 2, 2], np.random.default_rng(1), land=False))
    assert ((lone > 0) & (lone < 1)).sum() <= 2 and lone.sum() == pytest.approx(2)


@pytest.mark.parametrize("block", [2_000, 40])
def test_mix_comes_near_its_targets(spark, block):
    docs = spark.range(3_000).selectExpr(
        "id AS doc_id", "array_join(array_repeat('w', cast(1 + id % 90 AS int)), ' ') AS text",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 97 = 0 THEN NULL ELSE concat('s', id % 4) END "
        "AS source")
    out = mixing.mix(docs, block=block)
    found = out.selectExpr("doc.doc_id", "doc.source", "size", "target", "source_size",
                           "copies").toPandas()
    assert sorted(found["doc_id"]) == list(range(3_000)) and found["copies"].between(0, 2).all()
    want = plain_targets({k if isinstance(k, str) else None: int(v) for k, v in found.groupby(
        "source", dropna=False)["size"].sum().items()})
    for source, rows in found.groupby("source", dropna=False):
        target = want[source if isinstance(source, str) else None]
        assert rows["target"].iloc[0] == pytest.approx(target)
        assert abs((rows["size"] * rows["copies"]).sum() - target) <= 2 * 90
    again = mixing.mix(docs.repartition(5), block=block).selectExpr("doc.doc_id", "copies").toPandas()
    assert (again.sort_values("doc_id")["copies"].to_numpy()
            == found.sort_values("doc_id")["copies"].to_numpy()).all()


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    kept = [(docs.count(), docs)]
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept[-1][1], TINY)
        assert out.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
        out = spark.createDataFrame(out.collect(), out.schema)
        kept.append((out.count(), out))
    n = [k for k, _ in kept]
    assert n[1] >= 0.99 * n[0] and n[2] < n[1] and n[3] < n[2] and n[5] == n[4]
    texts = kept[2][1].select("text").distinct().count()
    assert texts == n[2]


def test_run_returns_the_last_stage(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 0
