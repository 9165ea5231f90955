"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target in words. A document is taken ``floor(f)`` times for sure and once more
with probability ``f - floor(f)``, ``f`` being its source's target over its size. The cube method
turns these probabilities into a sample: in the flight phase they move along the null space of the
constraints (number of documents and of words; the longest open document against all shorter ones)
until all but two of a block are 0 or 1, with both totals unchanged. What remains of all blocks is
dealt into new, fewer blocks; only the last block of a source is landed by giving up one constraint
after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.llm.common import stored, words
from isobar.operators.lookup import lookup_join

BLOCK = 2_000
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
            max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source (``source``, ``size``) with its ``target``.

    Sources in order of code points, null last, take the weights in turn and share ``budget`` times
    all sizes. No target passes ``max_repeats`` times its source; the rest is shared by weight
    among the others until none is above. That is the level at which all caps and shares add up,
    found with running sums over the sources by cap per weight. One row per source, one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    base = (sizes.withColumn("weight", weight)
            .withColumn("cap", F.col("size") * float(max_repeats))
            .withColumn("ratio", F.col("cap") / F.col("weight")))
    upward = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    after = upward.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("size").over(every) * float(budget) - F.coalesce(F.sum("cap").over(before),
                                                                    F.lit(0.0)))
             / F.sum("weight").over(after))
    return (base.withColumn("level", level)
            .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level")))
                        .over(every))
            .select("source", "size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"),
                                                                F.col("cap"))).alias("target")))


def _reach(prob: np.ndarray, u: np.ndarray) -> float:
    """How far the probabilities can go along ``u`` until one of them is 0 or 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(u > 0, (1 - prob) / u, np.where(u < 0, -prob / u, np.inf))
    return float(room.min())


def _direction(prob: np.ndarray, size: np.ndarray, both: bool) -> np.ndarray | None:
    """A step of the first text that all others make up for: in words and, if ``both``, in number.

    Others move by the room they have on both sides. None if nothing can make up for the first.
    """
    room = np.minimum(prob[1:], 1 - prob[1:])
    if not both:
        words = room @ size[1:]
        return np.r_[1.0, -size[0] * room / words] if words > 0 else None
    share = room / room.sum()
    away = size[1:] - share @ size[1:]
    if size[1:].min() == size[1:].max():
        return np.r_[1.0, -share] if size[0] == size[1] else None
    lean = (size[0] - share @ size[1:]) / (share @ away ** 2)
    return np.r_[1.0, -share * (1 + lean * away)]


def flight(prob: Sequence[float], size: Sequence[float], rng: np.random.Generator,
           land: bool) -> list[float]:
    """The probabilities after the flight phase: at most two lie between 0 and 1, none if landed.

    Texts are decided in the given order, long ones first, while many shorter ones can make up for
    them: every step moves the first open text against all others, along the null space of both
    constraints, and has mean zero. The landing gives up the number of documents first, then the
    words. It starts where a text cannot be decided at once within both constraints, but can within
    that of the words: later, too few open texts would be left to make up for it.
    """
    prob, size = np.array(prob, dtype=np.float64), np.asarray(size, dtype=np.float64)
    open_ = np.flatnonzero((prob > 0) & (prob < 1))
    left = []  # a text that nothing can make up for: all others have the same other length
    while len(open_) > (1 if land or left else 2):
        p, s = prob[open_], size[open_]
        u = _direction(p, s, True)
        if land and (u is None or _reach(p, u) < 1 - p[0] or _reach(p, -u) < p[0]):
            v = _direction(p, s, False)
            if u is None or (v is not None and _reach(p, v) >= 1 - p[0]
                             and _reach(p, -v) >= p[0]):
                u = v
        if u is None:
            left.append(open_[0])
            open_ = open_[1:]
            continue
        ahead, back = _reach(p, u), _reach(p, -u)
        p = p + (ahead if rng.random() * (ahead + back) < back else -back) * u
        p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
        prob[open_] = p
        open_ = open_[(p > 0) & (p < 1)]
    if land:
        for k in [*left, *open_]:
            prob[k] = float(rng.random() < prob[k])
    return prob.tolist()


def _solver(names: Sequence[str], seed: int, level: int, land: bool):
    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Long texts first, so that short ones remain to make up for them.
        rows = rows.sort_values(["words", "uid2", "uid1"], ascending=[False, True, True])
        name = np.frombuffer(str(key[0]).encode(), dtype=np.uint8)
        rng = np.random.default_rng([seed, level, int(key[1]), *name.tolist()])
        rows["prob"] = flight(rows["prob"].tolist(), rows["words"].tolist(), rng, land)
        return rows[list(names)]

    return solve


def _sample(units: DataFrame, seed: int, block: int) -> DataFrame:
    """``units`` (``source_key, uid1, uid2, words, prob``) with every ``prob`` turned into 0 or 1."""
    done, level, schema = [], 0, units.schema

    while True:
        counts = stored(units.groupBy("source_key").agg(F.count("*").alias("n")), "mix-counts")
        last = (counts.agg(F.max("n")).first()[0] or 0) <= block
        dealt = (lookup_join(units, counts, ["source_key"])
                 .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "uid1", "uid2"),
                                             F.ceil(F.col("n") / block)).cast("long")).drop("n"))

        out = stored(dealt.groupBy("source_key", "block").applyInPandas(
            _solver(schema.names, seed, level, last), schema), "mix-level")
        done.append(out.filter("prob = 0 OR prob = 1"))
        if last:
            break
        units, level = out.filter("prob > 0 AND prob < 1"), level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionAll(part)
    return result


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source",
        id_col: str = "doc_id", seed: int = 10, block: int = BLOCK, **target_params) -> DataFrame:
    """``docs`` in a struct ``doc``, with ``size``, ``source_size``, ``target`` and ``copies``.

    A null text has size 0. Rows equal in id, text and source are one unit and share a decision.
    Null ids and sources are values of their own. A source whose texts hold no word has target 0
    and is not taken. An empty table stays empty. Reruns agree: all draws follow from the rows.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(
            F.concat(F.lit("1"), F.col(source_col).cast("string"))).alias("source_key"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("uid1"),
        F.xxhash64(F.col(id_col).isNull(), text_col).alias("uid2"))
    units = stored(keyed.groupBy("source_key", "uid1", "uid2").agg(
        F.max("size").alias("size"), F.count("*").alias("rows")), "mix-units")
    sizes = units.groupBy("source_key").agg(F.sum(F.col("size") * F.col("rows")).alias("size"))
    source = F.when(F.col("source_key") != "0", F.substring("source_key", 2, 1 << 30))
    aims = (targets(sizes.select(source.alias("source"), "size"), **target_params)
            .select(F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("source_key"),
                    F.col("size").alias("source_size"), "target"))
    aimed = lookup_join(units, aims, ["source_key"])
    factor = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")),
                        F.lit(0.0))
    factored = aimed.withColumn("whole", F.floor(factor + 1e-12)).withColumn(
        "prob", F.greatest(factor - F.col("whole"), F.lit(0.0)))
    drawn = _sample(factored.select("source_key", "uid1", "uid2",
                                    (F.col("size") * F.col("rows")).alias("words"), "prob"),
                    seed, block)
    keys = ["source_key", "uid1", "uid2"]
    decided = (factored.drop("prob", "size", "rows").join(drawn.select(*keys, "prob"), keys)
               .withColumn("copies", (F.col("whole") + F.col("prob")).cast("int"))
               .select(*keys, "source_size", "target", "copies"))
    return keyed.join(decided, keys).select("doc", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    return (mix(docs, **params).filter("copies > 0")
            .select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("doc.*"))
