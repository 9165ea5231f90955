"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows lie in hash partitions. How many rows of a partition go to a shard is drawn first, as a
matrix whose rows add up to the partitions and whose columns add up to the shards, so shard sizes
are exact before a row moves. Each partition then permutes its rows locally and cuts them by its
matrix row; after the exchange every shard is permuted again, in parts that one task can sort.
The driver holds the matrix alone, whose size is bounded by ``MAX_PARTITIONS`` times the shards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PARTITION = 2_000
# Bounds the matrix, not the rows: beyond 8 million rows the partitions grow instead.
MAX_PARTITIONS = 4_096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` out of ``good + bad``, by inversion around the mode.

    The library's generator ends at 10^9 items. Probabilities follow from their exact ratios;
    what lies over twelve standard deviations from the mode (below 10^-30) is left out.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    share = good / total
    sd = math.sqrt(max(drawn * share * (1 - share) * (total - drawn) / max(total - 1, 1), 0.0))
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    reach = int(12 * sd) + 12
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    ratio = (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(np.log(ratio))))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(parts: Sequence[int], shards: Sequence[int], seed: int) -> np.ndarray:
    """Counts by partition and shard, distributed as under a uniform permutation of all rows."""
    rng = np.random.default_rng(seed)
    left, matrix = [int(x) for x in shards], np.zeros((len(parts), len(shards)), dtype=np.int64)
    for p, size in enumerate(parts):
        rest, pool = int(size), sum(left)
        for s, room in enumerate(left):
            pool -= room
            taken = hypergeometric(rng, room, pool, rest)
            matrix[p, s], rest = taken, rest - taken
        left = [room - int(t) for room, t in zip(left, matrix[p])]
    return matrix


def shard_sizes(n: int, n_shards: int, seed: int) -> list[int]:
    """Sizes at most one apart; which shards hold one more is drawn."""
    extra = np.random.default_rng(seed).permutation(n_shards)[:n % n_shards]
    return [n // n_shards + int(s in set(extra.tolist())) for s in range(n_shards)]


def shuffle_to_shards(docs: DataFrame, n_shards: int, keys: Sequence[str], seed: int = 8,
                      rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``n_shards - 1``) and ``slot`` (gapless from 0 in a shard).

    ``keys`` tell rows apart and may hold nulls; rows equal in all of them are interchangeable and
    each gets a slot of its own. Existing columns ``shard`` and ``slot`` are replaced. An empty
    table stays empty. The result depends on the keys, the number of rows and the seed alone.
    """
    spark = docs.sparkSession

    def draw(name: str):
        return F.xxhash64(F.lit(seed), F.lit(name), *keys)

    n = docs.count()
    n_parts = max(1, min(MAX_PARTITIONS, math.ceil(n / rows_per_partition)))
    parts = F.pmod(draw("partition"), F.lit(n_parts)).cast("int")
    found = {r["p"]: r["n"] for r in docs.groupBy(parts.alias("p")).agg(F.count("*").alias("n"))
             .collect()}
    matrix = communication_matrix([found.get(p, 0) for p in range(n_parts)],
                                  shard_sizes(n, n_shards, seed), seed)
    bounds = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)],
        "p int, bounds array<bigint>")

    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), parts.alias("p"),
                       draw("local").alias("local"), draw("part").alias("part"),
                       draw("slot").alias("order"))
    within = Window.partitionBy("p").orderBy("local", "part", "order")
    cut = (rows.withColumn("rank", F.row_number().over(within))
           .join(F.broadcast(bounds), "p")
           .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("rank")))))

    # The second permutation: parts of a shard by hash, each behind the parts before it.
    n_slices = max(1, math.ceil(n_parts / n_shards))
    sliced = cut.withColumn("slice", F.pmod("part", F.lit(n_slices)).cast("int"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
              .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    again = Window.partitionBy("shard", "slice").orderBy("order", "local")
    return (sliced.withColumn("nth", F.row_number().over(again))
            .join(F.broadcast(starts), ["shard", "slice"])
            .select("doc.*", "shard", (F.col("start") + F.col("nth") - 1).alias("slot")))
