"""One document of each group of near copies: five-word runs, similarity 0.8 or more.

Similarity is the Jaccard index of the sets of runs of ``WORDS`` words. At 0.8 the fingerprints of
those runs still differ in ten bits on average, too many for any index. One changed word changes
five runs but a single word, so candidates come from the SimHash of the set of words, whose
differences are three bits on average: the Gray-order index links fingerprints of ``RADIUS`` bits or
fewer, in two views from independent hashes that make up for each other's misses.

What the links connect is a cluster, which no candidate pair leaves. The exact similarity is then
decided inside the clusters, over the whole sets of runs, by the cells of the prefix-tree join: every
similar pair of a cluster is linked, a large cluster is dealt into cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import slices, stored
from isobar.llm.components import components
from isobar.llm.ngram_join import links_within, units_of
from isobar.llm.shingles import mix, shingle_sets
from isobar.llm.simhash import near_pairs, simhash, spanning
from isobar.operators.lookup import sized

WORDS = 5
PERCENT = 80
RADIUS = 6


def _mark(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at, n in slices(texts, 1 << 20):
                some = texts.slice(at, n).cast(pa.large_binary()).to_pylist()
                units, held = units_of(some, size)
                text, words = shingle_sets(some, 1)
                cuts = np.cumsum(np.bincount(text, minlength=n))[:-1]
                views = [np.array([simhash(x) for x in np.split(hashes, cuts)], dtype=np.uint64)
                         .view(np.int64) for hashes in (words, mix(words))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, n), batch.column("digest").slice(at, n), units,
                     pa.array(held), *(pa.array(v) for v in views)],
                    ["id", "digest", "unit", "n", "bits", "bits2"])

    return run


def groups(docs: DataFrame, percent: int = PERCENT, radius: int = RADIUS,
           size: int = WORDS) -> DataFrame:
    """``id, digest, group, rows`` for the distinct rows of ``docs (id, digest, text)``."""
    marked = stored(docs.mapInArrow(
        _mark(size), f"id {docs.schema['id'].dataType.simpleString()}, digest bigint, unit binary, "
                     "n bigint, bits bigint, bits2 bigint").groupBy("id", "digest").agg(
        *[F.first(c).alias(c) for c in ("unit", "n", "bits", "bits2")],
        F.count("*").alias("rows")), "marked")
    units = stored(marked.groupBy("unit").agg(
        F.first("bits").alias("bits"), F.first("bits2").alias("bits2"), F.first("n").alias("n"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("one")), "units")
    # Clusters are made of first fingerprints; a second one stands for the smallest first beside it.
    other = stored(units.groupBy("bits2").agg(F.min("bits").alias("low"), F.max("bits").alias("high")),
                   "second-views")
    # Each view is a written table: one plan of both would be planned anew after each of its stages.
    first = stored(near_pairs(units.select("bits").distinct(), radius, choose=spanning)
                   .toDF("a", "b"), "first-pairs")
    second = stored(near_pairs(other.select(F.col("bits2").alias("bits")), radius,
                               choose=spanning), "second-pairs")
    second = second.join(other.select(F.col("bits2").alias("a_bits"), F.col("low").alias("a")),
                         "a_bits").join(other.select(F.col("bits2").alias("b_bits"),
                                                     F.col("low").alias("b")), "b_bits")
    beside = units.join(other.filter("low != high").select("bits2", "low"), "bits2").select(
        F.col("bits").alias("a"), F.col("low").alias("b"))
    clusters = components(first.unionAll(second.select("a", "b")).unionAll(beside))
    members = units.filter("n > 0").join(clusters.withColumnRenamed("node", "bits"), "bits", "left") \
        .select("unit", "n", "one.id", "one.digest", F.coalesce("root", "bits").alias("cluster"))
    several = members.groupBy("cluster").agg(F.count("*").alias("units")).filter("units > 1")
    several, few = sized(several.select("cluster"))
    members = members.join(F.broadcast(several) if few else several, "cluster", "left_semi")
    whole = components(links_within(docs, members, size, percent))
    return (marked.join(whole.withColumnRenamed("node", "unit"), "unit", "left")
            .select("id", "digest", F.coalesce("root", "unit").alias("group"), "rows"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` but one of each group of near copies, with their own columns.

    The row with the smallest id stays; nulls count as the largest, equal ids go by a hash of the
    text. Rows equal in id and text are copies too. Null texts, empty texts and texts without a
    word are one group. An empty table stays empty.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"),
                        F.col(text_col).alias("text"))
    grouped = stored(groups(keyed.select("id", "digest", "text"), percent, radius), "grouped")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    stays = grouped.groupBy("group").agg(F.min(rank).alias("stays"))
    gone, few = sized(grouped.join(stays, "group").filter(rank != F.col("stays"))
                      .select("id", "digest"))
    twice, rare = sized(grouped.filter("rows > 1").select("id", "digest"))
    same = (F.col("l.digest") == F.col("r.digest")) & F.col("l.id").eqNullSafe(F.col("r.id"))
    kept = keyed.drop("text").alias("l").join((F.broadcast(gone) if few else gone).alias("r"), same,
                                              "left_anti")
    if twice.isEmpty():
        return kept.select("doc.*")
    twice = F.broadcast(twice) if rare else twice
    once = kept.alias("l").join(twice.alias("r"), same, "left_anti")
    several = kept.alias("l").join(twice.alias("r"), same, "left_semi")
    return once.unionAll(several.dropDuplicates(["id", "digest"])).select("doc.*")
