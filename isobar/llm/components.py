"""Connected components of a table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import stored


def _several(edges: DataFrame) -> bool:
    """Whether a node hangs under two others."""
    return not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``: the smallest node it is connected to.

    Alternates two steps until every node hangs under one root that hangs nowhere: every node hangs its larger neighbours, then its
    smaller ones, under its smallest neighbour. The number of rounds grows with the logarithm of
    the longest path. A hub with most nodes is only the key of a minimum, which combines before
    the shuffle, and of joins, whose skew adaptive execution splits. Every round is a written
    table. An empty table has no nodes.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u != v").distinct(), "links")
    while not edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() or (
            _several(edges)):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = low.select("u", F.least("u", "low").alias("low"))
        edges = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                            F.col("low").alias("v"))
                 .filter("u != v").distinct())
        edges = stored(edges, "links")
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stored(moved.unionAll(low.select("u", F.col("low").alias("v")))
                       .filter("u != v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
