"""A training corpus from ``documents``: five stages, each written and read again.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns
the columns of ``documents``; the last adds ``shard`` and ``slot``. Sampling and shuffling are
drawn, so there is no SQL twin; the tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import copies, decontaminate, langid, mixing, sharding
from isobar.llm.common import stored, table

SHARDS = 24


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the model learns from the labelled four fifths."""
    learned = docs.filter(~langid.held_out(F.col("doc_id"), 5, 0)).select("lang", "text")
    return langid.keep_identified(docs, langid.fit(learned))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources by their weights; a document taken twice is two rows."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a uniform order, in shards of sizes at most one apart."""
    return sharding.shuffle_to_shards(docs, SHARDS, keys=("doc_id", "text"))


STAGES = [("language_id", identified), ("near_dedup", deduplicated),
          ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
