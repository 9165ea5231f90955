"""Class weights and standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.operators.ranking import as_map


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (k * n_class)`` per class; 1 if there is only one class."""
    everything = Window.partitionBy()
    classes = class_distribution(df.where(F.col(label).isNotNull()), label)
    total, k = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    return classes.withColumn(
        "weight", F.when(k <= 1, F.lit(1.0)).otherwise(total / (k * F.col("n"))))


def with_balanced_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    weights = as_map(class_weights(df, label), F.col(label).cast("string"), F.col("weight"))
    return df.withColumn(out, F.try_element_at(weights, F.col(label).cast("string")))


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts of both classes, the positive share and ``int(negatives / max(positives, 1))``."""
    is_pos = (F.col(label) == 1).cast("int")
    sums = df.agg(F.coalesce(F.sum(1 - is_pos), F.lit(0)).alias("n_neg"),
                  F.coalesce(F.sum(is_pos), F.lit(0)).alias("n_pos"))
    total = F.nullif(F.col("n_neg") + F.col("n_pos"), F.lit(0))
    return sums.withColumns({
        "pos_ratio": F.col("n_pos") / total,
        "scale_pos_weight": (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).cast("long")})


def with_pos_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Weight 1 for negatives and ``scale_pos_weight`` (at least 1) for positives."""
    scale = pos_weight(df, label).select("scale_pos_weight").scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, F.greatest(scale, F.lit(1)))
                         .otherwise(F.lit(1)).cast("double"))


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Z-scores with population deviation; a constant column is only centred."""
    moments = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                       for c in cols])
    fitted = moments.select(F.struct(*cols).alias("m")).scalar()
    scaled = {}
    for c in cols:
        mean, std = F.col(f"_m.{c}.mean"), F.col(f"_m.{c}.std")
        scaled[c] = (F.col(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return df.withColumn("_m", fitted).withColumns(scaled).drop("_m")
