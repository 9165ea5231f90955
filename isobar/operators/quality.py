"""Checks on keys and scoring inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions.columns import to_number
from isobar.schemas import Rule


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def align_features(df: DataFrame, contract: Sequence[str],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Keys and contract columns in contract order; extra columns go, missing ones raise."""
    missing = sorted(set(contract) - set(df.columns))
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*keys, *contract)


def check_features(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Fill defaults and add ``violations``, the names of the rules each row breaks."""
    values = {}
    for name, rule in rules.items():
        value = to_number(F.col(name)) if name in df.columns else F.lit(None).cast("double")
        if rule.default is not None:
            value = F.coalesce(value, F.lit(float(rule.default)))
        values[name] = value
    filled = df.withColumns(values)
    broken = []
    for name, rule in rules.items():
        col = F.col(name)
        if rule.default is None:
            broken.append(F.when(col.isNull(), F.lit(f"{name}: required")))
        if rule.low is not None:
            broken.append(F.when(col < rule.low, F.lit(f"{name}: below {rule.low}")))
        if rule.high is not None:
            broken.append(F.when(col > rule.high, F.lit(f"{name}: above {rule.high}")))
        if rule.whole:
            broken.append(F.when(col != F.floor(col), F.lit(f"{name}: not whole")))
    return filled.withColumn("violations", F.array_compact(F.array(*broken)))


def validate_features(df: DataFrame, rules: Mapping[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that meet all rules and a quarantine that keeps its violations."""
    checked = check_features(df, rules)
    good = F.size("violations") == 0
    return checked.where(good).drop("violations"), checked.where(~good)
