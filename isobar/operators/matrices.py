"""Supervised matrices: keys, contract features in order, and a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.functions.columns import FLOATS
from isobar.operators.panel import lead_target
from isobar.operators.ranking import as_map, column_quantiles
from isobar.schemas import CYCLONE_FEATURES, HEATWAVE_FEATURES, RAINFALL_FEATURES

PANEL_KEYS = ["city", "time"]


def impute_median(df: DataFrame, cols: Sequence[str], all_null_value: float | None = 0.0,
                  float_only: bool = False, fit_on: DataFrame | None = None) -> DataFrame:
    """Replace NULL by the column's exact median, or by ``all_null_value`` if it has none.

    Medians come from ``fit_on`` if given, for instance the training part only.
    """
    kinds = FLOATS if float_only else (T.NumericType,)
    chosen = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, kinds)]
    if not chosen:
        return df
    medians = column_quantiles(df if fit_on is None else fit_on, chosen, 0.5)
    known = as_map(medians, F.col("feature"), F.col("value"))
    fallback = F.lit(all_null_value).cast("double")
    filled = {c: F.coalesce(F.col(c).cast("double"),
                            F.try_element_at("_medians", F.lit(c)), fallback) for c in chosen}
    return df.withColumn("_medians", known).withColumns(filled).drop("_medians")


def _available(df: DataFrame, contract: Sequence[str]) -> list[str]:
    return [c for c in contract if c in df.columns]


def cyclone_matrix(df: DataFrame, keys: Sequence[str] = ("point_id",)) -> DataFrame:
    """Track features with the intensity category as label; only fractional columns are imputed."""
    cols = _available(df, CYCLONE_FEATURES)
    rows = df.select(*[k for k in keys if k in df.columns], *cols,
                     F.col("category").cast("int").alias("label"))
    return impute_median(rows, cols, all_null_value=None, float_only=True)


def _next_day_matrix(df: DataFrame, contract: Sequence[str], target: str,
                     entity: str, time: str) -> DataFrame:
    cols = _available(df, contract)
    ahead = f"{target}_next"
    if ahead in df.columns:
        led = df.where(F.col(ahead).isNotNull()).withColumn("label", F.col(ahead))
    else:
        led = lead_target(df.select(entity, time, *cols, target), target, "label",
                          entity=entity, time=time)
    rows = led.select(entity, time, *cols, F.col("label").cast("int").alias("label"))
    return impute_median(rows, cols)


def heatwave_matrix(df: DataFrame, entity: str = "city", time: str = "time") -> DataFrame:
    """Today's features with tomorrow's heatwave flag; medians are taken after the last rows go.

    Reads ``heatwave_flag_next`` where the feature job has already written it.
    """
    return _next_day_matrix(df, HEATWAVE_FEATURES, "heatwave_flag", entity, time)


def rainfall_matrix(df: DataFrame, entity: str = "city", time: str = "time") -> DataFrame:
    """Today's features with tomorrow's extreme-rainfall flag."""
    return _next_day_matrix(df, RAINFALL_FEATURES, "extreme_rainfall", entity, time)


def split_test(df: DataFrame, label: str = "label", key: Sequence[str] = PANEL_KEYS,
               test: float = 0.2, seed: int = 42, out: str = "is_test",
               digits: int = 4) -> DataFrame:
    """Mark an exact, repeatable share of every class as test rows.

    Rows are ordered by a hash of their (unique) key and the first ``round(test * n)`` of each
    class are test rows; a NULL label is a class of its own. Rather than ranking a class in one task, hashes are counted by prefix,
    only the prefix in which the share ends is ranked, and rows compare with the hash found there.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    rows = df.withColumn("_hash", digest)
    prefix = F.substring("_hash", 1, digits)
    # Map keys must not be NULL; a label is marked to tell it from a missing one.
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("missing"))
    counts = rows.groupBy(name.alias("_class"), prefix.alias("_prefix")).agg(
        F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_class")
    upto = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({
        "_upto": F.sum("_n").over(upto),
        "_want": F.round(F.sum("_n").over(whole) * F.lit(test)).cast("long")})
    border = placed.where((F.col("_upto") - F.col("_n") < F.col("_want"))
                          & (F.col("_want") <= F.col("_upto")))
    found = as_map(border, F.col("_class"),
                   F.struct(F.col("_prefix").alias("prefix"),
                            (F.col("_want") - F.col("_upto") + F.col("_n")).alias("rank")))
    near = (rows.select(name.alias("_class"), "_hash")
            .withColumn("_at", F.try_element_at(found, F.col("_class")))
            .where(F.substring("_hash", 1, digits) == F.col("_at.prefix")))
    ranked = near.withColumn("_rank", F.row_number().over(whole.orderBy("_hash")))
    cuts = as_map(ranked.where(F.col("_rank") == F.col("_at.rank")),
                  F.col("_class"), F.col("_hash"))
    in_test = F.coalesce(F.col("_hash") <= F.try_element_at(cuts, name), F.lit(False))
    return rows.withColumn(out, in_test).drop("_hash")


def stratified_split(df: DataFrame, label: str = "label", key: Sequence[str] = PANEL_KEYS,
                     test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same class shares."""
    marked = split_test(df, label, key, test, seed)
    return (marked.where(~F.col("is_test")).drop("is_test"),
            marked.where("is_test").drop("is_test"))


def temporal_split(df: DataFrame, time: str = "time",
                   test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test) cut at the first day at which at most ``test`` of the rows remain."""
    days = df.groupBy(F.to_date(time).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per calendar day: a window over all of them is small.
    later = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    cut = (days.withColumns({"_rest": F.sum("_n").over(later),
                             "_all": F.sum("_n").over(everything)})
           .where(F.col("_rest") <= F.col("_all") * F.lit(test))
           .agg(F.min("_day").alias("_cut")))
    is_test = F.coalesce(F.to_date(time) >= cut.scalar(), F.lit(False))
    return df.where(~is_test), df.where(is_test)
