"""Distribution drift of logged model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.ks import p_value
from isobar.operators.ranking import SLICE_ROWS, by_ranges, cumulative, same_keys
from isobar.session import materialize

# Log window, smallest log and sample, significance level.
LAST = 500
MIN_ROWS = 20
MIN_SAMPLE = 10
ALPHA = 0.05


def last_rows(log: DataFrame, last: int = LAST, model: str = "model_name",
              order: Sequence[str] = ("id",)) -> DataFrame:
    """The newest ``last`` rows of each model with ``age`` 1 for the newest.

    Two rounds: the newest rows of each salted part of a model first, then of what is left, so a
    model that owns most of the log is never ranked whole. There are as many parts as shuffle
    partitions.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    newest_first = [F.desc(c) for c in order]
    part = Window.partitionBy(model, "_salt").orderBy(*newest_first)
    few = (log.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(part))
           .where(F.col("_rank") <= last).drop("_salt", "_rank"))
    newest = Window.partitionBy(model).orderBy(*newest_first)
    return few.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= last)


def window_split(log: DataFrame, last: int = LAST, parity_order: bool = False,
                 model: str = "model_name", order: Sequence[str] = ("id",),
                 usable: Column | None = None) -> DataFrame:
    """Tag the newest rows of each model as ``reference`` (older two thirds) or ``current``.

    ``parity_order`` counts the two thirds from the newest row instead. ``samples`` is the window
    size of the model. Rows that are not ``usable`` count as samples, but not for the thirds, and
    have no side.
    """
    usable = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    recent = last_rows(log, last, model, order).withColumn("_usable", usable)
    whole = Window.partitionBy(model)
    n = F.count(F.when(F.col("_usable"), 1)).over(whole)
    age = F.count(F.when(F.col("_usable"), 1)).over(whole.orderBy("age"))
    place = age if parity_order else n - age + 1
    side = F.when(place <= F.floor(n * 2 / 3), "reference").otherwise("current")
    return recent.withColumns({"samples": F.count(F.lit(1)).over(whole),
                               "side": F.when(F.col("_usable"), side)}).drop("_usable")


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, feature) with a known value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                      for c in features])
    return df.select(*keep, F.inline(pairs)).where("value IS NOT NULL AND NOT isnan(value)")


def moments(long: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Sample sizes, means and population deviations of both sides per feature."""
    def of(side: str):
        return F.when(F.col("side") == side, F.col("value"))

    return long.groupBy(*by, "feature").agg(
        F.count(of("reference")).alias("n_ref"), F.count(of("current")).alias("n_cur"),
        F.avg(of("reference")).alias("reference_mean"), F.avg(of("current")).alias("current_mean"),
        F.stddev_pop(of("reference")).alias("reference_std"),
        F.stddev_pop(of("current")).alias("current_std"))


def ks_two_sample(long: DataFrame, by: Sequence[str] = ("model_name",),
                  min_sample: int = MIN_SAMPLE, range_rows: int = SLICE_ROWS) -> DataFrame:
    """Largest distance of the two empirical distributions per feature.

    Features with fewer than ``min_sample`` values on a side are left out. Values are reduced to
    counts first and ordered inside ranges of values, so the samples may have any size. A NULL key
    is a key like any other.
    """
    keys = [*by, "feature"]

    def side(name: str):
        return F.sum((F.col("side") == name).cast("long"))

    counts = long.groupBy(*keys, "value").agg(side("reference").alias("_ref"),
                                              side("current").alias("_cur"))
    ranged = by_ranges(counts, [*keys, "value"], range_rows)
    running = cumulative(ranged, keys, "_slice", [F.col("value")],
                         {"_at_ref": "_ref", "_at_cur": "_cur"})
    sizes = ranged.groupBy(*keys).agg(F.sum("_ref").alias("n_ref"), F.sum("_cur").alias("n_cur"))
    big = sizes.where((F.col("n_ref") >= min_sample) & (F.col("n_cur") >= min_sample))
    # The directory of the ranges carries the sizes, so the join key is as fine as the ranges are.
    slots = (ranged.select(*keys, "_slice").distinct().alias("l")
             .join(big.alias("r"), same_keys(keys)).select("l.*", "r.n_ref", "r.n_cur"))
    gap = F.abs(F.col("_at_ref") / F.col("n_ref") - F.col("_at_cur") / F.col("n_cur"))
    sized = (running.alias("l").join(slots.alias("r"), same_keys([*keys, "_slice"]))
             .select("l.*", "r.n_ref", "r.n_cur"))
    return sized.groupBy(*keys).agg(
        F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"),
        F.max(gap).alias("statistic"))


def compute_drift(long: DataFrame, method: str, by: Sequence[str] = ("model_name",),
                  alpha: float = ALPHA, range_rows: int = SLICE_ROWS) -> DataFrame:
    """Statistic, p-value, decision and moments per feature.

    ``method`` is ``exact``, for samples of a bounded window, or ``asymptotic``.
    """
    keys = [*by, "feature"]
    tested = ks_two_sample(long, by, range_rows=range_rows)
    p = p_value(F.col("statistic"), F.col("n_ref"), F.col("n_cur"), method)
    scored = tested.withColumn("p_value", p).withColumn("drifted", F.col("p_value") < alpha)
    return (scored.alias("l").join(moments(long, by).drop("n_ref", "n_cur").alias("r"),
                                   same_keys(keys))
            .select("l.*", *[f"r.{side}_{m}" for side in ("reference", "current")
                             for m in ("mean", "std")]))


def feature_rows(split: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Values of the logged features by model and side, from columns or from the map of the log."""
    enough = split.where((F.col("samples") >= MIN_ROWS) & F.col("side").isNotNull())
    if features is not None:
        return unpivot_features(enough, features, ["model_name", "side"])
    pairs = enough.select("model_name", "side", F.explode("features").alias("feature", "value"))
    return pairs.where("value IS NOT NULL AND NOT isnan(value)")


def drift_report(log: DataFrame, features: Sequence[str] | None = None, alpha: float = ALPHA,
                 last: int = LAST, method: str = "exact", parity_order: bool = False,
                 order: Sequence[str] = ("id",), as_of: Column | None = None) -> DataFrame:
    """One row per model: status, drifted share, alert and the tested features.

    Without ``features`` all features found in the log's map column are tested; rows without a map
    are left out before the window is split. A model alerts when at least ``max(2, tested // 3)``
    features drifted; models with fewer than ``MIN_ROWS`` logged rows are reported as
    ``insufficient_data`` with a message. ``as_of`` is the time of the report.
    """
    usable = F.size("features") > 0 if features is None else None
    split = materialize(window_split(log, last, parity_order, order=order, usable=usable), "window")
    results = compute_drift(feature_rows(split, features), method, alpha=alpha)
    detail = F.struct(
        "feature", F.round("statistic", 4).alias("statistic"),
        F.round("p_value", 4).alias("p_value"), "drifted",
        F.round("reference_mean", 2).alias("reference_mean"),
        F.round("current_mean", 2).alias("current_mean"))
    per_model = results.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total_features"),
        F.sum(F.col("drifted").cast("long")).alias("drifted_features"),
        F.array_sort(F.collect_list(detail)).alias("features"))
    models = split.groupBy("model_name").agg(F.max("samples").alias("samples"))
    total, drifted = (F.coalesce(F.col(c), F.lit(0)).alias(c)
                      for c in ("total_features", "drifted_features"))
    enough = F.col("samples") >= MIN_ROWS
    joined = models.alias("l").join(per_model.alias("r"), same_keys(["model_name"]), "left")
    wide = joined.select(
        "l.model_name", "samples",
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
        F.when(~enough, F.concat(F.lit(f"at least {MIN_ROWS} samples are needed, found "),
                                 F.col("samples").cast("string"))).alias("message"),
        (F.current_timestamp() if as_of is None else as_of.cast("timestamp")).alias("timestamp"),
        total, drifted, F.coalesce("features", F.array()).alias("features"))
    score = F.col("drifted_features") / F.greatest("total_features", F.lit(1))
    needed = F.greatest(F.lit(2), F.floor(F.col("total_features") / 3))
    return wide.withColumns({"drift_score": F.round(score, 3),
                             "alert": F.col("drifted_features") >= needed})


def parse_features(log: DataFrame, json_col: str = "features_json",
                   keep: Sequence[str] = ("id", "model_name")) -> DataFrame:
    """Logged feature objects as ``(feature, value)`` rows; text that is no object gives none."""
    parsed = F.from_json(F.col(json_col), "map<string,double>")
    return log.select(*keep, F.explode(parsed).alias("feature", "value"))
