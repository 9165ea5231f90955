"""Exact classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.operators.ranking import SLICE_ROWS, by_ranges, cumulative

# Probabilities are clipped by the double-precision epsilon before taking logarithms.
EPSILON = 2.220446049250313e-16


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[int], label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """One row per true class, one column ``p<class>`` per predicted class."""
    wide = (confusion(df, label, prediction).groupBy("label")
            .pivot("prediction", list(classes)).agg(F.sum("n")))
    return wide.select("label", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"p{c}")
                                  for c in classes])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def per_class_metrics(df: DataFrame, label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """Support, precision, recall and F1 of every class that occurs as label or prediction."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").cast("int").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("prediction").cast("int").alias("class"),
                 F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    sums = cells.select(F.inline(sides)).groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    scored = sums.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")),
                               "recall": _ratio(F.col("tp"), F.col("support"))})
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1).select(
        "class", "support", "predicted", "precision", "recall", "f1")


def classification_metrics(df: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, one row."""
    classes = per_class_metrics(df, label, prediction)
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col("support") * F.col(c)), n).alias(c)

    # Recall weighted by support is the share of hits, which is the accuracy.
    return classes.agg(n.alias("n"), weighted("recall").alias("accuracy"),
                       weighted("precision"), weighted("recall"), weighted("f1"))


def _auc(rows: DataFrame, by: Sequence[str], range_rows: int) -> DataFrame:
    """Mann-Whitney area per group from (score, positive) rows; ties count half.

    Scores are reduced to distinct values before they are ordered.
    """
    pos = F.col("_pos").cast("long")
    known = rows.where("_score IS NOT NULL AND _pos IS NOT NULL")
    counted = known.groupBy(*by, "_score").agg(F.sum(pos).alias("_p"), F.sum(1 - pos).alias("_m"))
    ranked = cumulative(by_ranges(counted, [*by, "_score"], range_rows), by, "_slice",
                        [F.col("_score")], {"_below": "_m"})
    wins = F.sum(F.col("_p").cast("double") * (F.col("_below") - F.col("_m") / 2))
    pairs = F.sum("_p").cast("double") * F.sum("_m").cast("double")
    area = F.coalesce(F.try_divide(wins, pairs), F.lit(0.5))
    return ranked.groupBy(*by).agg(area.alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            range_rows: int = SLICE_ROWS) -> DataFrame:
    """Binary area under the ROC curve, one row; 0.5 if a class is absent."""
    rows = df.select(F.col(score).cast("double").alias("_score"),
                     (F.col(label) == 1).alias("_pos"))
    return _auc(rows, [], range_rows)


def roc_auc_by_class(df: DataFrame, label: str, probabilities: str, n_classes: int,
                     range_rows: int = SLICE_ROWS) -> DataFrame:
    """One-versus-rest area of each class from an array of class probabilities."""
    sides = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.struct(
        k.alias("class"), F.get(F.col(probabilities), k).cast("double").alias("_score"),
        (F.col(label) == k).alias("_pos")))
    return _auc(df.select(F.inline(sides)), ["class"], range_rows)


def roc_auc_ovr(df: DataFrame, label: str, probabilities: str, n_classes: int,
                range_rows: int = SLICE_ROWS) -> DataFrame:
    """Unweighted mean of the one-versus-rest areas.

    With two classes among the labels it is the area of class 1 against the rest, with one class,
    or with more but not all, 0.5.
    """
    areas = roc_auc_by_class(df, label, probabilities, n_classes, range_rows)
    present = df.agg(F.count_distinct(label).alias("n")).scalar()
    return areas.agg(F.when(present == n_classes, F.avg("roc_auc")).when(
        present == 2, F.max(F.when(F.col("class") == 1, F.col("roc_auc")))).otherwise(0.5)
        .alias("roc_auc"))


def _mean_loss(df: DataFrame, of_truth: Column) -> DataFrame:
    clipped = F.least(F.greatest(of_truth, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.agg((-F.avg(F.ln(clipped))).alias("log_loss"))


def log_loss(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Binary log loss of the positive-class probability."""
    p = F.col(score)
    return _mean_loss(df, F.when(F.col(label) == 1, p).when(F.col(label) == 0, 1 - p))


def log_loss_multiclass(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    return _mean_loss(df, F.get(F.col(probabilities), F.col(label).cast("int")))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   score: str = "score") -> DataFrame:
    """All binary metrics as rows ``(metric, value)``."""
    return _long(classification_metrics(df, label, prediction).drop("n"),
                 roc_auc(df, label, score), log_loss(df, label, score))


def multiclass_metrics(df: DataFrame, n_classes: int, label: str = "label",
                       prediction: str = "prediction",
                       probabilities: str = "probabilities") -> DataFrame:
    return _long(classification_metrics(df, label, prediction).drop("n"),
                 roc_auc_ovr(df, label, probabilities, n_classes),
                 log_loss_multiclass(df, label, probabilities))


def _long(*frames: DataFrame) -> DataFrame:
    """Stack one-row frames as (metric, value) rows."""
    out = None
    for frame in frames:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"),
                                   F.col(c).cast("double").alias("value")) for c in frame.columns])
        rows = frame.select(F.inline(pairs))
        out = rows if out is None else out.unionByName(rows)
    return out


def ranked_importances(pairs: DataFrame) -> DataFrame:
    """Feature importances (one row per contract feature) with their rank."""
    order = Window.orderBy(F.desc("importance"), F.col("feature"))
    return pairs.withColumn("rank", F.row_number().over(order))
