"""Batch scoring of model inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.functions.events import (argmax_class, category_text, confidence, positive,
                                     probability_map, severity_band)
from isobar.operators.forest import Forest
from isobar.operators.quality import validate_features
from isobar.schemas import (CYCLONE_FEATURES, CYCLONE_RULES, HEATWAVE_FEATURES, HEATWAVE_RULES,
                            RAINFALL_FEATURES, RAINFALL_RULES, Rule)

CONTRACTS: dict[str, Sequence[str]] = {
    "cyclone": CYCLONE_FEATURES, "heatwave": HEATWAVE_FEATURES, "rainfall": RAINFALL_FEATURES}
RULES: dict[str, Mapping[str, Rule]] = {
    "cyclone": CYCLONE_RULES, "heatwave": HEATWAVE_RULES, "rainfall": RAINFALL_RULES}


def heatwave_decision(probability: Column) -> dict[str, Column]:
    return {"heatwave_probability": F.round(probability, 3), "is_heatwave": positive(probability),
            "severity": severity_band(probability), "confidence": confidence(probability)}


def rainfall_decision(probability: Column) -> dict[str, Column]:
    return {"extreme_rainfall_probability": F.round(probability, 3),
            "is_extreme": positive(probability), "confidence": confidence(probability)}


def cyclone_decision(probabilities: Column) -> dict[str, Column]:
    category = argmax_class(probabilities)
    return {"category": category, "description": category_text(category),
            "probabilities": probability_map(probabilities),
            "confidence": F.array_max(probabilities)}


def decide(df: DataFrame, task: str, probabilities: str = "probabilities") -> DataFrame:
    """Add the decision columns of a task from its array of class probabilities."""
    p = F.col(probabilities)
    if task == "cyclone":
        return df.withColumns(cyclone_decision(p))
    rule = heatwave_decision if task == "heatwave" else rainfall_decision
    return df.withColumns(rule(F.get(p, 1))).drop(probabilities)


def score(model: PipelineModel | Forest, df: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """(scored rows with decisions, quarantined rows with the rules they break)."""
    valid, quarantine = validate_features(df, RULES[task])
    scored = model.transform(valid).withColumn("probabilities", vector_to_array("probability"))
    internal = [c for c in ("raw_features", "features", "rawPrediction", "probability",
                            "prediction") if c in scored.columns]
    return decide(scored.drop(*internal), task), quarantine


def to_prediction_log(scored: DataFrame, task: str, as_of: Column,
                      row_id: Column | None = None) -> DataFrame:
    """Scored rows in the shape of the prediction log.

    ``id`` orders the rows of one call, by ``row_id`` if given; rows of several calls are in the
    order of ``(timestamp, id)``.
    """
    names = CONTRACTS[task]
    features = F.map_from_arrays(F.array(*[F.lit(c) for c in names]),
                                 F.array(*[F.col(c).cast("double") for c in names]))
    outcome = {"cyclone": "category", "heatwave": "is_heatwave", "rainfall": "is_extreme"}[task]
    return scored.select((F.monotonically_increasing_id() if row_id is None else row_id).alias("id"),
                         F.lit(task).alias("model_name"),
                         as_of.cast("timestamp").alias("timestamp"), features.alias("features"),
                         F.col(outcome).cast("string").alias("prediction"))
