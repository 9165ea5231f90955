"""Training, tuning and auditing of the three classifiers with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.operators import forest
from isobar.operators.forest import Forest
from isobar.operators.matrices import cyclone_matrix, heatwave_matrix, rainfall_matrix, split_test
from isobar.operators.metrics import (binary_metrics, classification_metrics,
                                      multiclass_metrics, ranked_importances)
from isobar.operators.quality import align_features
from isobar.operators.weights import pos_weight, with_balanced_weight, with_pos_weight
from isobar.plans.scoring import CONTRACTS
from isobar.schemas import RUN_METRICS
from isobar.session import materialize

CLASSES = {"cyclone": 6, "heatwave": 2, "rainfall": 2}
KEYS = {"cyclone": ["point_id"], "heatwave": ["city", "time"], "rainfall": ["city", "time"]}
MATRICES = {"cyclone": cyclone_matrix, "heatwave": heatwave_matrix, "rainfall": rainfall_matrix}

# Default learner settings.
DEFAULTS = {
    "cyclone": {"n_estimators": 200, "max_depth": 15, "random_state": 42},
    "heatwave": {"n_estimators": 150, "max_depth": 5, "learning_rate": 0.1, "subsample": 0.8,
                 "random_state": 42},
    "rainfall": {"n_estimators": 200, "max_depth": 12, "random_state": 42},
}

# Rows a node needs to be split. The learners here bound the rows of a child.
MIN_SPLIT = {"cyclone": 5, "heatwave": 10, "rainfall": 5}
# Bound of a search: about this many labelled rows, chosen by a hash of all columns.
FIT_ROWS = 1_000_000

# Search ranges (low, high, step; step None is continuous) of the parameters that
# reach the learner, number of draws and of folds.
SPACES = {
    "cyclone": {"max_depth": (4, 12, 1), "n_estimators": (100, 300, 50)},
    "heatwave": {"max_depth": (3, 10, 1), "n_estimators": (100, 300, 50),
                 "learning_rate": (0.01, 0.3, None), "subsample": (0.6, 1.0, None)},
    "rainfall": {"max_depth": (3, 10, 1), "n_estimators": (100, 300, 50),
                 "subsample": (0.6, 1.0, None)},
}
TRIALS, FOLDS, SEED = 20, 3, 42
WHOLE = ("max_depth", "n_estimators", "scale_pos_weight")


def _params(task: str, params: Mapping[str, float]) -> dict[str, float]:
    unknown = set(params) - {"n_estimators", "max_depth", "learning_rate", "subsample",
                             "random_state"}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    merged = {**DEFAULTS[task], **params}
    return {k: int(v) if k in (*WHOLE, "random_state") else float(v) for k, v in merged.items()}


def build_estimator(task: str, contract: Sequence[str] | None = None,
                    weight: str | None = "weight", **params: float) -> Pipeline:
    """Assembler, scaler and classifier; boosting for heatwaves, forests for the others.

    Node ids are cached and checkpointed so that a lost executor does not replay every level of
    every earlier tree.
    """
    p = _params(task, params)
    common = dict(featuresCol="features", labelCol="label", maxDepth=p["max_depth"],
                  minInstancesPerNode=MIN_SPLIT[task] // 2, seed=p["random_state"],
                  cacheNodeIds=True, checkpointInterval=10)
    if weight:
        common["weightCol"] = weight
    if "subsample" in p:
        common["subsamplingRate"] = p["subsample"]
    if task == "heatwave":
        learner = GBTClassifier(maxIter=p["n_estimators"], stepSize=p["learning_rate"], **common)
    else:
        learner = RandomForestClassifier(numTrees=p["n_estimators"], **common)
    assembler = VectorAssembler(inputCols=list(contract or CONTRACTS[task]),
                                outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    return Pipeline(stages=[assembler, scaler, learner])


def with_weights(df: DataFrame, task: str) -> DataFrame:
    """Balanced weights for the forests, a positive weight for boosting."""
    return with_pos_weight(df) if task == "heatwave" else with_balanced_weight(df)


def bounded(df: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` rows of ``df``, or all if there are no more."""
    n = df.count()
    if n <= rows:
        return df
    draw = F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) / 1_000_000
    return df.where(draw < rows / n)


def fit(df: DataFrame, task: str, contract: Sequence[str] | None = None, balanced: bool = True,
        **params: float) -> PipelineModel | Forest:
    """Fit a task's learner on all rows of a matrix with ``label``.

    The forests are those of ``operators.forest``, whose trees grow side by side: the trees of
    ``pyspark.ml`` grow together, with many passes whose sums and nodes meet on the driver.
    """
    contract = list(contract or CONTRACTS[task])
    ready = align_features(df, contract, ["label"])
    if task != "heatwave":
        p = _params(task, params)
        return forest.fit(ready, contract, forest.Settings(
            CLASSES[task], p["n_estimators"], p["max_depth"], MIN_SPLIT[task] // 2, balanced,
            p.get("subsample", 1.0), p["random_state"]))
    if balanced:
        ready = with_weights(ready, task)
    return build_estimator(task, contract, "weight" if balanced else None, **params).fit(ready)


def predict(model: PipelineModel | Forest, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (class) and ``probabilities`` (array)."""
    out = model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    return (out.withColumn("prediction", F.col("prediction").cast("int"))
            .drop("raw_features", "features", "rawPrediction", "probability"))


def evaluate(model: PipelineModel | Forest, df: DataFrame, task: str) -> DataFrame:
    """Metrics of a model on a matrix as (metric, value) rows."""
    return measure(predict(model, df), task)


def measure(scored: DataFrame, task: str) -> DataFrame:
    """Metrics of scored rows as (metric, value) rows."""
    if CLASSES[task] > 2:
        return multiclass_metrics(scored, CLASSES[task])
    return binary_metrics(scored.withColumn("score", F.get("probabilities", 1)))


def run_metrics(metrics: DataFrame, run_id: str, model: str, split: str) -> DataFrame:
    return metrics.select(F.lit(run_id).alias("run_id"), F.lit(model).alias("model"),
                          F.lit(split).alias("split"), "metric", "value").select(*RUN_METRICS.names)


def train(processed: DataFrame, task: str, run_id: str, test: float = 0.2,
          fit_with: Callable = fit, predict_with: Callable = predict,
          **params: float) -> tuple[object, DataFrame]:
    """Matrix, stratified split, fit, and metrics and rows of the train and test parts.

    The matrix and the scored rows are written out once: learner and metrics read them often.
    Other learners come as a function that fits a matrix and one that predicts it.
    """
    matrix = materialize(MATRICES[task](processed), "matrix")
    marked = materialize(split_test(matrix, key=KEYS[task], test=test), f"matrix-{task}")
    model = fit_with(marked.where(~F.col("is_test")), task, **params)
    scored = materialize(predict_with(model, marked).select(
        "label", "prediction", "probabilities", "is_test"), f"scored-{task}")
    parts = {"train": scored.where(~F.col("is_test")), "test": scored.where("is_test")}
    tables = [run_metrics(measure(part, task).unionAll(part.select(
        F.lit("rows"), F.count(F.lit(1)).cast("double"))), run_id, task, name)
        for name, part in parts.items()]
    return model, tables[0].unionByName(tables[1])


def train_all(processed: Mapping[str, DataFrame], run_id: str,
              params: Mapping[str, Mapping[str, float]] | None = None
              ) -> tuple[dict[str, PipelineModel | Forest], DataFrame]:
    """Train every task that has a processed frame; one metrics table for all."""
    models, tables = {}, []
    for task, frame in processed.items():
        models[task], table = train(frame, task, run_id, **(params or {}).get(task, {}))
        tables.append(table)
    metrics = tables[0]
    for table in tables[1:]:
        metrics = metrics.unionByName(table)
    return models, metrics


def importances(model: PipelineModel | Forest, contract: Sequence[str]) -> DataFrame:
    """Contract features ranked by the learner's importance."""
    values = (model.importances() if isinstance(model, Forest)
              else model.stages[-1].featureImportances.toArray())
    pairs = [(name, float(v)) for name, v in zip(contract, values)]
    spark = SparkSession.active()
    return ranked_importances(spark.createDataFrame(pairs, "feature string, importance double"))


def draw(space: Mapping[str, tuple], trials: int, seed: int = SEED) -> list[dict[str, float]]:
    """Seeded random settings from the search ranges."""
    rng = np.random.default_rng(seed)
    settings = []
    for _ in range(trials):
        one = {}
        for name, (low, high, step) in space.items():
            if step is None:
                one[name] = float(rng.uniform(low, high))
            else:
                one[name] = int(low + step * rng.integers(0, (high - low) // step + 1))
        settings.append(one)
    return settings


def tune(df: DataFrame, task: str, trials: int = TRIALS, folds: int = FOLDS,
         space: Mapping[str, tuple] | None = None, parallelism: int = 4,
         seed: int = SEED) -> tuple[dict[str, float], DataFrame]:
    """Random search under cross-validation: best settings, and one row per trial.

    Folds come from a hash of the key. A heatwave trial also draws the positive weight, which is
    held in one weight column per distinct draw. A failing trial raises.
    """
    space = dict(space or SPACES[task])
    contract = CONTRACTS[task]
    if task == "heatwave" and "scale_pos_weight" not in space:
        ratio = pos_weight(df).first()["scale_pos_weight"]
        space["scale_pos_weight"] = (max(1, ratio // 2), max(1, ratio * 2), 1)
    settings = draw(space, trials, seed)
    fold = F.pmod(F.xxhash64(*KEYS[task], F.lit(seed)), F.lit(folds)).cast("int")
    ready = bounded(align_features(df.withColumn("fold", fold), contract, ["label", "fold"]))
    weights = sorted({s["scale_pos_weight"] for s in settings if "scale_pos_weight" in s})
    if weights:
        ready = ready.withColumns({
            f"weight_{w}": F.when(F.col("label") == 1, float(w)).otherwise(1.0) for w in weights})
    else:
        ready = with_balanced_weight(ready)
    pipeline = build_estimator(task, contract, None if weights else "weight")
    learner = pipeline.getStages()[-1]
    size = learner.maxIter if task == "heatwave" else learner.numTrees
    params = {"max_depth": learner.maxDepth, "n_estimators": size,
              "subsample": learner.subsamplingRate}
    if task == "heatwave":
        params["learning_rate"] = learner.stepSize
    grid = []
    for s in settings:
        point = {params[k]: v for k, v in s.items() if k in params}
        if "scale_pos_weight" in s:
            point[learner.weightCol] = f"weight_{s['scale_pos_weight']}"
        grid.append(point)
    if CLASSES[task] > 2:
        evaluator = MulticlassClassificationEvaluator(metricName="f1")
    else:
        evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator,
                        numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed)
    fitted: CrossValidatorModel = cv.fit(materialize(ready, f"folds-{task}"))
    rows = [(i, evaluator.getMetricName(), float(score), {k: float(v) for k, v in s.items()})
            for i, (s, score) in enumerate(zip(settings, fitted.avgMetrics))]
    best = settings[int(np.argmax(fitted.avgMetrics))]
    table = df.sparkSession.createDataFrame(
        rows, "trial int, metric string, score double, settings map<string,double>")
    return best, table


def ablation(processed: DataFrame, task: str, feature: str, **params: float) -> DataFrame:
    """Test accuracy with all features, without one, and with only that one."""
    contract = list(CONTRACTS[task])
    subsets = {"full": contract, "without": [c for c in contract if c != feature],
               "only": [feature]}
    whole = materialize(MATRICES[task](processed), "matrix")
    matrix = materialize(split_test(whole, key=KEYS[task]), "ablation")
    train_part, test_part = matrix.where(~F.col("is_test")), matrix.where("is_test")
    rows = None
    for name, cols in subsets.items():
        model = fit(train_part, task, contract=cols, **params)
        scored = materialize(predict(model, test_part).select("label", "prediction"), "ablation")
        row = classification_metrics(scored).select(
            F.lit(name).alias("subset"), F.lit(feature).alias("feature"), "accuracy")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def save(model: PipelineModel | Forest, path: str) -> None:
    if isinstance(model, Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | Forest:
    return forest.load(SparkSession.active(), path) or PipelineModel.load(path)
