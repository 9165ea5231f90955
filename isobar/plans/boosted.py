"""The three classifiers as boosted trees, and the adaptive search of their settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.operators import boosting
from isobar.operators.boosting import Boosted, Settings
from isobar.operators.metrics import _auc, ranked_importances
from isobar.operators.quality import align_features
from isobar.operators.ranking import SLICE_ROWS
from isobar.operators.weights import pos_weight
from isobar.plans import training
from isobar.plans.scoring import CONTRACTS
from isobar.plans.training import CLASSES, FIT_ROWS, KEYS, bounded
from isobar.session import materialize

# Default learner settings.
DEFAULTS = {
    "cyclone": {"n_estimators": 200, "max_depth": 8, "learning_rate": 0.1, "random_state": 42},
    "heatwave": {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.08,
                 "scale_pos_weight": 5, "random_state": 42},
    "rainfall": {"n_estimators": 200, "max_depth": 8, "learning_rate": 0.1,
                 "scale_pos_weight": 10, "random_state": 42},
}

# Search ranges (low, high, step; step None is continuous), draws and folds. The range
# of the positive weight follows from the classes, see ``search_space``.
SPACES = {
    "cyclone": {"max_depth": (4, 12, 1), "n_estimators": (100, 300, 50),
                "learning_rate": (0.01, 0.3, None), "min_child_weight": (1, 10, 1),
                "subsample": (0.6, 1.0, None), "colsample_bytree": (0.6, 1.0, None)},
    "heatwave": {"max_depth": (3, 10, 1), "n_estimators": (100, 300, 50),
                 "learning_rate": (0.01, 0.3, None), "subsample": (0.6, 1.0, None),
                 "colsample_bytree": (0.6, 1.0, None)},
}
SPACES["rainfall"] = SPACES["heatwave"]
TRIALS, FOLDS, SEED = 20, 3, 42

# The search: random trials first, then trials drawn side by side; the best share of the trials so
# far is the good part, and the best of so many candidates drawn from it is tried.
STARTUP, BATCH, GOOD, CANDIDATES = 8, 4, 0.25, 24


def settings_for(task: str, **params: float) -> Settings:
    """The default settings of a task with some replaced; counts become whole numbers."""
    merged = {**DEFAULTS[task], **params}
    unknown = set(merged) - set(Settings.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    whole = {"n_estimators", "max_depth", "random_state", "bins", "classes"}
    return Settings(**{"classes": CLASSES[task],
                       **{k: int(v) if k in whole else float(v) for k, v in merged.items()}})


def fit(df: DataFrame, task: str, contract: Sequence[str] | None = None,
        block_rows: int = boosting.BLOCK_ROWS, **params: float) -> Boosted:
    """Fit a task's boosted trees on all rows of a matrix with ``label``."""
    contract = list(contract or CONTRACTS[task])
    return boosting.fit(align_features(df, contract, ["label"]), contract,
                        settings_for(task, **params), block_rows=block_rows)


def train(processed: DataFrame, task: str, run_id: str, test: float = 0.2,
          **params: float) -> tuple[Boosted, DataFrame]:
    """As :func:`training.train`, with boosted trees."""
    return training.train(processed, task, run_id, test, fit, boosting.predict, **params)


def importances(spark: SparkSession, model: Boosted) -> DataFrame:
    """Features ranked by the mean gain of their splits."""
    pairs = [(name, float(v)) for name, v in zip(model.features, model.importances())]
    return ranked_importances(spark.createDataFrame(pairs, "feature string, importance double"))


# ---- search ----

Space = Mapping[str, tuple]


def search_space(df: DataFrame, task: str) -> dict[str, tuple]:
    """The ranges of a task; for two classes the positive weight lies around their ratio."""
    space = dict(SPACES[task])
    if CLASSES[task] == 2:
        ratio = pos_weight(df).first()["scale_pos_weight"]
        space["scale_pos_weight"] = (max(1, ratio // 2), max(1, ratio * 2), 1)
    return space


def _on_grid(value: float, low: float, high: float, step: float | None) -> float:
    value = min(max(value, low), high)
    return value if step is None else float(min(low + step * round((value - low) / step), high))


class Parzen:
    """A density over a range: a normal at every point seen and a wide one over the whole range.

    The width of a point's normal is its larger distance to a neighbour, so that it narrows where
    points lie close.
    """

    def __init__(self, points: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        span = max(high - low, 1e-12)
        ends = np.concatenate(([low], np.sort(points), [high]))
        gaps = np.diff(ends)
        wide = np.clip(np.maximum(gaps[:-1], gaps[1:]), span / min(100, 1 + len(ends)), span)
        self.at = np.append(ends[1:-1], (low + high) / 2)
        self.width = np.append(wide, span)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        no = rng.integers(0, len(self.at), n)
        return np.clip(rng.normal(self.at[no], self.width[no]), self.low, self.high)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        far = (np.asarray(x)[:, None] - self.at) / self.width
        return np.log(np.mean(np.exp(-far ** 2 / 2) / self.width, axis=1) + 1e-300)


def suggest(space: Space, done: Sequence[tuple[Mapping[str, float], float]], number: int,
            rng: np.random.Generator) -> list[dict[str, float]]:
    """The next ``number`` settings after the trials ``done`` (settings, score; higher is better).

    The first ``STARTUP`` are drawn evenly. Later each value is the candidate of the density of the
    good trials that most exceeds the density of the others.
    """
    ranked = sorted(done, key=lambda x: -x[1])
    good = ranked[:max(int(np.ceil(GOOD * len(ranked))), 1)]
    out = []
    for no in range(number):
        one = {}
        for name, (low, high, step) in space.items():
            if len(done) + no < STARTUP or len(done) < 2:
                value = (rng.uniform(low, high) if step is None
                         else low + step * rng.integers(0, int((high - low) // step) + 1))
            else:
                above, below = (Parzen([s[name] for s, _ in part], low, high)
                                for part in (good, ranked[len(good):]))
                some = above.draw(rng, CANDIDATES)
                value = some[np.argmax(above.log_density(some) - below.log_density(some))]
            one[name] = _on_grid(float(value), low, high, step)
        out.append(one)
    return out


def adapt(space: Space, evaluate: Callable[[list[dict[str, float]]], list[float]], trials: int,
          seed: int = SEED) -> list[tuple[dict[str, float], float]]:
    """``trials`` settings with their scores, ``BATCH`` of them evaluated at a time."""
    rng, done = np.random.default_rng(seed), []
    while len(done) < trials:
        limit = STARTUP if len(done) < STARTUP else trials
        some = suggest(space, done, min(BATCH, limit - len(done), trials - len(done)), rng)
        done += list(zip(some, evaluate(some)))
    return done


def _fitted_folds(task: str, folds: int):
    """Fits one (trial, fold) per row on the other folds and predicts the fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                settings = settings_for(task, **dict(row["settings"]))
                rows, fold = boosting.unpacked(row, settings)
                own = fold == row["out"]
                model = Boosted([], [], settings,
                                boosting.fit_rows(boosting.some(rows, ~own)))
                p = boosting.probabilities(boosting.margins(model, rows.bins[:, own]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), row["trial"], np.int32)),
                     pa.array(np.full(len(p), row["out"], np.int32)), pa.array(rows.label[own]),
                     pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p[:, -1])],
                    ["trial", "fold", "label", "prediction", "score"])

    return run


def _weighted_f1(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """F1 of the classes, weighted by their rows, per group."""
    cells = rows.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    sides = F.array(*[F.struct(
        F.col(c).alias("class"), F.when(F.lit(c == "label"), F.col("n")).otherwise(0).alias("support"),
        F.col("n").alias("n"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
        for c in ("label", "prediction")])
    per = cells.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), (F.sum("hit") / F.sum("n")).alias("f1"))
    # Hits count on both sides: 2 tp / (support + predicted).
    return per.groupBy(*by).agg((F.sum(F.col("support") * F.col("f1")) / F.sum("support"))
                                .alias("value"))


def search(df: DataFrame, task: str, trials: int = TRIALS, folds: int = FOLDS,
           space: Space | None = None, rows: int = FIT_ROWS,
           seed: int = SEED) -> tuple[dict[str, float], DataFrame]:
    """Adaptive search under cross-validation: the best settings, and one row per trial.

    Folds come from a hash of the key. The rows, about ``rows`` of them, are aligned and binned
    once; every (trial, fold) is one Spark task over that block, and the trials of a batch run side by
    side. The score is the mean over the folds of the area under the ROC curve, or of the weighted
    F1 where a task has more classes. A failing trial raises.
    """
    if rows > FIT_ROWS:
        raise ValueError(f"a search fits at most {FIT_ROWS} rows per task")
    contract = CONTRACTS[task]
    space = search_space(df, task) if space is None else space
    spark = df.sparkSession
    ready = bounded(align_features(df, contract, ["label", *KEYS[task]]), rows)
    cuts = boosting.cut_points(ready, contract, Settings().bins)
    fold = F.pmod(F.xxhash64(*KEYS[task], F.lit(seed)), F.lit(folds))
    block = boosting.blocks(ready, contract, cuts, rows=2 * FIT_ROWS, fold=fold)
    tried = 0

    def evaluate(some: list[dict[str, float]]) -> list[float]:
        nonlocal tried
        asked = [(no * folds + k, 0, tried + no, k, s) for no, s in enumerate(some)
                 for k in range(folds)]
        tasks = spark.createDataFrame(
            asked, "no int, block int, trial int, out int, settings map<string,double>")
        # Few rows of bounded size meet the only block; one partition each.
        fitted = tasks.join(block, "block").repartitionByRange(len(asked), "no").mapInArrow(
            _fitted_folds(task, folds),
            "trial int, fold int, label int, prediction int, score double")
        fitted = materialize(fitted, "trials")
        if CLASSES[task] > 2:
            scores = _weighted_f1(fitted, ["trial", "fold"])
        else:
            scores = _auc(fitted.select("trial", "fold", F.col("score").alias("_score"),
                                        (F.col("label") == 1).alias("_pos")),
                          ["trial", "fold"], SLICE_ROWS).withColumnRenamed("roc_auc", "value")
        found = dict(scores.groupBy("trial").agg(F.avg("value")).collect())
        tried += len(some)
        return [float(found.get(tried - len(some) + no, 0.0)) for no in range(len(some))]

    done = adapt(space, evaluate, trials, seed)
    metric = "f1" if CLASSES[task] > 2 else "areaUnderROC"
    table = spark.createDataFrame(
        [(no, metric, score, {k: float(v) for k, v in s.items()})
         for no, (s, score) in enumerate(done)],
        "trial int, metric string, score double, settings map<string,double>")
    return max(done, key=lambda x: x[1])[0], table
