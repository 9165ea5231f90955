"""Random forests of Gini trees on histograms, grown side by side.

Features are cut into bins at quantiles; a missing value has the lowest bin. Every tree draws its rows
(how often each counts is Poisson) and, for every node, its features (the root of their number), and
grows level by level from the rows per node, bin and class. Trees do not need each other, so a
Spark task grows some of them from start to end over all binned rows, and no sums are exchanged
between levels. Many rows lie in a temporary file of the task and are counted a chunk at a time.
Neither draws nor trees depend on how the rows or the trees are dealt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.operators.boosting import BLOCK_ROWS, binned, blocks, cut_points, room
from isobar.session import materialize

# Cells (node, bin, class) that are compared at a time, and that are counted in one pass over the rows.
CELLS = 1 << 20
PASS_CELLS = 1 << 22
# Rows that are counted at a time.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Settings:
    """Numbers of a fit; ``min_rows`` is what each child of a split holds at least."""

    classes: int = 2
    n_estimators: int = 100
    max_depth: int = 10
    min_rows: int = 1
    balanced: bool = True
    subsample: float = 1.0
    random_state: int = 42
    bins: int = 32


@dataclass
class Tree:
    """Nodes level by level: feature (-1: leaf), last bin of the left side, and the left child, or
    for a leaf its row of ``shares``."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    shares: np.ndarray
    gain: np.ndarray  # by feature


KINDS = {"feature": np.int8, "bin": np.uint8, "child": np.int32, "shares": np.float32,
         "gain": np.float64}


def class_weights(n: np.ndarray, s: Settings) -> np.ndarray:
    """``total / (k * n_class)`` from the rows of every class for the ``k`` classes that occur, or 1."""
    k = np.count_nonzero(n)
    return n.sum() / (k * np.maximum(n, 1)) if s.balanced and k > 1 else np.ones(len(n))


def _gini(parts: np.ndarray) -> np.ndarray:
    """Sum of squares over the sum of the last axis: the weight less its impurity."""
    return (parts ** 2).sum(axis=-1) / np.maximum(parts.sum(axis=-1), 1e-300)


def _best(n: np.ndarray, weight: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Best score and its bin per node from its rows per bin and class; -inf without a split."""
    sums, held = n * weight, n.sum(axis=2)
    left, n_left = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(held, axis=1)
    n_left, n_all = n_left[:, :-1], n_left[:, -1:]
    whole = sums.sum(axis=1, keepdims=True)
    value = _gini(left) + _gini(np.maximum(whole - left, 0)) - _gini(whole)
    value[(n_left < s.min_rows) | (n_all - n_left < s.min_rows)] = -np.inf
    return value.max(axis=1), value.argmax(axis=1)


class Drawn:
    """The rows that a tree draws, chunk by chunk: which they are, how often each counts, its node."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, s: Settings, rng: np.random.Generator):
        self.bins, self.label, self.s = bins, label, s
        self.row, self.times, self.at = (room(len(label), t) for t in (np.int32, np.uint16, np.int32))
        self.held = []
        for lo in range(0, len(label), CHUNK):
            drawn = rng.poisson(s.subsample, min(CHUNK, len(label) - lo))
            self._keep(lo, np.flatnonzero(drawn), drawn[drawn > 0], 0)
        if not sum(m for _, m in self.held):
            self.held = []
            for lo in range(0, len(label), CHUNK):
                n = min(CHUNK, len(label) - lo)
                self._keep(lo, np.arange(n), np.ones(n, np.uint16), 0)

    def _keep(self, lo: int, row: np.ndarray, times: np.ndarray, at: np.ndarray | int) -> None:
        part = slice(lo, lo + len(row))
        self.row[part], self.times[part], self.at[part] = row, times, at
        self.held.append((lo, len(row)))

    def _chunks(self):
        for lo, m in self.held:
            if m:
                row = self.row[lo:lo + m].astype(np.int64)
                yield (lo, row, self.label[lo:lo + CHUNK][row].astype(np.int64),
                       self.at[lo:lo + m].astype(np.int64), self.times[lo:lo + m].astype(float))

    def classes(self, n_nodes: int) -> np.ndarray:
        """Rows per node and class."""
        k = self.s.classes
        found = np.zeros(n_nodes * k)
        for _, _, cell, at, times in self._chunks():
            found += np.bincount(at * k + cell, times, len(found))
        return found.reshape(n_nodes, k)

    def counts(self, items: Sequence[tuple[int, np.ndarray]], n_nodes: int) -> list[np.ndarray]:
        """Rows per node, bin and class for every one of ``items (feature, nodes)``."""
        k, width = self.s.classes, self.s.bins + 1
        ranks = []
        for _, nodes in items:
            ranks.append(np.full(n_nodes, -1))
            ranks[-1][nodes] = np.arange(len(nodes))
        found = [np.zeros(len(nodes) * width * k) for _, nodes in items]
        for lo, row, cell, at, times in self._chunks():
            for no, ((f, nodes), rank) in enumerate(zip(items, ranks)):
                place, column = rank[at], self.bins[f, lo:lo + CHUNK]
                if len(nodes) < n_nodes:
                    own = np.flatnonzero(place >= 0)
                    place = (place[own] * width + column[row[own]]) * k + cell[own]
                    found[no] += np.bincount(place, times[own], len(found[no]))
                else:
                    found[no] += np.bincount((place * width + column[row]) * k + cell, times,
                                             len(found[no]))
        return [x.reshape(-1, width, k) for x in found]

    def move(self, split: np.ndarray, feature: np.ndarray, cut: np.ndarray,
             child: np.ndarray) -> bool:
        """Rows of split nodes go to the children, others go; whether any are left."""
        before, self.held = self.held, []
        for lo, m in before:
            row, times, at = (x[lo:lo + m] for x in (self.row, self.times, self.at))
            keep = split[at]
            row, times, at = row[keep], times[keep], at[keep].astype(np.int64)
            right = self.bins[feature[at], row.astype(np.int64) + lo] > cut[at]
            self._keep(lo, row, times, child[at] + right)
        return any(m for _, m in self.held)


def _passes(items: Sequence[tuple[int, np.ndarray]], size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """``items (feature, nodes)`` in order, in groups of up to ``PASS_CELLS`` cells of ``size`` a node."""
    group, cells = [], 0
    for f, nodes in items:
        if group and cells + len(nodes) * size > PASS_CELLS:
            yield group
            group, cells = [], 0
        group.append((f, nodes))
        cells += len(nodes) * size
    if group:
        yield group


def grow(bins: np.ndarray, label: np.ndarray, s: Settings, no: int) -> Tree:
    """Tree ``no`` of a forest over ``bins`` (features x rows)."""
    rng, n_features = np.random.default_rng([s.random_state, no]), len(bins)
    rows = Drawn(bins, label, s, rng)
    known = np.zeros(s.classes, dtype=np.int64)
    for lo in range(0, len(label), CHUNK):
        known += np.bincount(label[lo:lo + CHUNK], minlength=s.classes)
    weight = class_weights(known, s)
    tries, size = int(np.ceil(np.sqrt(n_features))), (s.bins + 1) * s.classes
    step = max(CELLS // size, 1)
    n_nodes, done = 1, 0
    parts = {k: [] for k in ("feature", "bin", "child", "shares")}
    gain, leaves = np.zeros(n_features), 0
    for depth in range(s.max_depth + 1):
        held = rows.classes(n_nodes)
        total, n = held * weight, held.sum(axis=1)
        best, feature = np.zeros(n_nodes), np.full(n_nodes, -1)
        cut = np.zeros(n_nodes, int)
        if depth < s.max_depth:
            able = ((total > 0).sum(axis=1) > 1) & (n >= 2 * s.min_rows)
            chosen = rng.random((n_nodes, n_features)).argsort(axis=1)[:, :tries]
            tried = [(f, np.flatnonzero(able & (chosen == f).any(axis=1))) for f in range(n_features)]
            items = [(f, nodes[lo:lo + step]) for f, nodes in tried for lo in range(0, len(nodes), step)]
            for group in _passes(items, size):
                for (f, nodes), counted in zip(group, rows.counts(group, n_nodes)):
                    score, place = _best(counted, weight, s)
                    # A gain within rounding of zero is none.
                    better = (score > best[nodes]) & (score > 1e-12 * total[nodes].sum(axis=1))
                    hit = nodes[better]
                    best[hit], feature[hit], cut[hit] = score[better], f, place[better]
        split = feature >= 0
        np.add.at(gain, feature[split], best[split])
        below = 2 * (np.cumsum(split) - 1)
        child = np.where(split, done + n_nodes + below, leaves + np.cumsum(~split) - 1)
        for k, x in zip(parts, (feature, cut, child, (total / np.maximum(
                total.sum(axis=1, keepdims=True), 1e-300))[~split])):
            parts[k].append(x)
        leaves += int((~split).sum())
        if not split.any() or not rows.move(split, feature, cut, below):
            break
        done, n_nodes = done + n_nodes, 2 * int(split.sum())
    return Tree(*(np.concatenate(x).astype(KINDS[k]) for k, x in parts.items()),
                gain / gain.sum() if gain.sum() else gain)


def fall(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The shares of the classes in the leaf that every column of ``bins`` reaches."""
    out = np.zeros(bins.shape[1], dtype=np.int64)
    rows, at = np.arange(bins.shape[1]), np.zeros(bins.shape[1], dtype=np.int64)
    while len(rows):
        feature = tree.feature[at]
        leaf = feature < 0
        if leaf.any():
            out[rows[leaf]] = tree.child[at[leaf]]
            rows, at, feature = rows[~leaf], at[~leaf], feature[~leaf]
        at = tree.child[at] + (bins[feature, rows] > tree.bin[at])
    return tree.shares[out]


# ---- Spark ----

ARROW = [("no", pa.int32()), *((k, pa.binary()) for k in KINDS)]
TREE = "no int, " + ", ".join(f"{k} binary" for k in KINDS)


def _packed(no: int, tree: Tree) -> dict:
    return {"no": no, **{k: getattr(tree, k).astype(t).tobytes() for k, t in KINDS.items()}}


def _tree(row: Mapping, classes: int) -> Tree:
    found = {k: np.frombuffer(row[k], dtype=t) for k, t in KINDS.items()}
    return Tree(**{**found, "shares": found["shares"].reshape(-1, classes)})


class Forest:
    """A fitted forest; its trees are the rows of a written table."""

    def __init__(self, features: Sequence[str], cuts: Sequence[np.ndarray], settings: Settings,
                 trees: DataFrame):
        self.features, self.cuts, self.settings, self.trees = list(features), cuts, settings, trees
        self._sent = None

    def importances(self) -> np.ndarray:
        """Mean over the trees of the share of every feature in the gains, as shares of their sum."""
        found = [np.frombuffer(r["gain"]) for r in self.trees.select("no", "gain").orderBy("no").collect()]
        mean = np.sum(found, axis=0) if found else np.zeros(len(self.features))
        return mean / mean.sum() if mean.sum() else mean

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (vector) and ``prediction`` (class)."""
        if self._sent is None:  # bounded by the trees, their depth and the rows of a fit
            self._sent = df.sparkSession.sparkContext.broadcast(
                self.trees.drop("gain").orderBy("no").toArrow())
        sent, cuts, s, columns = self._sent, self.cuts, self.settings, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [_tree({**r, "gain": b""}, s.classes) for b in sent.value.to_batches()
                     for r in b.to_pylist()]
            for batch in batches:
                inputs = batch.column("_features").flatten()
                bins = np.stack([binned(x.to_numpy(zero_copy_only=False).astype(float), c)
                                 for x, c in zip(inputs, cuts)])
                p = np.zeros((len(batch), s.classes))
                for tree in trees:
                    p += fall(tree, bins)
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, p.size + 1, s.classes, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), lists,
                     pa.array(p.argmax(axis=1).astype(float))],
                    [*columns, "probability", "prediction"])

        given = df.withColumn("_features", F.struct(
            *[F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(self.features)]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return given.mapInArrow(run, f"{schema}, probability array<double>, prediction double") \
            .withColumn("probability", array_to_vector("probability"))

    def save(self, path: str) -> None:
        """The trees as a table, the rest as a text file of one line, in folders of ``path``."""
        about = json.dumps({"class": NAME, "features": self.features, "settings": asdict(self.settings),
                            "cuts": [c.tolist() for c in self.cuts]})
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        self.trees.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/metadata")


NAME = "isobar.Forest"


def load(spark: SparkSession, path: str) -> Forest | None:
    """The forest saved at ``path``; None if a model of another kind lies there."""
    about = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if about["class"] != NAME:
        return None
    return Forest(about["features"], [np.array(c, dtype=float) for c in about["cuts"]],
                  Settings(**about["settings"]), spark.read.schema(TREE).parquet(f"{path}/trees"))


def fit(df: DataFrame, features: Sequence[str], settings: Settings, label: str = "label",
        block_rows: int = BLOCK_ROWS) -> Forest:
    """Fit on all rows of ``df`` that have a label.

    Their blocks go to as many tasks as there are cores, and every task grows its share of the trees.
    """
    spark, s = df.sparkSession, settings
    cuts = cut_points(df, features, s.bins)
    table = blocks(df, features, cuts, block_rows, label, in_order=True)
    sizes = sorted((r["block"], r["n"]) for r in table.select("block", "n").collect())
    ends = np.cumsum([n for _, n in sizes], dtype=np.int64).tolist()
    first = {block: end - n for (block, n), end in zip(sizes, ends)}
    tasks = max(min(spark.sparkContext.defaultParallelism, s.n_estimators), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = {}  # by part: one, as a rule
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                part, lo, n = row["part"].as_py(), first[row["block"].as_py()], row["n"].as_py()
                if part not in given:
                    given[part] = room((len(cuts), ends[-1]), np.uint8), room(ends[-1], np.int32)
                bins, known = given[part]
                bins[:, lo:lo + n] = np.frombuffer(row["bins"].as_buffer(), np.uint8).reshape(-1, n)
                known[lo:lo + n] = np.frombuffer(row["label"].as_buffer(), np.int32)
        for part, (bins, known) in given.items():
            for no in range(part, s.n_estimators, tasks):
                yield pa.RecordBatch.from_pylist([_packed(no, grow(bins, known, s, no))],
                                                 pa.schema(ARROW))

    parts = spark.range(tasks).select(F.col("id").cast("int").alias("part"))
    dealt = parts.crossJoin(table.select("block", "n", "bins", "label")).repartitionByRange(
        tasks, "part")
    return Forest(features, cuts, s, materialize(dealt.mapInArrow(run, TREE), "trees"))
