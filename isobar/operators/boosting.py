"""Gradient boosted trees of second order on histograms, for two or more classes.

Features are cut into bins at quantiles; a missing value has a bin of its own and goes to the side
that gains more. Each round grows one tree per class (one in all for two classes) level by level:
the sums of gradients and hessians per node, feature and bin decide all splits of a level. These
sums are integers, gradients being rounded to ``STEP``, so they do not depend on how the rows
are dealt, and neither do the trees.

Of two nodes with one parent only that with less hessian is summed; the other is the parent's rest.

Rows lie in blocks of up to ``BLOCK_ROWS``, columns end to end. A fit of few rows runs inside one task.
Many rows are dealt to tasks that run at the same time, and each adds up its own; they meet after
every level, by files in the shared folder, and all choose the same splits. Where no such tasks or
files can be had, Spark adds up the sums, one job per level. What is exchanged depends on nodes,
features and bins but not on rows.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.session import materialize, new_path

STEP = 2.0 ** -20
BLOCK_ROWS = 1 << 20
# Rounds after which the margins of all rows are written down again, if there are several blocks.
REWRITE = 20
ACCURACY = 100_000
# Rows from which a fit is dealt to tasks that run at the same time.
SIDE_ROWS = 1 << 18
# Bytes of an array of a task beyond which it lies in a temporary file.
ROOM = 1 << 28
# Bytes of sums that every task reads from all others; of more it adds up a share for all.
WHOLE_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Numbers of a fit; ``classes`` is 2 for a logistic loss, more for a softmax."""

    classes: int = 2
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    min_gain: float = 1e-6
    scale_pos_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    random_state: int = 42
    bins: int = 64

    @property
    def margins(self) -> int:
        return 1 if self.classes == 2 else self.classes


@dataclass
class Level:
    """The nodes of one depth of a tree: leaves have feature -1, others children from ``child`` on."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    child: np.ndarray
    value: np.ndarray
    gain: np.ndarray


Tree = list[Level]


@dataclass
class Boosted:
    """A fitted model: cuts of every feature, and per round the trees of all margins."""

    features: list[str]
    cuts: list[np.ndarray]
    settings: Settings
    rounds: list[list[Tree]] = field(default_factory=list)

    def importances(self) -> np.ndarray:
        """Mean gain of the splits of every feature, as shares of their sum."""
        total, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for level in (x for trees in self.rounds for tree in trees for x in tree):
            split = level.feature >= 0
            np.add.at(total, level.feature[split], level.gain[split])
            np.add.at(n, level.feature[split], 1)
        mean = total / np.maximum(n, 1)
        return mean / mean.sum() if mean.sum() else mean


def room(shape: int | tuple[int, ...], dtype: type) -> np.ndarray:
    """An array of zeros, of a temporary file if it is large."""
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if size <= ROOM:
        return np.zeros(shape, dtype)
    with tempfile.TemporaryFile() as file:  # goes with the array
        return np.memmap(file, dtype, "w+", shape=shape)


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 for a missing value, else 1 + the number of cuts below it."""
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(cuts, values, "left")).astype(np.uint8)


def _steps(level: Level, n: int) -> tuple[np.ndarray, ...]:
    """By node, and at the end for rows that stand nowhere: the value, where the row of its feature
    starts among bins of ``n`` rows end to end, what a bin is lowered by, the last bin of the left
    side after that, and the left child.

    Bins of one byte: a missing value is lowered to 255, or stays 0 where it goes to the left.
    """
    split = level.feature >= 0
    less = np.append(np.where(split & ~level.missing_left, 1, 0), 0).astype(np.uint8)
    return (np.append(np.where(split, 0.0, level.value), 0.0),
            np.append(np.where(split, level.feature, 0), 0) * n, less,
            np.append(np.where(split, level.bin, 255), 255).astype(np.uint8) - less,
            np.append(np.where(split, level.child, -1), -1))


def _fall(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The value of the leaf that every column of ``bins`` (features x rows) reaches."""
    n = bins.shape[1]
    out, every, at, own = np.zeros(n), np.arange(n), np.zeros(n, int), bins.reshape(-1)
    for level in tree:
        value, start, less, last, child = _steps(level, n)
        if (level.feature < 0).any():
            out += value[at]
        if not (level.feature >= 0).any():
            break
        at = child[at] + (own[start[at] + every] - less[at] > last[at])
    return out


def probabilities(margin: np.ndarray) -> np.ndarray:
    """Class probabilities from margins (rows x margins)."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return np.hstack((1 - p, p))
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def margins(model: Boosted, bins: np.ndarray, first: int = 0) -> np.ndarray:
    """Sums of the leaves of all rounds from ``first`` on, rows x margins."""
    out = np.zeros((bins.shape[1], model.settings.margins))
    for trees in model.rounds[first:]:
        for k, tree in enumerate(trees):
            out[:, k] += _fall(tree, bins)
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class Rows:
    """The rows of one block, and where they stand in the trees of the current round."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, draw: np.ndarray, margin: np.ndarray,
                 settings: Settings):
        self.bins, self.label, self.draw = bins, label, draw
        self.margin, self.settings = margin, settings
        # Features two by two: their bins as one number.
        self.width = settings.bins + 1
        self.pairs = room((len(bins) // 2, len(label)), np.uint16)
        for k, pair in enumerate(self.pairs):
            np.multiply(bins[2 * k], self.width, out=pair, dtype=np.uint16, casting="unsafe")
            pair += bins[2 * k + 1]
        self.sums = room((2, settings.margins, len(label)), np.float64)
        self.at = room((settings.margins, len(label)), np.int32)

    def start(self, no: int) -> None:
        """Gradients and hessians of round ``no``; rows that it leaves out stand nowhere."""
        s, p = self.settings, probabilities(self.margin)
        for k in range(s.margins):
            if s.margins == 1:
                weight = np.where(self.label == 1, s.scale_pos_weight, 1.0)
                g, h = ((p[:, 1] - (self.label == 1)) * weight, p[:, 1] * (1 - p[:, 1]) * weight)
            else:
                g, h = p[:, k] - (self.label == k), 2 * p[:, k] * (1 - p[:, k])
            for out, x in zip(self.sums[:, k], (g, h)):
                np.rint(x / STEP, out=out)
        self.at[:], self.moves, self.out = 0, 0, None
        if s.subsample < 1:
            seed = ((s.random_state << 20) + no + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
            drawn = _spread(self.draw + np.uint64(seed)) >> np.uint64(11)
            self.out = np.flatnonzero(drawn * 2.0 ** -53 >= s.subsample)
            self.at[:, self.out] = -1

    def histograms(self, wanted: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Per margin the sums as (2, node, feature, bin) for the nodes that are wanted."""
        out, n_f, width = [], len(self.bins), self.width
        for k, nodes in enumerate(wanted):
            n = int(nodes.sum())
            found = np.zeros((2, n, n_f, width))
            out.append(found)
            if not n:
                continue
            rows, at = slice(None), self.at[k].astype(np.int64)
            if not nodes.all() or at.min(initial=0) < 0:
                rank = np.append(np.where(nodes, np.cumsum(nodes) - 1, -1), -1)
                at = rank[at]
                rows = np.flatnonzero(at >= 0)
                at = at[rows]
            sums = self.sums[:, k, rows]
            # Two features at once where that makes fewer cells than rows.
            paired = 2 * (n_f // 2) if 2 * n * width * width <= len(at) else 0
            for f in range(0, paired, 2):
                cell = at * (width * width) + self.pairs[f // 2, rows]
                for part in (0, 1):
                    both = np.bincount(cell, sums[part], n * width * width).reshape(n, width, width)
                    found[part, :, f], found[part, :, f + 1] = both.sum(axis=2), both.sum(axis=1)
            for f in range(paired, n_f):
                cell = at * width + self.bins[f, rows]
                for part in (0, 1):
                    found[part, :, f] = np.bincount(cell, sums[part], n * width).reshape(n, width)
        return out

    def move(self, levels: Sequence[Level]) -> None:
        """Rows go to the children of their nodes; those in leaves take the value and stand nowhere."""
        n = len(self.label)
        own, every = self.bins.reshape(-1), np.arange(n)
        for k, level in enumerate(levels):
            value, start, less, last, child = _steps(level, n)
            at = self.at[k].astype(np.int64)
            if (level.feature < 0).any():
                self.margin[:, k] += value[at]
            self.at[k] = (child[at] + (own[start[at] + every] - less[at] > last[at])
                          if (level.feature >= 0).any() else -1)
        self.moves += 1

    def finish(self, trees: Sequence[Tree]) -> None:
        """Rows go on to their leaves in the trees of the round."""
        for at in range(self.moves, max(map(len, trees), default=0)):
            self.move([tree[at] if at < len(tree) else _leaves(np.zeros(0), np.zeros(0), self.settings)
                       for tree in trees])
        if self.out is not None and len(self.out):
            for k, tree in enumerate(trees):
                self.margin[self.out, k] += _fall(tree, self.bins[:, self.out])


def _leaves(g: np.ndarray, h: np.ndarray, s: Settings) -> Level:
    n, g, h = len(g), g * STEP, h * STEP
    return Level(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n, int),
                 -s.learning_rate * g / (h + s.reg_lambda), np.zeros(n))


def choose(sums: np.ndarray, able: np.ndarray, totals: np.ndarray | None, allowed: np.ndarray,
           s: Settings) -> tuple[Level, np.ndarray]:
    """The best split of every node that is able to split, and the (2, child) sums of the children.

    ``totals`` holds the sums of all nodes; for the root they follow from its bins. A gain must pass
    ``min_gain`` and both sides hold ``min_child_weight`` of hessian. Ties go to the first feature,
    then to missing values on the right, then to the lowest bin.
    """
    if totals is None:
        totals = sums[:, :, 0].sum(axis=2)
    level = _leaves(totals[0], totals[1], s)
    if not able.any() or sums.shape[2] == 0:
        return level, np.zeros((2, 0))
    sides = [np.cumsum(sums[..., 1:-1], axis=-1)]                        # missing to the right
    if sums[..., 0].any():
        sides.append(sides[0] + sums[..., :1])                           # and to the left
    lg, lh = np.stack(sides, axis=3) * STEP
    total_g, total_h = totals[:, able] * STEP
    rg, rh = total_g[:, None, None, None] - lg, total_h[:, None, None, None] - lh
    gain = (lg ** 2 / (lh + s.reg_lambda) + rg ** 2 / (rh + s.reg_lambda)
            - (total_g ** 2 / (total_h + s.reg_lambda))[:, None, None, None])
    gain[(lh < s.min_child_weight) | (rh < s.min_child_weight)] = -np.inf
    gain[:, ~allowed] = -np.inf
    flat = gain.reshape(len(gain), -1)
    top = flat.max(axis=1)
    # Equal gains may differ in their last bits, so the first within a hair of the best counts.
    best = np.argmax(flat >= (top * (1 - 1e-12))[:, None], axis=1)
    feature, side, cut = np.unravel_index(best, gain.shape[1:])
    split = top > s.min_gain
    nodes = np.flatnonzero(able)[split]
    level.feature[nodes], level.bin[nodes] = feature[split], cut[split] + 1
    level.missing_left[nodes], level.gain[nodes] = side[split] == 1, top[split]
    level.child[nodes] = 2 * np.arange(len(nodes))
    at = np.flatnonzero(split)
    left = np.rint(np.stack((lg, lh))[:, at, feature[at], side[at], cut[at]] / STEP)
    return level, np.stack((left, totals[:, nodes] - left), axis=2).reshape(2, -1)


def _wanted(levels: Sequence[Level], able: Sequence[np.ndarray],
            totals: Sequence[np.ndarray | None]) -> list[np.ndarray]:
    """Of every two children the one with less hessian, unless neither is able to split."""
    out = []
    for nodes, t in zip(able, totals):
        wanted = nodes.copy()
        if t is not None and t.size:
            left = t[1, ::2] <= t[1, 1::2]
            wanted = np.column_stack((left, ~left)).ravel() & np.repeat(nodes[::2] | nodes[1::2], 2)
        out.append(wanted)
    return out


def _whole(found: np.ndarray, wanted: np.ndarray, able: np.ndarray, level: Level | None,
           before: np.ndarray | None, could: np.ndarray | None) -> np.ndarray:
    """The sums of the able nodes, from those of the wanted ones and of the parents that could split."""
    if level is None or not able.any():
        return found
    parents = np.flatnonzero(level.feature >= 0)
    pairs = np.flatnonzero(wanted[::2] | wanted[1::2])
    own = before[:, (np.cumsum(could) - 1)[parents[pairs]]]
    both = np.empty((2, len(pairs), 2, *found.shape[2:]))
    right, every = wanted[1::2][pairs].astype(int), np.arange(len(pairs))
    both[:, every, right], both[:, every, 1 - right] = found, own - found
    return both.reshape(2, -1, *found.shape[2:])[:, np.repeat(wanted[::2] | wanted[1::2], 2).nonzero()[0]
                                                 .searchsorted(np.flatnonzero(able))]


Histograms = Callable[[int, list[list[Level]], list[np.ndarray]], list[np.ndarray]]


def _round(no: int, histograms: Histograms, s: Settings, n_features: int) -> list[Tree]:
    """One tree per margin. ``histograms`` gives the sums of the wanted nodes for the levels so far."""
    rng = np.random.default_rng([s.random_state, no])
    allowed = np.zeros((s.margins, n_features), dtype=bool)
    for own_features in allowed:
        own_features[rng.permutation(n_features)[:max(int(s.colsample_bytree * n_features), 1)]] = True
    trees: list[Tree] = [[] for _ in allowed]
    levels, totals = [], [None] * len(allowed)
    sums, could = [None] * len(allowed), [None] * len(allowed)
    for depth in range(s.max_depth):
        able = [np.ones(1, bool) if t is None else t[1] * STEP >= 2 * s.min_child_weight
                for t in totals]
        last = levels[-1] if levels else [None] * len(allowed)
        wanted = _wanted(last, able, totals)
        found = histograms(no, levels, wanted)
        sums = [_whole(*x) for x in zip(found, wanted, able, last, sums, could)]
        could = able
        grown = [choose(*x, s) for x in zip(sums, able, totals, allowed)]
        levels.append([level for level, _ in grown])
        for tree, (level, _) in zip(trees, grown):
            tree.append(level)
        totals = [below for _, below in grown]
        if not any(t.size for t in totals):
            return trees
    for tree, t in zip(trees, totals):
        tree.append(_leaves(t[0], t[1], s))
    return trees


def fit_rows(*rows: Rows, total: Callable[[list[np.ndarray]], list[np.ndarray]] = lambda own: own,
             like: tuple[Settings, int] | None = None) -> list[list[Tree]]:
    """All rounds over the blocks at hand. ``total`` adds to their sums those of rows elsewhere.

    Without a block at hand, ``like`` are the settings and the number of features.
    """
    s, n_features = like or (rows[0].settings, len(rows[0].bins))

    def histograms(no: int, levels: list[list[Level]], wanted: list[np.ndarray]) -> list[np.ndarray]:
        found = [np.zeros((2, int(x.sum()), n_features, s.bins + 1)) for x in wanted]
        for block in rows:
            if levels:
                block.move(levels[-1])
            else:
                block.start(no)
            for whole, own in zip(found, block.histograms(wanted)):
                whole += own
        return total(found)

    rounds = []
    for no in range(s.n_estimators):
        rounds.append(_round(no, histograms, s, n_features))
        for block in rows:
            block.finish(rounds[-1])
    return rounds


# ---- Spark ----

BLOCK = "block int, n int, bins binary, label binary, draw binary, fold binary"
# Blocks of one task that packs rows in order.
PLACES = 1 << 12


def cut_points(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins - 1`` distinct cuts per feature, at quantiles of its known values."""
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)),
                                         shares, ACCURACY).alias(str(k))
                     for k, c in enumerate(features)]).first()
    return [np.unique(np.array(x or [], dtype=float)) for x in found]


def blocks(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray],
           rows: int = BLOCK_ROWS, label: str = "label", fold: Column | None = None,
           tasks: int = 1, in_order: bool = False) -> DataFrame:
    """The rows of ``df`` with a label as blocks of up to about ``rows``, as a written table.

    From ``SIDE_ROWS`` rows on there are ``tasks`` blocks at least. With ``in_order`` the rows follow
    each other by ``draw`` through the blocks, sorted by their numbers.
    """
    known = df.where(F.col(label).isNotNull()).select(
        *[F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)],
        F.col(label).cast("int").alias("label"),
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("draw"))
    if in_order:
        known = known.withColumn("place", F.monotonically_increasing_id())
    known = materialize(known, "fit")
    count = known.count()
    number = max(-(-count // rows), tasks if count >= SIDE_ROWS else 1, 1)

    def pack(batches: Iterator[pa.RecordBatch], no: int | None = None) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]  # one block: bounded
        if not tables or not sum(map(len, tables)):
            return
        rows = pa.concat_tables(tables).combine_chunks()
        bins = np.stack([binned(rows.column(f"f{k}").to_numpy().astype(float), c)
                         for k, c in enumerate(cuts)]) if len(cuts) else np.zeros((0, len(rows)))
        columns = [bins.astype(np.uint8), *(rows.column(c).to_numpy().astype(t) for c, t in (
            ("label", np.int32), ("draw", np.int64), ("fold", np.int32)))]
        block = rows.column("block")[:1].combine_chunks() if no is None else pa.array([no], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [block, pa.array([len(rows)], pa.int32()),
             *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
            ["block", "n", "bins", "label", "draw", "fold"])

    def pack_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, held, n = TaskContext.get().partitionId() * PLACES, [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from pack(held, no)
                no, held, n = no + 1, [], 0
        yield from pack(held, no)

    if in_order:
        # Equal rows lie side by side, in any order: the row's place only spreads them.
        above = F.col("draw").bitwiseXOR(F.lit(-1 << 63))  # in the order of numbers without a sign
        dealt = known.repartition(1) if number == 1 else known.repartitionByRange(number, above, "place")
        return materialize(dealt.sortWithinPartitions(above).mapInArrow(pack_in_order, BLOCK), "blocks")
    # Equal rows may hash into one block only if they are few; the row's place spreads them.
    placed = known.withColumn("block", F.pmod(F.xxhash64(
        "draw", F.monotonically_increasing_id()), F.lit(number)).cast("int"))
    placed = placed if number == 1 else materialize(placed, "placed")
    dealt = placed.repartition(1) if number == 1 else placed.repartitionByRange(number, "block")
    grouped = dealt.sortWithinPartitions("block", "draw") if number > 1 else dealt
    packed = grouped.mapInArrow(lambda b: _by_block(b, pack), BLOCK)
    return materialize(packed, "blocks")


def _by_block(batches: Iterator[pa.RecordBatch], pack: Callable) -> Iterator[pa.RecordBatch]:
    """``pack`` over the batches of one block after the other; they come sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        no = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.append(True, no[1:] != no[:-1])).tolist() if len(no) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(no)]):
            if held and held[0].column("block")[0].as_py() != no[lo]:
                yield from pack(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    yield from pack(held)


def unpacked(row: Mapping, settings: Settings) -> tuple[Rows, np.ndarray]:
    """The rows of a block, with margins of zero, and their folds."""
    n = row["n"]
    label, fold = (np.frombuffer(row[c] or b"", dtype=np.int32) for c in ("label", "fold"))
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, n)
    margin = row.get("margin")
    known = room((settings.margins, n), np.float64).T  # the values of a margin lie end to end
    if margin is not None:
        known[:] = np.frombuffer(margin, dtype=float).reshape(n, -1)
    return Rows(bins, label, np.frombuffer(row["draw"], dtype=np.uint64), known, settings), fold


def some(rows: Rows, keep: np.ndarray) -> Rows:
    return Rows(np.ascontiguousarray(rows.bins[:, keep]), rows.label[keep], rows.draw[keep],
                rows.margin[keep].copy(), rows.settings)


class Meeting:
    """Sums over the tasks of a barrier stage, by files in a folder that all of them reach.

    Every task writes its own sums. Of many, a task adds up its share and writes that, so that no
    task reads more than about twice what it writes.
    """

    def __init__(self, folder: str, me: int, tasks: int):
        self.store, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.me, self.tasks, self.no, self.old, self.new = me, tasks, 0, [], []
        self.store.create_dir(self.folder, recursive=True)

    def _put(self, kind: str, data: np.ndarray) -> None:
        name = f"{self.folder}/{kind}-{self.no}-{self.me}"
        with self.store.open_output_stream(f"{self.folder}/new-{self.me}") as out:
            out.write(data.tobytes())
        self.store.move(f"{self.folder}/new-{self.me}", name)  # appears whole
        self.new.append(name)

    def _get(self, kind: str, lo: int = 0, hi: int | None = None) -> Iterator[np.ndarray]:
        """The numbers from ``lo`` to ``hi`` of all tasks, in their order."""
        for task in range(self.tasks):
            name, wait = f"{self.folder}/{kind}-{self.no}-{task}", 0.0005
            while self.store.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
                time.sleep(wait)
                wait = min(2 * wait, 0.05)
            with self.store.open_input_file(name) as file:
                size = file.size() // 8
                stop = size if hi is None else hi
                yield np.frombuffer(file.read_at((stop - lo) * 8, lo * 8))

    def total(self, own: list[np.ndarray]) -> list[np.ndarray]:
        mine = np.concatenate([x.ravel() for x in own])
        self._put("own", mine)
        if mine.nbytes <= WHOLE_BYTES:
            whole = sum(self._get("own"), np.zeros(len(mine)))
        else:
            cuts = np.linspace(0, len(mine), self.tasks + 1).astype(int)
            lo, hi = cuts[self.me:self.me + 2]
            self._put("share", sum(self._get("own", int(lo), int(hi)), np.zeros(hi - lo)))
            whole = np.concatenate(list(self._get("share")))
        for name in self.old:  # all have been here again since they read these
            self.store.delete_file(name)
        self.no, self.old, self.new = self.no + 1, self.new, []
        ends = np.cumsum([x.size for x in own])[:-1]
        return [x.reshape(y.shape) for x, y in zip(np.split(whole, ends), own)]


def _side_by_side(table: DataFrame, model: Boosted, tasks: int) -> Boosted | None:
    """Fit ``model`` on the blocks of ``table`` in ``tasks`` tasks that run at the same time.

    Every task holds some blocks and adds up their sums; all meet after every level and choose the
    same splits. None if Arrow does not reach the shared folder.
    """
    s, spark, folder = model.settings, table.sparkSession, new_path(table.sparkSession, "sums")
    folder = folder[len("file:"):] if folder.startswith("file:") and "://" not in folder else folder
    try:
        store, name = pyarrow.fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        rows = [unpacked(row, s)[0] for batch in batches for row in batch.to_pylist()]
        attempt = context.allGather(uuid.uuid4().hex)[0]  # a repeated stage has files of its own
        meeting = Meeting(f"{folder}/{attempt}", context.partitionId(), tasks)
        rounds = fit_rows(*rows, total=meeting.total, like=(s, len(model.features)))
        if not context.partitionId():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dumps(Boosted(model.features, model.cuts, s, rounds))])], ["model"])

    dealt = table.drop("fold").repartitionByRange(tasks, "block")
    found = materialize(dealt.selectExpr("*", "cast(null as binary) fold").mapInArrow(
        run, "model string", barrier=True), "model")
    store.delete_dir(name)
    return loads(found.first()["model"])


def _together(spark: SparkSession, most: int) -> int:
    """How many tasks are sure to run at the same time, ``most`` at most."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1  # executors come and go
    return min(most, spark.sparkContext.defaultParallelism)


def fit_blocks(table: DataFrame, model: Boosted) -> Boosted:
    """Fit ``model`` on a table of :func:`blocks`; Spark adds up sums only if tasks cannot meet."""
    s = model.settings
    sizes = [r["n"] for r in table.select("n").collect()]
    tasks = _together(table.sparkSession, len(sizes))
    if len(sizes) > 1 and tasks > 1 and sum(sizes) >= SIDE_ROWS:
        fitted = _side_by_side(table, model, tasks)
        if fitted:
            return fitted
    if len(sizes) <= 1:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    model.rounds = fit_rows(unpacked(row, s)[0])
                    yield pa.RecordBatch.from_arrays([pa.array([dumps(model)])], ["model"])

        found = table.mapInArrow(run, "model string").first()
        return loads(found["model"]) if found else model

    def histograms(no: int, levels: list[list[Level]], able: list[np.ndarray]) -> list[np.ndarray]:
        since = Boosted(model.features, [], s, model.rounds[start:])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    rows, _ = unpacked(row, s)
                    rows.margin += margins(since, rows.bins)
                    rows.start(no)
                    for level in levels:
                        rows.move(level)
                    found = np.concatenate([x.reshape(2, -1) for x in rows.histograms(able)], axis=1)
                    used = np.flatnonzero(found.any(axis=0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(used), *(pa.array(x.astype(np.int64)) for x in found[:, used])],
                        ["cell", "g", "h"])

        added = (current.mapInArrow(run, "cell bigint, g bigint, h bigint").groupBy("cell")
                 .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow())
        shapes = [(2, int(n.sum()), len(model.features), s.bins + 1) for n in able]
        sizes = [int(np.prod(x[1:])) for x in shapes]
        whole = np.zeros((2, sum(sizes)))
        whole[:, added.column("cell").to_numpy()] = [added.column(c).to_numpy() for c in "gh"]
        return [x.reshape(shape) for x, shape in zip(
            np.split(whole, np.cumsum(sizes)[:-1], axis=1), shapes)]

    current, start = table, 0
    for no in range(s.n_estimators):
        if no - start >= REWRITE:
            current, start = _rewritten(current, Boosted(model.features, [], s, model.rounds[start:])), no
        model.rounds.append(_round(no, histograms, s, len(model.features)))
    return model


def _rewritten(table: DataFrame, since: Boosted) -> DataFrame:
    """The blocks with the margins after the rounds of ``since``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows, _ = unpacked(row, since.settings)
                out.append((rows.margin + margins(since, rows.bins)).tobytes())
            keep = [c for c in batch.schema.names if c != "margin"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "margin"])

    return materialize(table.mapInArrow(run, f"{BLOCK}, margin binary"), "blocks")


def fit(df: DataFrame, features: Sequence[str], settings: Settings, label: str = "label",
        block_rows: int = BLOCK_ROWS) -> Boosted:
    """Fit on all rows of ``df`` that have a label; without any the model knows no tree."""
    cuts = cut_points(df, features, settings.bins)
    table = blocks(df, features, cuts, block_rows, label, tasks=_together(df.sparkSession, 1 << 16))
    return fit_blocks(table, Boosted(list(features), cuts, settings))


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction`` (class) and ``probabilities`` (array); missing values are allowed."""
    sent = df.sparkSession.sparkContext.broadcast(dumps(model))  # bounded by rounds and depth
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loads(sent.value)
        for batch in batches:
            inputs = batch.column("_features").flatten()
            bins = np.stack([binned(x.to_numpy(zero_copy_only=False).astype(float), c)
                             for x, c in zip(inputs, known.cuts)])
            p = probabilities(margins(known, bins))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(p.argmax(axis=1).astype(np.int32)),
                 lists], [*columns, "prediction", "probabilities"])

    given = df.withColumn("_features", F.struct(
        *[F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(model.features)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return given.mapInArrow(run, f"{schema}, prediction int, probabilities array<double>")


def dumps(model: Boosted) -> str:
    """The model as JSON."""
    return json.dumps({
        "features": model.features, "cuts": [c.tolist() for c in model.cuts],
        "settings": asdict(model.settings),
        "rounds": [[_listed(tree) for tree in trees] for trees in model.rounds]})


LEVEL = {"feature": int, "bin": int, "missing_left": bool, "child": int, "value": float, "gain": float}


def _listed(tree: Tree) -> list:
    return [[getattr(x, c).tolist() for c in LEVEL] for x in tree]


def _tree(raw: list) -> Tree:
    return [Level(*(np.array(v, dtype=t) for v, t in zip(x, LEVEL.values()))) for x in raw]


def loads(text: str) -> Boosted:
    raw = json.loads(text)
    rounds = [[_tree(tree) for tree in trees] for trees in raw["rounds"]]
    return Boosted(raw["features"], [np.array(c, dtype=float) for c in raw["cuts"]],
                   Settings(**raw["settings"]), rounds)


def nodes_table(spark: SparkSession, model: Boosted) -> DataFrame:
    """One row per node: round, margin, depth, place, and what the node holds."""
    parts = [pd.DataFrame({"round": no, "margin": k, "depth": d, "place": np.arange(len(x.feature)),
                           **{c: getattr(x, c) for c in LEVEL}})
             for no, trees in enumerate(model.rounds) for k, tree in enumerate(trees)
             for d, x in enumerate(tree)]
    schema = ("round int, margin int, depth int, place int, feature int, bin int, "
              "missing_left boolean, child int, value double, gain double")
    return spark.createDataFrame(pd.concat(parts), schema) if parts else spark.createDataFrame([], schema)


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    """The model as a text file of one line in a folder of ``path``."""
    spark.createDataFrame([(dumps(model),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    return loads(spark.read.text(path).first()["value"])
