"""Hard negatives by exact integer inner products, several candidates to a multiplication.

The components of a block of candidates and of its anchors are shifted to be at least zero, so that
every inner product fits a field of a known number of bits. As many candidates as fit are packed into
one integer, one field each; an inner product of packed integers with an anchor multiplies each of
the anchor's components once for all of them, and the fields of the result are the single products,
from which the shifts are taken off again. Integers below 2^53 are held exactly by doubles, which
multiply fastest; wider ones are Python integers.

Anchors and candidates meet in cells of a block of both, so a task holds two blocks and a strip of
scores, whatever the tables hold. A first pass over the cells finds the positives of every anchor,
a second one the negatives below each of them; both keep only the best of a cell.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.llm.common import stored

POSITIVES = 5
NEGATIVES = 5
# A negative has at least this percentage of the positive's score.
PERCENT = 80
# Rows of a block, and scores of a strip.
CANDIDATES = 1 << 15
ANCHORS = 1 << 11
STRIP = 1 << 22
EXACT_BITS = 53
WIDE_FIELDS = 16
LONG = (1 << 63) - 1


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices, exact: one row per anchor, one column per row.

    Products that may leave 64 bits come as Python integers.
    """
    dims = anchors.shape[1]
    if not dims or not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    low_a, low_b = int(anchors.min()), int(rows.min())
    high = (int(anchors.max()) - low_a) * (int(rows.max()) - low_b) * dims
    width = max(high.bit_length(), 1)
    kind = np.float64 if width <= EXACT_BITS else object
    fields = EXACT_BITS // width or WIDE_FIELDS
    whole = object if kind is object else np.int64
    up_a, up_b = anchors.astype(whole) - low_a, rows.astype(whole) - low_b
    padded = np.zeros((-(-len(rows) // fields) * fields, dims), dtype=up_b.dtype)
    padded[:len(rows)] = up_b
    words = padded[::fields].copy()
    for k in range(1, fields):
        words += padded[k::fields] << (k * width)
    product = (up_a.astype(kind) @ words.astype(kind).T).astype(whole)
    out = np.empty((len(anchors), len(padded)), dtype=whole)
    for k in range(fields):
        out[:, k::fields] = (product >> (k * width)) & ((1 << width) - 1)
    out = out[:, :len(rows)]
    if whole is object or _bound(anchors, rows) > LONG:
        out, anchors, rows = (x.astype(object) for x in (out, anchors, rows))
    # sum (a - la)(b - lb) = sum ab - la sum b - lb sum a + d la lb
    return (out + low_a * rows.sum(axis=1)[None, :] + low_b * anchors.sum(axis=1)[:, None]
            - dims * low_a * low_b)


def _bound(a: np.ndarray, b: np.ndarray) -> int:
    top_a, top_b = (max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b))
    return 400 * top_a * top_b * a.shape[1]


def _ints(lists: pa.Array, dims: int) -> np.ndarray:
    """A matrix of the components, Python integers where some leave 32 bits."""
    flat = lists.flatten().to_numpy()
    if flat.size and np.abs(flat).max() >= 2.0 ** 31:
        whole = np.empty(flat.size, dtype=object)
        whole[:] = [int(x) for x in flat.tolist()]
        return whole.reshape(len(lists), dims)
    return flat.astype(np.int64).reshape(len(lists), dims)


def _best(scores: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """The places of the highest scores; the rows are in the order in which ties go."""
    if len(places) > most and scores.dtype != object:
        least = np.partition(scores[places], len(places) - most)[len(places) - most]
        places = places[scores[places] >= least]
    return places[np.argsort(-scores[places], kind="stable")][:most]


def _positives(scores: np.ndarray, same: np.ndarray, own: np.ndarray, _) -> Iterator[tuple]:
    for place in _best(scores, np.flatnonzero(same & ~own), POSITIVES):
        yield 0, place


def _negatives(scores: np.ndarray, same: np.ndarray, _, positives: list[int]) -> Iterator[tuple]:
    """For each positive score the best rows of other labels between it and its percentage."""
    if positives[0] < 0:
        return
    fit = np.flatnonzero(~same & (100 * scores >= PERCENT * max(min(positives), 0))
                         & (scores <= positives[0]))
    for nth, top in enumerate(positives):
        inside = fit[(100 * scores[fit] >= PERCENT * top) & (scores[fit] <= top)]
        for place in _best(scores, inside, NEGATIVES):
            yield nth, place


def _cell(choose):
    """Chosen rows per anchor of a cell, as (anchor, nth, row, vec_id, score)."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last
        size = rows.column("values").combine_chunks().value_lengths().to_numpy()
        out: list[tuple] = []
        for dims in np.unique(size):
            part = rows.filter(pa.array(size == dims))
            leads = part.column("leads").to_numpy()
            heads, others = part.filter(pa.array(leads)), part.filter(pa.array(~leads))
            if not len(heads) or not len(others):
                continue
            a, b = (_ints(x.column("values").combine_chunks(), int(dims)) for x in (heads, others))
            label_a, label_b = (x.column("label").to_numpy() for x in (heads, others))
            row_a, row_b = (x.column("row").to_numpy() for x in (heads, others))
            ids, asked = others.column("vec_id"), heads.column("asked").to_pylist()
            step = max(STRIP // len(b), 1)
            for at in range(0, len(a), step):
                scores = packed_scores(a[at:at + step], b)
                if scores.dtype == object:
                    scores = np.clip(scores, -LONG - 1, LONG)
                for k, line in enumerate(scores, at):
                    for nth, place in choose(line, label_b == label_a[k], row_b == row_a[k], asked[k]):
                        out.append((row_a[k], nth, row_b[place], ids[place].as_py(),
                                    int(line[place])))
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int32() if k == 1 else pa.int64())
                         for k, c in enumerate(columns)], names=["anchor", "nth", "row", "id", "score"])

    return run


FOUND = "anchor bigint, nth int, row bigint, id bigint, score bigint"


def _blocks(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """Rows dealt into blocks of about ``size``: the number of blocks follows from a count."""
    number = max(-(-rows.count() // size), 1)
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(number)).cast("int")), number


def _meet(anchors: DataFrame, rows: DataFrame, choose) -> DataFrame:
    """The chosen rows for every anchor, over all cells of a block of anchors and one of rows."""
    anchors, n_a = _blocks(anchors, "x", ANCHORS)
    rows, n_b = _blocks(rows, "y", CANDIDATES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["row", "vec_id", "label", "values", "leads", "asked"]
    left = anchors.withColumns({"leads": F.lit(True), "y": every(n_b)})
    right = rows.withColumns({"leads": F.lit(False), "asked": F.array().cast("array<bigint>"),
                              "x": every(n_a)})
    cells = left.select("x", "y", *columns).unionAll(right.select("x", "y", *columns))
    return cells.groupBy("x", "y").applyInArrow(_cell(choose), FOUND)


def _first(found: DataFrame, most: int) -> DataFrame:
    """The best of all cells, numbered from 1; ties go by the id, nulls last."""
    order = Window.partitionBy("anchor", "nth").orderBy(
        F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def quantized(vectors: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str,
              scale: int) -> DataFrame:
    """``row, vec_id, label, leads, values`` of the rows that take part, as a written table.

    Components are floor(scale x), as doubles; the row number is drawn once.
    """
    largest = F.lit(sys.float_info.max)
    values = F.transform(F.transform(
        F.col(vector_col).cast("array<double>"),
        lambda x: F.greatest(F.least(x * F.lit(float(scale)), largest), -largest)),
        lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x))
    odd = F.exists(F.col(vector_col).cast("array<double>"),
                   lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return stored(vectors.filter(F.col(vector_col).isNotNull() & ~odd).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("leads"),
        values.alias("values")).filter("label IS NOT NULL"), "vectors")


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None,
                   id_col: str = "vec_id", vector_col: str = "embedding",
                   scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` and ``label`` are expressions over the columns of ``vectors``. Rows with a null label,
    a null vector or a component that is null, NaN or infinite take no part; vectors meet only those
    of their own length. A null id is no tie's winner. Repeated rows are rows of their own: each may
    be the other's positive. Scores are exact; one that leaves 64 bits counts as the nearest long.
    An empty table, or one without anchors, has no rows.
    """
    label = F.col("label") if label is None else label
    rows = quantized(vectors, anchor, label, id_col, vector_col, scale)
    leads = rows.filter("leads").withColumn("asked", F.array().cast("array<bigint>"))
    positives = stored(_first(_meet(leads, rows, _positives), POSITIVES).select(
        "anchor", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    asked = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("nth", "positive_score"))).alias("asked")).select(
        F.col("anchor").alias("row"), F.col("asked.positive_score").alias("asked"))
    negatives = _first(_meet(leads.drop("asked").join(asked, "row"), rows, _negatives), NEGATIVES)
    named = positives.join(leads.select(F.col("row").alias("anchor"),
                                        F.col("vec_id").alias("anchor_id")), "anchor")
    return negatives.join(named, ["anchor", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
