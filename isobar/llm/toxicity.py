"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word is the bag of its hashed character n-grams (bytes of ``<word>`` in lower case), so unseen
misspellings and inflections share vectors with the words they resemble. A window of words is the
average of the vectors of all its n-grams; embeddings and softmax are trained jointly. A whole text
scores as its most toxic window: a single average would drown two words in a long text. Labels
are given by text, so training alternates between choosing the window of a text that scores
highest and learning from the chosen windows (all toxic texts against calm ones, hard and random).

As the softmax is linear, a trained model collapses to one number per n-gram, a word to a sum and
a count, and each distinct word of a batch is hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import beside, slices, utf8

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 8
WINDOW, STRIDE = 8, 4
# Bound of the fit: expected labelled rows per class (whole texts).
ROWS_PER_CLASS = 2_000
THRESHOLD = 0.7


@dataclass
class Model:
    """The trained softmax collapsed onto the n-grams: log odds per bucket, and the bias."""

    weight: np.ndarray
    bias: float


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of a batch, the words as numbers, and where each text starts."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), starts - starts[0]


def grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every word, word by word, and where each word starts."""
    text = pa.large_string()
    marked = pc.binary_join_element_wise(pa.scalar("<", text), vocabulary.cast(text),
                                         pa.scalar(">", text), pa.scalar("", text))
    data, starts = utf8(marked)
    ends = np.repeat(starts[1:], np.diff(starts))
    word = np.repeat(np.arange(len(vocabulary)), np.diff(starts))
    owners, buckets, code = [], [], np.zeros(len(data), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            if len(data) < n:
                break
            code = code[:len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1:] + np.uint64(n)
            if n in GRAMS:
                inside = np.flatnonzero(np.arange(len(code)) + n <= ends[:len(code)])
                mixed = code[inside] ^ (code[inside] >> np.uint64(29))
                mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 18)
                owners.append(word[inside])
                buckets.append(mixed.astype(np.int64) & (BUCKETS - 1))
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(len(vocabulary) + 1, dtype=np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    sizes = np.bincount(owner, minlength=len(vocabulary))
    return np.concatenate(buckets)[order], np.concatenate(([0], np.cumsum(sizes)))


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of the windows of all texts, and the first window of each text.

    Every text has a window, an empty one if it has no word.
    """
    n = np.diff(starts)
    count = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], count)
    begin = np.repeat(starts[:-1], count) + within * STRIDE
    return begin, np.minimum(begin + WINDOW, np.repeat(starts[1:], count)), first


def window_odds(weight: np.ndarray, bias: float, buckets: np.ndarray, at: np.ndarray,
                words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log odds of windows: the average weight of their n-grams, plus the bias."""
    running = np.concatenate(([0.0], np.cumsum(weight[buckets], dtype=np.float64)))
    total = np.concatenate(([0.0], np.cumsum((running[at[1:]] - running[at[:-1]])[words])))
    count = np.concatenate(([0], np.cumsum(np.diff(at)[words])))
    return (total[end] - total[begin]) / np.maximum(count[end] - count[begin], 1) + bias


def text_odds(model: Model, texts: pa.Array) -> np.ndarray:
    vocabulary, words, starts = split_words(texts)
    begin, end, first = windows(starts)
    odds = window_odds(model.weight, model.bias, *grams(vocabulary), words, begin, end)
    return np.maximum.reduceat(odds, first[:-1])


def train(texts: Sequence[str | None], toxic: Sequence[int], seed: int = 9, rounds: int = 3,
          epochs: int = 4, rate: float = 1.0) -> Model:
    """Embeddings and softmax by Adagrad on cross-entropy, classes weighted equally."""
    rng, label = np.random.default_rng(seed), np.asarray(toxic, dtype=np.int64)
    if not len(label):  # nothing is known: every text scores alike, below the threshold
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    vocabulary, words, starts = split_words(pa.array(texts, pa.large_string()))
    buckets, at = grams(vocabulary)
    begin, end, first = windows(starts)
    owner = np.repeat(np.arange(len(label)), np.diff(first))
    embed = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    squares = [np.full_like(x, 1e-6) for x in (embed, soft, bias)]

    def first_guess() -> np.ndarray:
        """Windows by their most telling word: log odds of a word to stand in a toxic text."""
        doc = np.repeat(np.arange(len(label)), np.diff(starts))
        pair = np.unique(doc * max(len(vocabulary), 1) + words)  # each word once per text
        text, word = np.divmod(pair, max(len(vocabulary), 1))
        hits = [np.bincount(word[label[text] == y], minlength=len(vocabulary)) for y in (0, 1)]
        odds = (np.log((hits[1] + 0.5) / (np.sum(label == 1) + 1))
                - np.log((hits[0] + 0.5) / (np.sum(label == 0) + 1)))
        told = np.append(odds[words], -99.0) if len(words) else np.array([-99.0])
        best = np.full(len(begin), -99.0)
        for k in range(WINDOW):
            best = np.maximum(best, told[np.where(begin + k < end, begin + k, len(words))])
        return best

    def chosen(odds: np.ndarray) -> np.ndarray:
        order = np.lexsort((odds, owner))
        top = order[first[1:] - 1]
        calm = np.flatnonzero(label[owner] == 0)
        some = rng.choice(calm, min(len(calm), 4 * len(label))) if len(calm) else calm
        return np.unique(np.concatenate([top, some]))

    def step(batch: np.ndarray) -> None:
        nonlocal embed
        lengths = end[batch] - begin[batch]
        flat = np.repeat(begin[batch] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        used = words[flat + np.arange(lengths.sum())]
        sizes = np.diff(at)[used]
        span = np.repeat(at[used] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        ids = buckets[span + np.arange(sizes.sum())]
        row = np.repeat(np.repeat(np.arange(len(batch)), lengths), sizes)
        count = np.maximum(np.bincount(row, minlength=len(batch)), 1).astype(np.float32)
        mean = np.zeros((len(batch), DIM), dtype=np.float32)
        np.add.at(mean, row, embed[ids])
        mean /= count[:, None]
        logits = mean @ soft + bias
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        y = label[owner[batch]]
        error = share.copy()
        error[np.arange(len(y)), y] -= 1
        error *= (balance[y] / len(batch))[:, None].astype(np.float32)
        back = (error @ soft.T) / count[:, None]
        grad = np.zeros_like(embed)
        np.add.at(grad, ids, back[row])
        for x, g, q in ((embed, grad, squares[0]), (soft, mean.T @ error, squares[1]),
                        (bias, error.sum(axis=0), squares[2])):
            q += g * g
            x -= np.float32(rate) * g / np.sqrt(q)

    odds = first_guess()
    for _ in range(rounds):
        picked = chosen(odds)
        sizes = np.bincount(label[owner[picked]], minlength=2)
        balance = len(picked) / (2 * np.maximum(sizes, 1))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(picked), max(1, len(picked) // 512)):
                step(part)
        weight = (embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        odds = window_odds(weight, float(bias[1] - bias[0]), buckets, at, words, begin, end)
    return Model(weight, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, seed: int = 9,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from about ``rows`` labelled rows per class, chosen by a hash of the id.

    Rows of ``labels`` with a null id or label are left out, as are ids without a document.
    """
    known = labels.select(F.col(id_col).alias("id"),
                          F.col(label_col).cast("int").alias("y")).dropna()
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("y") == 1, rows / max(n.get(1, 0), 1)).otherwise(
        rows / max(n.get(0, 0), 1))
    sample = F.broadcast(known.filter(draw < share))  # bounded by ``rows``
    found = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(sample, "id").orderBy("id", F.xxhash64("text")).toArrow())
    return train(found.column("text").to_pylist(), found.column("y").to_pylist(), seed)


def score(docs: DataFrame, model: Model, text_col: str = "text",
          keep: Sequence[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` in a struct ``doc`` (of the columns ``keep``), ``score`` (0 to 1), ``predicted``.

    Null and empty texts get the score of an empty window. Rows are scored alone, so copies agree;
    an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_of(batch)
            for at, n in slices(texts):
                odds = text_odds(sent.value, texts.slice(at, n))
                share = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, n), pa.array(share),
                     pa.array((share >= threshold).astype(np.int32))],
                    ["doc", "score", "predicted"])

    rows, text_of, kind = beside(docs, text_col, keep)
    return rows.mapInArrow(run, f"doc {kind}, score double, predicted int")
