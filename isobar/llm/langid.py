"""Language identification by prediction by partial matching.

Per language a tree of byte contexts of order 0 to ``order`` with symbol counts. A symbol seen in
the longest known context costs its share there; an unseen one pays the escape and is looked up
one order lower, down to a uniform byte. Counts are frozen, so a text's exact code length under a
language is a sum over its bytes, each of which depends on the ``order`` bytes before it.

The trees of all languages are merged and hold every context of the sample. They are kept as sorted
runs (a context and its symbol): per run the symbol's cost there, escapes included, and the escapes
that are due when the run is a context in which a symbol is unknown. A byte costs what its longest
known run says, plus the escapes of the longer contexts. Runs of a part of a batch are looked up
once each, in order.

Escapes follow method C (as many escapes as distinct symbols seen) without exclusion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import beside, slices, utf8

ORDER = 4
# Bound of the fit: expected distinct labelled texts per language, whole texts.
ROWS_PER_LANGUAGE = 1_000
UNDETERMINED = "und"
CHUNK = 1 << 18
# A run is a number, newest byte first, so that its front is the run with fewer bytes before it.
# A digit of DIGIT bits is the byte plus one, or zero where the text has not begun.
DIGIT = 9


@dataclass
class Model:
    """The merged trees. Row 0 of both tables belongs to the empty run, row i + 1 to ``runs[i]``."""

    languages: list[str]
    order: int
    runs: np.ndarray  # sorted, therefore by length; every run of a known run is known
    bits: np.ndarray  # code length per language of the newest byte behind the others
    escapes: np.ndarray  # bits per language of all escapes if the run is a context

    def cuts(self) -> np.ndarray:
        """Where the runs of each length start and the last ones end."""
        return np.searchsorted(self.runs, [1 << DIGIT * k for k in range(self.order + 2)])


def _runs(data: np.ndarray, back: np.ndarray, first: int, order: int) -> np.ndarray:
    """The runs of ``order + 1`` bytes that end at ``first`` and the places behind it.

    ``back``: how many bytes of its text precede each place.
    """
    out = np.zeros(len(back), dtype=np.int64)
    at = np.arange(first, first + len(back))
    for k in range(order + 1):
        digit = data[np.maximum(at - k, 0)].astype(np.int64) + 1
        out |= np.where(back >= k, digit, 0) << DIGIT * (order - k)
    return out


def count_runs(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Counts of all runs of 1 to ``order + 1`` bytes inside texts of a language."""
    for batch in batches:
        langs = batch.column(0)
        for lang in langs.unique().to_pylist():
            texts = batch.column(1).filter(pa.compute.equal(langs, lang))
            for at, rows in slices(texts, CHUNK):
                data, starts = utf8(texts.slice(at, rows))
                back = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
                whole = _runs(data, back, 0, order)
                for length in range(1, order + 2):
                    inside = whole[back >= length - 1] >> DIGIT * (order + 1 - length)
                    run, n = np.unique(inside, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(run), lang, dtype=np.int32)), pa.array(run),
                         pa.array(n, pa.int64())], ["lang", "run", "n"])


def fit(labelled: DataFrame, order: int = ORDER, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from rows ``(lang, text)``; rows with a null in either are left out.

    Learns from about ``rows`` distinct texts per language, chosen by a hash of the text, so that
    copies of a chosen text add nothing, and keeps all of their contexts. Without a labelled row it
    knows no language, and every text is undetermined. ``order`` is 5 at most.
    """
    rest = labelled.select(F.col("lang").cast("string"), "text").dropna()
    share = {r["lang"]: min(1.0, rows / max(r["n"], 1))
             for r in rest.groupBy("lang").agg(
                 F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    languages = sorted(share)
    if not languages:
        return Model([], order, *(np.zeros(0) for _ in range(3)))
    place = {lang: (i, share[lang]) for i, lang in enumerate(languages)}
    by_lang = F.create_map(*[c for lang, (i, part) in place.items() for c in (
        F.lit(lang), F.struct(F.lit(i).alias("i"), F.lit(part).alias("part")))])[F.col("lang")]
    sample = (rest.select(by_lang.alias("l"), "text")
              .filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("l.part") * 1_000_000)
              .select(F.col("l.i").alias("lang"), "text").distinct())
    counts = (sample.mapInArrow(lambda it: count_runs(it, order), "lang int, run bigint, n bigint")
              .groupBy("lang", "run").agg(F.sum("n").alias("n")))
    # As Arrow columns: rows of Python objects would be many times larger on the driver.
    found = counts.toArrow()
    return compile_model(*(found.column(c).to_numpy() for c in ("lang", "run", "n")),
                         languages, order)


def compile_model(lang: np.ndarray, run: np.ndarray, n: np.ndarray, languages: list[str],
                  order: int) -> Model:
    """Write the trees out as tables. A row: the place of a language, a run, its count."""
    runs = np.unique(run)
    counts = np.zeros((len(runs) + 1, len(languages)), dtype=np.float32)
    counts[np.searchsorted(runs, run) + 1, lang] = n
    bits, escapes = np.zeros_like(counts), np.zeros_like(counts)
    model = Model(languages, order, runs, bits, escapes)
    cuts = model.cuts()
    contexts, shorter = slice(0, 1), np.zeros(1, dtype=np.int64)  # one order up; without a byte
    for length in range(1, order + 2):
        mine = slice(cuts[length - 1] + 1, cuts[length] + 1)
        keys = runs[cuts[length - 1]:cuts[length]]
        context = np.searchsorted(runs, keys & ((1 << DIGIT * (length - 1)) - 1)) + 1
        lower = np.searchsorted(runs, keys >> DIGIT) + 1
        if length == 1:
            context, lower = np.zeros_like(context), np.zeros_like(lower)
        for j in range(len(languages)):
            here = counts[mine, j]
            size = contexts.stop - contexts.start
            total = np.bincount(context - contexts.start, here, size)
            kinds = np.bincount(context - contexts.start, here > 0, size)
            with np.errstate(divide="ignore", invalid="ignore"):
                whole = np.log2(total + kinds)
                escape = np.where(total > 0, whole - np.log2(kinds), 0.0)
                known = whole[context - contexts.start] - np.log2(here)
            if length == 1:
                bits[0, j] = 8.0 + escape[0]
                below = 8.0
            else:
                escapes[contexts, j] = escape + escapes[shorter, j]
                below = bits[lower, j]
            bits[mine, j] = np.where(here > 0, known, escape[context - contexts.start] + below)
        contexts, shorter = mine, lower
    return model


def code_lengths(model: Model, texts: pa.Array) -> np.ndarray:
    """Exact code length in bits of every whole text under every language."""
    data, starts = utf8(texts)
    lengths = np.diff(starts)
    total = np.zeros((len(lengths), len(model.languages)))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order, cuts = model.order, model.cuts()
    for first in range(0, len(data), CHUNK):  # bounded memory, also for one very long text
        lead = max(first - 1, 0)  # the byte before, whose run is the context of the first one
        last = min(first + CHUNK, len(data))
        back = np.arange(lead, last) - starts[doc[lead:last]]
        distinct, at = np.unique(_runs(data, back, lead, order), return_inverse=True)
        known = np.zeros(len(distinct), dtype=np.int64)  # length of the longest known run
        row = np.zeros((order + 2, len(distinct)), dtype=np.int64)  # by length
        for length in range(1, order + 2):
            low, high = cuts[length - 1:length + 1]
            run = distinct >> DIGIT * (order + 1 - length)
            place = low + np.searchsorted(model.runs[low:high], run)
            hit = (place < high) & (model.runs[np.minimum(place, len(model.runs) - 1)] == run)
            row[length] = np.where(hit, place + 1, 0)
            known += hit
        best = model.bits[row[known, np.arange(len(distinct))]]
        before = np.concatenate([at[:1], at[:-1]])
        context = np.where(back > 0, np.minimum(known[before], order), 0)
        seen = np.maximum(known[at] - 1, 0)
        cost = best[at]
        left = np.flatnonzero(context > seen)
        cost[left] += (model.escapes[row[context[left], before[left]]]
                       - model.escapes[row[seen[left], before[left]]])
        cost, owner = cost[first - lead:], doc[first:last]
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        np.add.at(total, owner[heads], np.add.reduceat(cost, heads, axis=0, dtype=np.float64))
    return total


def posterior(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of the shortest code and its probability under equal priors."""
    best = lengths.argmin(axis=1)
    gap = lengths - lengths[np.arange(len(best)), best][:, None]
    return best, 1.0 / np.exp2(-np.minimum(gap, 1_000)).sum(axis=1)


def identify(docs: DataFrame, model: Model, text_col: str = "text",
             keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` in a struct ``doc`` (of the columns ``keep``), ``lang_pred`` and ``score`` (0 to 1).

    Nulls, empty texts and texts without a letter get ``und`` with score 0. Languages with equal
    code lengths go to the first in order. Rows are scored alone; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            if not len(batch):
                continue
            texts = text_of(batch)
            if not names.size:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array([UNDETERMINED] * len(batch)),
                     pa.array(np.zeros(len(batch)))], ["doc", "lang_pred", "score"])
                continue
            best, share = posterior(np.concatenate(
                [code_lengths(model, texts.slice(at, n)) for at, n in slices(texts, CHUNK)]))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"),
                 pa.array(np.where(letters, names[best], UNDETERMINED), pa.string()),
                 pa.array(np.where(letters, share, 0.0))], ["doc", "lang_pred", "score"])

    letters: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows, text_of, kind = beside(docs, text_col, keep, letters=letters)
    return rows.mapInArrow(score, f"doc {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5,
                    **columns) -> DataFrame:
    """The rows whose language is determined with at least ``min_score``."""
    return (identify(docs, model, **columns)
            .filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
            .select("doc.*"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into ``part``; null ids do, nothing is learned there."""
    rest = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts
    return F.coalesce(rest == part, F.lit(True))
