"""Quality rules: a threshold table compiled into one projection, without user functions.

Every rule bounds a ratio of two measures of a text. All arithmetic is on integers, so that a text
on a threshold gets the same verdict everywhere. A null text has no words. Empty and null texts
have zero in every measure and fail the base rule on the number of words; so do texts without words.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import WHITESPACE, bind, words

SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
# Very frequent function words of the four languages.
STOP_WORDS = ("the of and to in is a that it for was on are as with by this be at or from "
              "de la le les des et un une en que qui dans est pour sur pas au "
              "der die das und den von zu mit ist im nicht ein eine auf "
              "el los las del y se por con para no su al").split()
SPELLINGS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


class Rule(NamedTuple):
    """Kept if ``low <= 100 * part / whole <= high``, or ``whole`` is below ``at_least``."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    at_least: int = 0


# The verdict of the method. Ratios are percentages.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=2_000),
    Rule("symbol_ratio", "n_symbols", "n_words", high=10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=2, at_least=50),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=50, at_least=6),
)
BASE = (
    Rule("min_words", "n_words", "one", low=2_000),
    Rule("repeat_ratio", "n_repeat_words", "n_words", high=30),
)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found twice or more in the text.

    Runs are compared by a 64-bit hash. Texts without a repeated run, nearly all, stop after one
    pass; the others sort their runs and add up the words newly covered by each repeated one.
    """
    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(runs: Column) -> Column:
            same = F.filter(runs, lambda r, k: (
                (F.get(runs, k - 1)["h"] == r["h"]) | (F.get(runs, k + 1)["h"] == r["h"])))
            return F.array_sort(F.transform(same, lambda r: r["i"]))

        def total(at: Column) -> Column:
            new = F.transform(at, lambda i, k: F.least(
                F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window))))
            return F.aggregate(new, F.lit(0), lambda a, b: a + b)

        return bind(bind(ordered, starts), total)

    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - window),
                         lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(window)]))
    return F.when(F.size(tokens) <= window, F.lit(0)).otherwise(bind(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))).cast("long")


def measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of(tokens: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, WHITESPACE, "") != "")
        return bind(lines, lambda kept: F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, WHITESPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
            .alias("n_symbols"),
            (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
            F.size(kept).cast("long").alias("n_lines"),
            F.size(F.filter(tokens, lambda w: w.isin(SPELLINGS))).cast("long")
            .alias("n_stop_words"),
            F.lit(1).cast("long").alias("one")))

    return bind(words(text), of)


def verdict(of: Column, rules: Sequence[Rule]) -> Column:
    """Whether all rules hold for the struct of measures."""
    def holds(rule: Rule) -> Column:
        part, whole = of[rule.part] * 100, of[rule.whole]
        ok = F.lit(True)
        if rule.low is not None:
            ok = ok & (part >= whole * rule.low)
        if rule.high is not None:
            ok = ok & (part <= whole * rule.high)
        return ok if not rule.at_least else (whole < rule.at_least) | ok

    return reduce(Column.__and__, map(holds, rules))


def score_quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES,
                  base: Sequence[Rule] = BASE, out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the measures, ``base_failed`` and ``kept``.

    One projection: no shuffle, no user function. A column already named ``out`` is replaced.
    Rows are judged alone, so ties and repeated rows get equal verdicts; an empty table stays empty.
    """
    return docs.withColumn(out, bind(measures(F.col(text_col)), lambda m: F.struct(
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                  "n_repeat_words", "n_lines", "n_stop_words")],
        (~verdict(m, base)).alias("base_failed"),
        verdict(m, [*base, *rules]).alias("kept"))))


def keep_quality(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows that pass every rule, with their own columns."""
    kept = score_quality(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("body")),
                         "body", **params)
    return kept.filter("quality.kept").select("doc.*")
