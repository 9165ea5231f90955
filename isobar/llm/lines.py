"""Line dedup by a template tree of fixed depth, with DataFrame functions only.

A line is parsed by its number of tokens and then by its leading tokens; tokens with a digit count
as a variable field from the start. The lines that reach one leaf form groups: behind the leading
tokens, a token that several texts have at this place of the leaf is fixed, any other is a variable
field, and lines with the same fixed tokens at the same places share a template. A leaf so holds as
many templates as its lines have, however many lines share it. Lines of a template that fixes enough
of its tokens are dropped if it occurs in several texts, and so are lines that occur word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import bind, stored
from isobar.operators.lookup import sized

DEPTH = 4
# A line recurs in two texts; one of fewer tokens than ``SHORT`` in ``SHORT_DOCS``.
SHORT, SHORT_DOCS = 4, 5
# A template fixes at least this percentage of its tokens.
FIXED = 50
FIELD = "<*>"


def _tokens(line: Column) -> Column:
    """Maximal runs of characters other than the space and the control characters 9 to 13."""
    for sign in "\t\x0b\f\r":
        line = F.replace(line, F.lit(sign), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def _masked(tokens: Column) -> Column:
    """The tokens; those with a digit become a field."""
    return F.transform(tokens, lambda w: F.when(w.rlike("[0-9]"), FIELD).otherwise(w))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), _masked(F.slice(tokens, 1, DEPTH)))


def _several(texts: str = "digest") -> list[Column]:
    """The smallest and the largest text of a group: more than one if they differ."""
    return [F.min(texts).alias("low"), F.max(texts).alias("high")]


def _joined(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    few, fits = sized(few)
    return rows.join(F.broadcast(few) if fits else few, keys, how)


def _name(tokens: str) -> list[Column]:
    """A list of tokens as 128 bits, for joins."""
    return [F.xxhash64(F.lit(k), tokens).alias(f"{tokens}{k}") for k in (1, 2)]


def _literal(tokens: str, fixed: int) -> Column:
    return F.size(F.filter(tokens, lambda w: w != FIELD)) * 100 >= F.size(tokens) * fixed


def recurring(found: DataFrame, short_docs: int = SHORT_DOCS, fixed: int = FIXED) -> DataFrame:
    """``tokens1, tokens2``, the names of the lines of ``found (digest, leaf, tokens)`` that recur."""
    kinds = stored(found.groupBy("leaf", "tokens").agg(*_several())
                   .withColumn("masked", _masked(F.col("tokens")))
                   .select("*", *_name("tokens"), *_name("masked")), "line-kinds")
    groups = stored(kinds.groupBy("leaf", "masked", "masked1", "masked2").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("kind", F.monotonically_increasing_id()), "masked-kinds")
    long = F.size("masked") >= SHORT
    # A leaf with one masked line has one template; the lines of others are compared by places.
    crowded = groups.filter(long).groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = _joined(groups.filter(long), crowded.select("leaf"), ["leaf"], "left_semi")
    places = crowded.select("leaf", "kind", "low", "high", F.posexplode(
        F.slice("masked", DEPTH + 1, 1 << 30)).alias("place", "token")).filter(
        F.col("token") != FIELD)
    # A token that several texts have at a place is fixed there.
    alike = places.groupBy("leaf", "place", "token").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high")
    held = places.select("leaf", "place", "token", "kind").join(
        alike.select("leaf", "place", "token"), ["leaf", "place", "token"]).groupBy("kind").agg(
        F.collect_set("place").alias("held"))
    template = F.transform("masked", lambda w, k: F.when(
        (k < DEPTH) | F.coalesce(F.array_contains("held", k - DEPTH), F.lit(False)), w)
        .otherwise(FIELD))
    shaped = crowded.join(held, "kind", "left").withColumn("template", template).filter(
        _literal("template", fixed))
    shaped = stored(shaped.select("leaf", "masked1", "masked2", "low", "high", *_name("template")),
                    "templates")
    group = ["leaf", "template1", "template2"]
    several = shaped.groupBy(*group).agg(
        F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select(*group)
    follow = shaped.join(several, group, "left_semi")
    # A masked line of several texts is its own template, wherever it stands.
    whole = groups.filter(long & (F.col("low") != F.col("high")) & _literal("masked", fixed))

    def counted(rows: DataFrame, by: str) -> DataFrame:
        names = [f"{by}1", f"{by}2"]
        return rows.select(*_name(by), "digest").groupBy(*names).agg(
            F.count_distinct("digest").alias("n")).filter(F.col("n") >= short_docs).select(*names)

    small = found.filter(F.size("tokens") < SHORT).withColumn("masked", _masked(F.col("tokens")))
    names = ["masked1", "masked2"]
    bad = follow.select(*names).unionAll(whole.select(*names)).unionAll(
        counted(small.filter(_literal("masked", fixed)), "masked")).distinct()
    exact = kinds.filter((F.size("tokens") >= SHORT) & (F.col("low") != F.col("high")))
    return (_joined(kinds, bad, names, "left_semi").select("tokens1", "tokens2")
            .unionAll(exact.select("tokens1", "tokens2")).unionAll(counted(small, "tokens"))
            .distinct())


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         short_docs: int = SHORT_DOCS, fixed: int = FIXED) -> DataFrame:
    """``docs`` in a struct ``doc``, with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines end at a newline; lines without a token are kept and not counted. Recurrence is counted
    in distinct texts, so an exact copy of a document alone drops no line. A null text has no lines
    and stays null. Ids play no part and may be null or repeated. An empty table stays empty.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    lines = keyed.select("digest", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    leaf = bind(_tokens(F.col("line")), lambda t: F.when(F.size(t) > 0, _leaf(t)))
    hashed = stored(lines.withColumn("leaf", leaf).filter("leaf IS NOT NULL"), "lines")
    busy = hashed.groupBy("leaf").agg(*_several()).filter("low != high").select("leaf")
    found = _joined(hashed, busy, ["leaf"], "left_semi").withColumn("tokens", _tokens(F.col("line")))
    found = stored(found.select("digest", "at", "leaf", "tokens", *_name("tokens")), "busy-lines")
    bad = recurring(found.select("digest", "leaf", "tokens"), short_docs, fixed)
    dropped = _joined(found.select("digest", "at", "tokens1", "tokens2"), bad,
                      ["tokens1", "tokens2"], "left_semi").groupBy("digest").agg(
        F.collect_set("at").alias("dropped"))

    def kept(every: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(every) - 1)
        return F.array_join(F.transform(F.array_except(places, "dropped"),
                                        lambda k: F.get(every, k)), "\n")

    blank = F.lit(" \t\x0b\f\r")
    counted = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, blank) != ""))
    return _joined(keyed, dropped, ["digest"], "left").select(
        "doc", F.coalesce(counted, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
            bind(F.split("text", "\n"), kept)).alias("kept_text"))
