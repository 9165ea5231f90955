"""Benchmark decontamination, with DataFrame functions only.

Texts are compared by their runs of five words, in lower case and without punctuation; an item of
fewer words is one run. A window of a document has the size of a benchmark item. Windows without a
run of the item have similarity zero, so windows are laid where a run of the document meets the
same run of an item, aligned with it; where none of them is similar, as in a copy whose parts have
changed places, also so that they end with such a run. SimHash fingerprints of the windows and items meet in an
index of ``radius + 1`` bit blocks: two fingerprints within the radius agree in one block at least,
so the index loses none of them. Candidates are verified by the exact weighted similarity: shared
runs, each as often as in both, over the runs of the larger side.

The radius is wide because the similarity decides: at 0.8 two fingerprints differ in 13 of 64 bits
on average, and in over 24 with a probability below one in a thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import stored
from isobar.operators.lookup import sized

WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
BITS = 64


def normal_words(text: Column) -> Column:
    """Words in lower case, without anything but letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _runs(tokens: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words by place."""
    places = F.sequence(F.lit(0), F.size(tokens) - size)
    return F.when(F.size(tokens) >= size, F.transform(
        places, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)])))


def _texts(tokens: Column, start: Column, count: Column, size: Column) -> Column:
    """``count`` runs from word ``start`` on as texts."""
    return F.transform(F.sequence(start, start + count - 1),
                       lambda i: F.array_join(F.slice(tokens, i + 1, size), " "))


def _fingerprints(runs: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the rows ``run`` of each key: a bit is set if over half of the hashes have it."""
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(1)).alias(f"b{b}") for b in range(BITS)]
    voted = (runs.select(*keys, F.xxhash64("run").alias("h")).groupBy(*keys)
             .agg(F.count("*").alias("n"), *sums))
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n"),
                   F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
            for b in range(BITS)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole.bitwiseOR(bit)
    return voted.select(*keys, whole.alias("bits"))


def _blocks(radius: int) -> Column:
    """Number and value of each of the ``radius + 1`` blocks of ``bits``."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("no"), F.shiftrightunsigned("bits", a).bitwiseAND(
        (1 << (b - a)) - 1).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a window.

    Columns: ``id`` and ``digest`` (the document's id as text and the hash of its text), the given
    document id and item id, ``start`` (first word of the best window; the first among equals) and
    ``similarity``. Windows that no shared run is aligned with count only for pairs without a similar
    aligned one. Null and empty texts hold no run and match nothing; documents shorter than an item
    are one window. Rows equal in id and text are one document, items equal in id and text
    one item. Empty tables give no pairs.
    """
    items = stored(benchmark.select(
        F.col(item_col).alias("item"), F.xxhash64(F.col(item_col).isNull(), item_col, item_text)
        .alias("item_key"), normal_words(F.col(item_text)).alias("tokens"))
        .filter(F.size("tokens") > 0).dropDuplicates(["item_key"])
        .withColumn("size", F.least(F.lit(WORDS), F.size("tokens")))
        .withColumn("n_runs", F.size("tokens") - F.col("size") + 1), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # five at most

    def by_run(size: int) -> DataFrame:
        return items.filter(F.col("size") == size).select(
            "item_key", F.size("tokens").alias("length"),
            F.posexplode(_runs(F.col("tokens"), size)).alias("offset", "hash"))

    keyed = docs.select(
        F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
        .alias("id"), F.xxhash64(F.col(id_col).isNull(), text_col).alias("digest"),
        F.col(text_col).alias("text"))
    tokens = keyed.select("id", "digest", normal_words(F.col("text")).alias("tokens"))
    laid = None
    for size in sizes:
        known, small = sized(by_run(size))
        places = tokens.select("id", "digest", F.size("tokens").alias("n"), F.posexplode(
            _runs(F.col("tokens"), size)).alias("place", "hash"))
        start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"),
                                             F.col("n") - F.col("length")))
        found = places.join(F.broadcast(known) if small else known, "hash").select(
            "id", "digest", "item_key", (F.col("length") - size + 1).alias("most"), "place",
            start.alias("start"))
        laid = found if laid is None else laid.unionAll(found)
    if laid is None:  # no item holds a word
        zero = F.lit(0)
        laid = (keyed.select("id", "digest", zero.cast("long").alias("item_key"), zero.alias("most"),
                             zero.alias("place"), zero.alias("start")).filter(F.lit(False)))
    pairs = stored(laid.groupBy("id", "digest", "item_key").agg(
        F.first("most").alias("most"), F.collect_set("start").alias("starts"),
        F.sort_array(F.collect_set("place")).alias("places")), "pairs")
    key = ["id", "digest", "item_key"]
    aligned = stored(_verified(keyed, items, pairs.select(*key, F.explode("starts").alias("start")),
                               similarity, radius), "aligned")

    # Pairs without a similar aligned window. Shared runs only grow where a shared place enters at the
    # end of a window, and so many of its places must be shared, so these windows hold the best.
    need = F.ceil(F.col("most") * similarity).cast("int")
    ends = F.filter(F.col("places"), lambda p, i: (i + 1 >= need) & (
        p - F.get(F.col("places"), i - need + 1) < F.col("most")))
    other = pairs.join(aligned, key, "left_anti").withColumn("ends", ends).filter(F.size("ends") > 0)
    other = stored(other.select(*key, F.explode(F.array_distinct(F.transform(
        "ends", lambda p: F.greatest(F.lit(0), p - F.col("most") + 1)))).alias("start")), "other")
    best = aligned
    if not other.isEmpty():
        best = aligned.unionByName(_verified(keyed, items, other, similarity, radius))
    return best.select("id", "digest", F.col("given").alias(id_col), F.col("item").alias(item_col),
                       "start", "similarity")


def _verified(keyed: DataFrame, items: DataFrame, laid: DataFrame, similarity: float,
              radius: int) -> DataFrame:
    """The best of the windows ``laid`` of every document and item, if it is similar."""
    # The words of the windows: only documents with a window are shuffled back to their texts.
    by_doc = stored(laid.groupBy("id", "digest").agg(
        F.collect_set(F.struct("item_key", "start")).alias("windows")), "windows")
    words = keyed.join(by_doc, ["id", "digest"]).groupBy("id", "digest").agg(
        F.first("given").alias("given"), F.first("windows").alias("windows"),
        normal_words(F.first("text")).alias("tokens"))
    key = ["id", "digest", "item_key", "start"]
    windows = (words.select("id", "digest", "given", "tokens", F.explode("windows").alias("w"))
               .select("id", "digest", "given", "tokens", "w.*").join(items.select("item_key", "size", "n_runs"), "item_key"))
    count = F.greatest(F.lit(1), F.least(F.col("n_runs"),
                                         F.size("tokens") - F.col("start") - F.col("size") + 1))
    runs = stored(windows.select(*key, "given", F.explode(_texts(
        F.col("tokens"), F.col("start"), count, F.col("size"))).alias("run"))
        .groupBy(*key, "run").agg(F.min("given").alias("given"), F.count("*").alias("times")),
        "window-runs")
    item_runs = items.select("item_key", F.explode(_texts(
        F.col("tokens"), F.lit(0), F.col("n_runs"), F.col("size"))).alias("run"))

    repeated = runs.select(*key, "run", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    left = _fingerprints(repeated, key).withColumn("block", F.explode(_blocks(radius)))
    right = (_fingerprints(item_runs, ["item_key"]).withColumn("block", F.explode(_blocks(radius)))
             .withColumnRenamed("bits", "item_bits"))
    near = (left.join(right, ["item_key", "block"])
            .filter(F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))) <= radius)
            .select(*key).distinct())

    weights = item_runs.groupBy("item_key", "run").agg(F.count("*").alias("item_times"))
    shared = F.sum(F.least("times", F.coalesce("item_times", F.lit(0))))
    scored = (runs.join(near, key, "left_semi").join(weights, ["item_key", "run"], "left")
              .groupBy(*key).agg(F.min("given").alias("given"), shared.alias("shared"),
                                 F.sum("times").alias("total")))
    alike = scored.join(items.select("item_key", "item", "n_runs"), "item_key").withColumn(
        "similarity", F.col("shared") / F.greatest("total", "n_runs"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    return (alike.filter(F.col("similarity") >= similarity)
            .groupBy("id", "digest", "item_key")
            .agg(F.min("given").alias("given"), F.min("item").alias("item"), best.alias("best"))
            .select("id", "digest", "item_key", "given", "item", (-F.col("best.back")).alias("start"),
                    F.col("best.similarity").alias("similarity")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that hold no window of a benchmark item, with their own columns."""
    hits = contaminated(docs, benchmark, id_col, text_col, **params).select("id", "digest").distinct()
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
        F.xxhash64(F.col(id_col).isNull(), text_col).alias("digest"))
    return keyed.join(hits, ["id", "digest"], "left_anti").select("doc.*")
