"""The operators applied to the whole given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import (
    alignment,
    decontaminate,
    langid,
    lines,
    mixing,
    negatives,
    ngram_join,
    pii,
    quality,
    sharding,
    simhash,
    suffixes,
    toxicity,
)
from isobar.llm.common import table
from isobar.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Vocabularies of public tokenizers; the operators take the paths as parameters.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


# The SQL lays the same windows and verifies all of them: the index may lose no similar one.
ORACLE["op1_decontamination"] = """
WITH item AS (
  SELECT item_id, w, least(5, len(w)) AS size, len(w) - least(5, len(w)) + 1 AS runs
  FROM (SELECT item_id, list_filter(string_split(regexp_replace(
          lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(
           lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
irun AS (
  SELECT item_id, size, runs, len(w) AS length, o,
         array_to_string(w[o + 1 : o + size], ' ') AS run
  FROM (SELECT *, unnest(range(0, runs)) AS o FROM item)),
drun AS (
  SELECT r, size, len(w) AS n, p, array_to_string(w[p + 1 : p + size], ' ') AS run
  FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS p
        FROM doc, (SELECT DISTINCT size FROM item) WHERE len(w) >= size)),
win AS (
  SELECT DISTINCT r, item_id, size, runs, greatest(0, least(p - o, n - length)) AS start
  FROM drun JOIN irun USING (size, run)),
wrun AS (
  SELECT r, item_id, start, runs, run, count(*) AS times
  FROM win JOIN drun USING (r, size) WHERE p >= start AND p < start + runs GROUP BY ALL),
weight AS (SELECT item_id, run, count(*) AS times FROM irun GROUP BY ALL),
sim AS (
  SELECT r, item_id, start,
         sum(least(a.times, coalesce(b.times, 0))) / greatest(sum(a.times), any_value(runs)) AS s
  FROM wrun a LEFT JOIN weight b USING (item_id, run) GROUP BY ALL)
SELECT doc_id, item_id, arg_max(start, (s, -start)) AS start, round(max(s), 6) AS similarity
FROM sim JOIN doc USING (r) WHERE s >= 0.8 GROUP BY r, doc_id, item_id"""


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", langid.held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")).select("lang", "text"))
    return langid.identify(docs, model, keep=["doc_id", "held_out"]).select(
        "doc.doc_id", "doc.held_out", "lang_pred", "score")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep=["doc_id"]).select(
        "doc.doc_id", "fingerprint", "component_id")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs, keep=["doc_id"], with_rest=False).select(
        "doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_recurring_lines(docs).select(
        "doc.doc_id", "n_lines", "n_dropped", "kept_text")


ORACLE["op5_line_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY text) AS k, doc_id, text
  FROM documents),
raw AS (
  SELECT r, k, unnest(range(0, len(l))) AS pos, unnest(l) AS line
  FROM (SELECT r, k, string_split(text, chr(10)) AS l FROM d)),
line AS (
  SELECT *, len(t) AS n, concat_ws(' ', len(t), array_to_string(m[1:4], ' ')) AS leaf
  FROM (SELECT *, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>'
                                                   ELSE x END) AS m
        FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS t FROM raw))
  WHERE len(t) > 0),
fixed AS (
  SELECT leaf, place, token
  FROM (SELECT leaf, k, unnest(range(1, n + 1)) AS place, unnest(m) AS token FROM line)
  WHERE place > 4 AND token <> '<*>'
  GROUP BY leaf, place, token HAVING count(DISTINCT k) >= 2),
placed AS (
  SELECT r, pos, x.leaf, x.place, CASE WHEN x.token <> '<*>' AND (
           x.place <= 4 OR fixed.token IS NOT NULL) THEN x.token END AS token
  FROM (SELECT r, pos, leaf, unnest(range(1, n + 1)) AS place, unnest(m) AS token FROM line) x
  LEFT JOIN fixed ON fixed.leaf = x.leaf AND fixed.place = x.place AND fixed.token = x.token),
shaped AS (
  SELECT r, pos, list(token ORDER BY place) AS template, count(token) AS held
  FROM placed GROUP BY r, pos),
full_line AS (SELECT line.*, template, held FROM line JOIN shaped USING (r, pos)),
followed AS (
  SELECT leaf, template FROM full_line WHERE 100 * held >= 50 * n
  GROUP BY leaf, template HAVING count(DISTINCT k) >= CASE WHEN max(n) < 4 THEN 5 ELSE 2 END),
exact AS (
  SELECT t FROM full_line GROUP BY t
  HAVING count(DISTINCT k) >= CASE WHEN max(n) < 4 THEN 5 ELSE 2 END),
gone AS (
  SELECT r, pos, 1 AS hit FROM full_line
  WHERE t IN (SELECT t FROM exact)
     OR 100 * held >= 50 * n AND EXISTS (
          SELECT 1 FROM followed f
          WHERE f.leaf = full_line.leaf AND f.template IS NOT DISTINCT FROM full_line.template)),
kept AS (
  SELECT r, count(hit) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hit IS NULL) AS text
  FROM (SELECT r, raw.pos, line FROM raw) x LEFT JOIN gone USING (r, pos) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM line GROUP BY r)
SELECT doc_id, coalesce(n.n, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS kept_text
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs), keep=["doc_id"], redact=False).select(
        "doc.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs).select(
        "doc_id", *[f"quality.{c}" for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "kept")])


def _in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


ORACLE["op7_quality_rules"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM d),
runs AS (
  SELECT r, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS run
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM (SELECT r, i, unnest(range(0, 8)) AS k FROM twice) GROUP BY r),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_in_list(quality.SPELLINGS)}))) AS n_stop
  FROM t LEFT JOIN covered c USING (r)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 2000 * n_words
       AND 100 * n_symbols <= 10 * n_words AND (n_words < 50 OR 100 * n_stop >= 2 * n_words)
       AND (n_lines < 6 OR 100 * n_dup_lines <= 50 * n_lines) AS kept
FROM v"""


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.xxhash64("text").alias("digest"))
    return sharding.shuffle_to_shards(rows, 24, keys=("doc_id", "digest")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out(F.col("doc_id"), 3, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", out.alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(~out)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep=["doc_id", "held_out"]).select(
        "doc.doc_id", "doc.held_out", "score", "predicted")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc.doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, BYTE_LEVEL, PIECES, keep=["doc_id"]).select(
        "doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"),
                                    anchor=F.col("vec_id") % 100 == 0, label=label)


ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON b.r <> a.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS nth
  FROM s WHERE same QUALIFY nth <= 5),
neg AS (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, s.vec_id AS negative_id,
         pos.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor, pos.nth
                            ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM pos JOIN s ON s.anchor = pos.anchor AND NOT s.same
       AND 80 * pos.score <= 100 * s.score AND s.score <= pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
       negative_score
FROM neg WHERE rank <= 5"""


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.linked_documents(docs, keep=["doc_id"]).select(
        "doc.doc_id", "n_shingles", "component_id")


ORACLE["op13_ngram_join"] = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y USING (shingle)
  WHERE x.r <> y.r GROUP BY x.r, y.r),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM d JOIN least ON a = d.r LEFT JOIN n ON n.r = d.r"""
