"""Nulls, empty and long texts, repeated rows, clashing column names and empty tables, everywhere."""

from __future__ import annotations

import pytest

from isobar.llm import alignment, copies, decontaminate, langid, lines, mixing, ngram_join, pii
from isobar.llm import quality, sharding, simhash, suffixes, toxicity
from isobar.llm.queries import BYTE_LEVEL, PIECES

LONG = " ".join(f"word{i % 977} of{i % 31} text" for i in range(20_000))
CLASHES = ("doc id digest bits runs node free n size key unit group text_ shard slot copies target "
           "quality lang_pred spans rest at leaf tokens p lo hi g c block rank u cluster cell").split()
ROWS = [
    (1, "The plain text of a short document here.", "en", "a"),
    (1, "The plain text of a short document here.", "en", "a"),
    (1, "The same number with another text in it.", "en", "b"),
    (2, None, "en", "a"), (None, "A text without a number at all, but with words.", None, None),
    (None, None, None, None), (3, "", "de", "a"), (4, " \n\t ", "fr", "b"), (5, LONG, "en", "c"),
    (6, "éè \U0001f600 ß 12345 @ + .", "de", "c"), (7, "1 2 3 ...", "de", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return docs.selectExpr("*", *[f"'{c}!' AS `{c}`" for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def language_model(odd):
    return langid.fit(odd.select("lang", "text"))


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train(["you idiot", "good day", None, ""], [1, 0, 0, 0])


def operators(language_model, toxic_model):
    item = "item_id bigint, text string"
    return {
        "decontaminate": lambda d: decontaminate.decontaminate(
            d, d.sparkSession.createDataFrame([(1, "never in any text at all here"), (2, None),
                                               (None, "three more words"), (4, "")], item)),
        "langid": lambda d: langid.identify(d, language_model).select("doc.*", "lang_pred"),
        "simhash": lambda d: simhash.near_duplicates(d).select("doc.*", "component_id"),
        "suffixes": lambda d: suffixes.remove_repeats(d).select("doc.*", "n_removed"),
        "lines": lambda d: lines.drop_recurring_lines(d).select("doc.*", "n_dropped"),
        "pii": lambda d: pii.find(d, None).select("doc.*", "n_email"),
        "quality": lambda d: quality.score_quality(d),
        "sharding": lambda d: sharding.shuffle_to_shards(d, 3, ("doc_id", "text")),
        "toxicity": lambda d: toxicity.score(d, toxic_model).select("doc.*", "score"),
        "mixing": lambda d: mixing.mix(d).select("doc.*", "copies"),
        "alignment": lambda d: alignment.align(d, BYTE_LEVEL, PIECES).select("doc.*", "n_links"),
        "ngram_join": lambda d: ngram_join.linked_documents(d).select("doc.*", "component_id"),
    }


NAMES = ("decontaminate langid simhash suffixes lines pii quality sharding toxicity mixing "
         "ngram_join alignment").split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_are_all_kept(odd, language_model, toxic_model, name):
    out = operators(language_model, toxic_model)[name](odd)
    got = [tuple(r[:4]) for r in out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, ROWS))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table_stays_empty(odd, language_model, toxic_model, name):
    assert operators(language_model, toxic_model)[name](odd.filter("false")).collect() == []


def test_odd_values(odd, language_model, toxic_model):
    lang = {(r["doc"]["doc_id"], r["doc"]["text"]): (r["lang_pred"], r["score"])
            for r in langid.identify(odd, language_model).collect()}
    assert lang[(2, None)] == lang[(3, "")] == lang[(4, " \n\t ")] == ("und", 0.0)
    assert lang[(7, "1 2 3 ...")] == ("und", 0.0) and lang[(5, LONG)][0] == "en"
    marks = {(r["doc"]["doc_id"], r["doc"]["text"]): r for r in simhash.near_duplicates(odd).collect()}
    assert marks[(3, "")]["fingerprint"] == "0" * 16 and marks[(None, None)]["component_id"] == 2
    sizes = {(r["doc"]["doc_id"], r["doc"]["text"]): r for r in mixing.mix(odd).collect()}
    assert sizes[(2, None)]["size"] == 0 and sizes[(5, LONG)]["size"] == 60_000
    scores = [r["score"] for r in toxicity.score(odd, toxic_model).collect()]
    assert all(0 <= s <= 1 for s in scores)
    cut = {(r["doc"]["doc_id"], r["doc"]["text"]): r for r in suffixes.remove_repeats(odd).collect()}
    assert cut[(2, None)]["n_bytes"] == 0 and cut[(5, LONG)]["n_bytes"] == len(LONG)


def test_one_of_each_group_stays(odd):
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in copies.keep_one(odd).collect())
    # the repeated row once, and the texts without a word as one group
    assert len(got) == 7 and ("2", "") in got and ("3", "") not in got
    assert copies.keep_one(odd.filter("false")).collect() == []


def test_mixture_repeats_rows(odd):
    taken = mixing.mix(odd).selectExpr("sum(copies)").first()[0]
    assert mixing.mixture(odd).count() == taken


def test_empty_benchmark_and_labels(spark, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(odd, none).count() == len(ROWS)
    model = langid.fit(odd.filter("false").select("lang", "text"))
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()} == {0}
