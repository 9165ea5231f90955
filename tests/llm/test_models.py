"""Language, toxicity and personal data: held-out accuracy, exact code lengths, base rules."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from isobar.llm import langid, pii, toxicity
from isobar.llm.queries import QUERIES
from isobar.operators import boosting

SMALL = "/root/testdata/sf0.01"


def test_code_lengths_follow_the_trees(spark):
    """Against a plain walk over the counts: longest context first, escapes down to a byte."""
    rng = random.Random(1)
    text = {"x": "".join(rng.choices("abc ", k=900)), "y": "".join(rng.choices("bcdé", k=900))}
    rows = spark.createDataFrame([(k, v) for k, v in text.items()], "lang string, text string")
    model = langid.fit(rows, order=3)

    def bits(lang, data):
        train, total = text[lang].encode(), 0.0
        for i, b in enumerate(data):
            cost = None
            paid = 0.0
            for k in range(min(3, i), -1, -1):
                ctx = data[i - k:i]
                nxt = [train[j + k] for j in range(len(train) - k) if train[j:j + k] == ctx]
                if not nxt:
                    continue
                kinds = len(set(nxt))
                if b in nxt:
                    cost = paid - math.log2(nxt.count(b) / (len(nxt) + kinds))
                    break
                paid -= math.log2(kinds / (len(nxt) + kinds))
            total += paid + 8 if cost is None else cost
        return total

    probes = ["abc abc", "dé", "", "bcbcbc", "zz"]
    got = langid.code_lengths(model, pa.array(probes))
    for row, probe in zip(got, probes):
        assert row == pytest.approx([bits("x", probe.encode()), bits("y", probe.encode())], rel=1e-4)


def test_chunks_of_a_long_text_add_up(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "some words of it " * 50)], "lang string, text string")
    model = langid.fit(rows)
    probe = pa.array(["other words in it " * 40, "and one"])
    whole = langid.code_lengths(model, probe)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert np.allclose(langid.code_lengths(model, probe), whole)


def test_every_context_is_kept_and_copies_add_nothing(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij klmnop", k=400)) for _ in range(60)]
    schema = "lang string, text string"
    model = langid.fit(spark.createDataFrame([("x", t) for t in texts], schema))
    again = langid.fit(spark.createDataFrame([("x", t) for t in texts + texts[:1] * 5_000], schema))
    runs = {t[i:i + k] for t in texts for k in range(1, 6) for i in range(len(t) - k + 1)}
    assert len(model.runs) == len(runs) and len(runs) > 12_000
    assert np.array_equal(model.runs, again.runs) and np.array_equal(model.bits, again.bits)


def test_languages_of_held_out_rows(spark):
    found = QUERIES["op2_language_id"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    held = both[both["held_out"]]
    assert len(found) == len(docs) and (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_unseen_inflections_are_toxic():
    rng = random.Random(2)
    plain = ["".join(rng.choices("aeioutnrsl", k=rng.randrange(2, 9))) for _ in range(3_000)]
    stems = ["gromf", "blurg", "zwick"]

    def doc(bad):
        words = rng.choices(plain, k=rng.randrange(5, 120))
        if bad:
            words[rng.randrange(len(words))] = rng.choice(stems) + "".join(rng.choices("aeiou", k=2))
        return " ".join(words)

    labels = [k % 3 == 0 for k in range(900)]
    model = toxicity.train([doc(y) for y in labels], [int(y) for y in labels])
    truth = [k % 2 == 0 for k in range(300)]
    odds = toxicity.text_odds(model, pa.array([doc(y) for y in truth]))
    share = 1 / (1 + np.exp(-odds))
    truth = np.array(truth)
    assert (share[truth] >= 0.7).mean() > 0.95 and (share[~truth] < 0.7).mean() > 0.95


def test_toxicity_of_held_out_rows(spark):
    found = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = found.merge(labels, on="doc_id").query("held_out")
    assert len(found) == 10_000 and ((found["score"] >= 0.7) == found["predicted"]).all()
    assert held.loc[held["toxic"] == 1, "predicted"].mean() > 0.8
    assert held.loc[held["toxic"] == 0, "predicted"].mean() < 0.03


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d)
                         for i, d in enumerate(reversed(digits)))
            if (True, all(int(p) < 256 for p in m[0].split(".") if p.isdigit()),
                    13 <= len(digits) <= 19 and double % 10 == 0, 9 <= len(digits) <= 15)[k]:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a.b", "@", "x-1", ".", "..", "1", "25", "255", "256", "0000004", "+", " ", "-", "(",
              ")", "4111 1111 1111 1111", "4111111111111111", "é", "٣", "@@", "me@it.example.org",
              "10.0.0.1", "+1 (555) 010-9999", "\n", "%"]
    for _ in range(6_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_numbers():
    assert pii.base_spans("0" * 9_000 + "7.0.0.1") == [(1, 0, 9_007)]
    assert pii.base_spans("9" * 9_000 + ".0.0.1") == []


def test_patterns_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000,
                 "1-" * 150_000, "a@b." * 80_000, "f:" * 100_000, "x at y dot " * 30_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_added_spans_and_redaction(spark):
    rng = random.Random(4)

    def number(n):
        return "".join(rng.choices("0123456789", k=n))

    texts = [f"call +1 ({number(3)}) {number(3)}-{number(4)} or write to me{k}@mail{k}.example.org "
             f"from 10.{k % 250}.0.7, order {number(8)} of {number(3)}" for k in range(400)]
    model = pii.train(texts)
    docs = [(1, "call (555) 123-4567 now"), (2, "write to me21 at mail37 dot example dot org"),
            (3, "order 12345678 of 999 at 7 pm"), (4, "+1 (555) 010-9999"), (5, None)]
    out = {r["doc"]["doc_id"]: r for r in pii.find(
        spark.createDataFrame(docs, "doc_id bigint, text string"), model).collect()}
    assert out[1]["redacted"] == "call [phone] now" and out[1]["n_phone"] == 0
    assert out[2]["spans"].startswith("email:9:") and out[3]["spans"] == ""
    assert out[4]["spans"] == "phone:0:17" and out[5]["redacted"] is None
    assert out[4]["base_sha256"] == hashlib.sha256(b"phone:0:17").hexdigest()


def test_rare_data_of_a_large_table_is_learned(spark, monkeypatch):
    rng = random.Random(7)

    def number(n):
        return "".join(rng.choices("0123456789", k=n))

    plain = [(k, f"write to me{k}@mail{k}.example.org, order {k}") for k in range(20_000)]
    rare = [(20_000 + k, f"call +1 ({number(3)}) {number(3)}-{number(4)} now") for k in range(80)]
    docs = spark.createDataFrame(plain + rare, "doc_id bigint, text string")
    texts = spark.createDataFrame([(1, "call (555) 123-4567 now"), (2, "order 12345678")], docs.schema)
    found = pii.find(texts, pii.fit(docs)).collect()  # 3,000 of the texts show too few numbers
    assert {r["doc"]["doc_id"]: r["redacted"] for r in found} == {
        1: "call [phone] now", 2: "order 12345678"}
    assert pii.fit(docs.filter("doc_id < 0")) is None
    some = docs.filter("doc_id >= 19800")
    one = pii.fit(some)
    monkeypatch.setattr(pii, "BLOCK_ROWS", 400)  # several blocks, whose sums Spark adds up
    monkeypatch.setattr(pii, "TREES", 3)
    several = pii.fit(some)
    assert len(several.trees.leaf) == 3
    np.testing.assert_allclose(several.trees.leaf, one.trees.leaf[:3])


def test_trees_with_cuts_equal_those_with_bins():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (3, 500)).astype(float)
    cuts = [np.arange(1.0, 8.0)] * 3
    bins = np.stack([boosting.binned(v, c) for v, c in zip(x, cuts)])
    settings = boosting.Settings(n_estimators=5, max_depth=3, bins=33, min_child_weight=20.0)
    model = boosting.Boosted(list("abc"), cuts, settings)
    label = ((x[0] > 4) ^ (x[1] > 2)).astype(np.int32)
    model.rounds = boosting.fit_rows(boosting.Rows(
        bins, label, np.arange(500, dtype=np.uint64), np.zeros((500, 1)), settings))
    np.testing.assert_allclose(pii._as_trees(model, 3).odds(x.T),
                               boosting.margins(model, bins)[:, 0], rtol=1e-12, atol=1e-12)


def test_boosting_fits_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((2_000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = pii.boost(x[:1_500], y[:1_500])
    assert (((trees.odds(x[1_500:]) > 0) == (y[1_500:] > 0)).mean()) > 0.97
