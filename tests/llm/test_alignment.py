"""Aligned tokens against a plain version that walks over the bytes."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from isobar.llm import alignment
from isobar.llm.queries import BYTE_LEVEL, PIECES

WORDS = "the and of Straße éè 日本語 12345 a_b 😀 <|endoftext|> <s> <0x41> don't 3.14 xqzv   \t".split(" ")


def plain(texts):
    """The contract per text, from single tokens."""
    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = alignment.byte_alphabet()
    found = []
    for text in texts:
        found.append(None)
        if not text:
            continue
        enc = first.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i)
                      else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            continue
        groups, at, to = [([], [])], 0, 0
        a, b = a[::-1], b[::-1]
        while a or b:
            side, other = (0, a) if at <= to else (1, b)
            no, token = other.pop()
            groups[-1][side].append(no)
            at, to = (at + len(token), to) if side == 0 else (at, to + len(token))
            if at == to and (a or b):
                groups.append(([], []))
        found[-1] = groups
    docs = Counter()
    for groups in found:
        docs.update({(x, y) for g in groups or [] for x in g[0] for y in g[1]})
    top = Counter()
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for groups in found:
        links = [(x, y) for g in groups or [] for x in g[0] for y in g[1]]
        body = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups or [])
        out.append((sum(len(g[0]) for g in groups or []), sum(len(g[1]) for g in groups or []),
                    len(groups or []), len(links),
                    hashlib.sha256(body.encode()).hexdigest() if groups else "",
                    sum(docs[x] == top[x[0]] for x in links), sum(docs[x] for x in links)))
    return out


def aligned(docs):
    return alignment.align(docs, BYTE_LEVEL, PIECES).select(
        "doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


@pytest.mark.parametrize("piece,block,joined", [(1 << 20, 4 << 20, 1 << 22), (300, 700, 50)])
def test_links_equal_a_plain_version(spark, monkeypatch, piece, block, joined):
    for name, value in (("SLICE", piece), ("BLOCK", block), ("JOINED", joined)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(block)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "\n\n", "▁ x", "  two  spaces ", "̀e", "a" * 5_000,
              "日本" * 700, " " * 900, "<|endoftext|>", texts[0], texts[0], "\x00\x01", "x\r\ny",
              " ​﻿x", "".join(chr(c) for c in range(1, 700) if c != 0x2581)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in aligned(docs.repartition(3)).collect()}
    want = plain(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[0] > 0 for w in want) >= len(texts) - 4


def test_merging_by_ranks_is_the_same_encoding():
    with open(BYTE_LEVEL, "rb") as a, open(PIECES, "rb") as b:
        encoders = alignment.Encoders.load(a.read(), b.read())
    assert encoders.ranked is not None
    rng = random.Random(6)
    texts = [f"a{chr(c)}1 {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice([chr(rng.randrange(0x250)), " ", "  ", "\n", "'s", "'LL", "a", "12"])
                      for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    for at in range(0, len(texts), 4_000):
        some = texts[at:at + 4_000]
        want = [x.ids for x in encoders.first.encode_batch_fast(some, add_special_tokens=False)]
        assert [encoders.ranked.encode_ordinary(t) for t in some] == want
    raw = json.loads(open(BYTE_LEVEL, encoding="utf-8").read())
    spelt = encoders.bytes_a.to_pylist()
    assert alignment.by_ranks(encoders.first, raw | {"normalizer": {"type": "NFC"}}, spelt) is None
    raw["model"]["merges"] = raw["model"]["merges"][::-1]
    assert alignment.by_ranks(encoders.first, raw, spelt) is None


def test_texts_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('41ff42') AS string) AS text UNION ALL "
                     "SELECT 2L, 'fine' UNION ALL SELECT NULL, 'fine'")
    got = {r["doc_id"]: tuple(r)[1:] for r in aligned(docs).collect()}
    assert got[1] == (0, 0, 0, 0, "", 0, 0) and got[2] == got[None] and got[2][0] > 0


def test_vocabularies_spell_their_tokens():
    with open(BYTE_LEVEL, "rb") as a, open(PIECES, "rb") as b:
        encoders = alignment.Encoders.load(a.read(), b.read())
    for text in ("x é日 \U0001f600\n<0x41>", "don't  stop"):
        for ids, vocabulary in zip(encoders.encode([text]), (encoders.bytes_a, encoders.bytes_b)):
            assert b"".join(vocabulary.take(ids[0].values).to_pylist()) == b" " + text.encode()
    assert pa.types.is_binary(encoders.bytes_a.type)
