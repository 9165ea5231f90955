"""Token alignment between two tokenizers, as Arrow tables inside tasks and counts merged by Spark.

Each text is encoded twice. Tokens become flat Arrow arrays with their document as parent index;
cumulative sums of the tokens' bytes, taken per document, are the places where tokens end. A hash join
on (document, end) finds the ends that both tokenizers share, which cut the text into groups, and one
on the group yields the linked ids. ``Table.group_by`` counts a batch's documents per pair of ids,
Spark adds the counts up.

The encoded texts are written once, in blocks of a few megabytes of text. The corpus-wide counts go
back to the documents per block: a block asks for each of its pairs once, so a pair that every
document has is shuffled once per block, not once per document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isobar.llm.common import beside, slices, stored

# Bytes of text of a slice that is encoded at once, and of a block whose counts are looked up at once.
SLICE = 1 << 18
BLOCK = 4 << 20
# Links of one join; groups beyond it are joined one after the other.
JOINED = 1 << 22


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes in their order for the
    characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# How a byte-level vocabulary splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def by_ranks(tokenizer: Tokenizer, raw: dict, spelt: list[bytes]) -> tiktoken.Encoding | None:
    """The same byte-level encoding by ranks, several times faster; None where it may differ.

    Merging by the rank of the result equals merging by the list of pairs if results are in the
    order of their ids and every token, alone, is merged to itself: then no other pair of
    neighbours spells a token.
    """
    model, before = raw["model"], raw.get("pre_tokenizer") or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(p), -1) for p in pairs]
    special = {x["id"] for x in raw.get("added_tokens", [])}
    single = [no for no, t in enumerate(spelt) if len(t) == 1 and no not in special]
    if (raw.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
            or not before.get("use_regex", True) or model.get("ignore_merges")
            or len(single) != 256 or any(x >= y for x, y in zip([max(single), *made], made))
            or len(spelt) != 256 + len(made) + len(special)
            or any([x.id for x in tokenizer.model.tokenize("".join(p))] != [no]
                   for p, no in zip(pairs, made))):
        return None
    ranks = {spelt[no]: no for no in (*single, *made)}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Encoders:
    """Both tokenizers with the bytes of their tokens, as read from the contents of their files."""

    first: Tokenizer
    ranked: tiktoken.Encoding | None
    second: sentencepiece.SentencePieceProcessor
    bytes_a: pa.Array
    bytes_b: pa.Array

    @classmethod
    def load(cls, byte_level: bytes, pieces: bytes) -> Encoders:
        first = Tokenizer.from_str(byte_level.decode())
        first.encode_special_tokens = True
        second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        raw = json.loads(byte_level)
        of_a = [b""] * first.get_vocab_size()
        for token, no in raw["model"]["vocab"].items():
            of_a[no] = bytes(alphabet[c] for c in token) if set(token) <= alphabet.keys() else b""
        of_b = []
        for no in range(second.vocab_size()):
            piece = second.id_to_piece(no)
            of_b.append(bytes([int(piece[3:-1], 16)]) if second.is_byte(no) else b""
                        if second.is_control(no) else piece.replace("▁", " ").encode())
        return cls(first, by_ranks(first, raw, of_a), second, pa.array(of_a, pa.binary()),
                   pa.array(of_b, pa.binary()))

    def encode(self, texts: Sequence[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of every text by the first (with a space in front) and the second."""
        if self.ranked is not None:
            a = [self.ranked.encode_ordinary(" " + t) for t in texts]
        else:
            a = [x.ids for x in self.first.encode_batch_fast([" " + t for t in texts],
                                                             add_special_tokens=False)]
        b = self.second.encode(list(texts), num_threads=1)
        ids = pa.list_(pa.int32())
        return pa.array(a, ids), pa.array(b, ids)


@lru_cache(maxsize=1)
def loaded(files: tuple[bytes, bytes]) -> tuple[Encoders, pa.Array, int]:
    """The tokenizers, kept by a worker for its next tasks, and the strings of ``group_texts``."""
    encoders = Encoders.load(*files)
    width = max(len(encoders.bytes_a), len(encoders.bytes_b))
    strings = pa.array([f"{k}{sign}" for sign in (",", "|", ";", "") for k in range(width)],
                       pa.binary())
    return encoders, strings, width


@dataclass
class Tokens:
    """The tokens of several texts end to end: document, id, and the byte at which each ends."""

    doc: np.ndarray
    ids: np.ndarray
    end: np.ndarray
    whole: list[bool]  # whether the joined bytes of a text's tokens are the text's

    @classmethod
    def of(cls, ids: pa.Array, vocabulary: pa.Array, texts: Sequence[bytes]) -> Tokens:
        flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
        pieces = vocabulary.take(flat)
        total = pc.cumulative_sum(pc.binary_length(pieces).cast(pa.int64())).to_numpy()
        doc = doc.to_numpy()
        stop = np.cumsum(pc.list_value_length(ids).to_numpy())
        at = np.append(0, total)[np.append(0, stop)]
        joined = memoryview(pieces.buffers()[2] or b"").cast("B")
        whole = [joined[lo:hi] == t for lo, hi, t in zip(at[:-1].tolist(), at[1:].tolist(), texts)]
        return cls(doc, flat.to_numpy(), total - at[doc], whole)

    def only(self, docs: np.ndarray) -> Tokens:
        keep = docs[self.doc]
        return Tokens(self.doc[keep], self.ids[keep], self.end[keep], self.whole)


def shared_ends(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of both sides: groups end where tokens of both end."""
    left, right = (pa.table({"end": (x.doc << 40) + x.end, "at": np.arange(len(x.doc))})
                   for x in (a, b))
    both = left.join(right, "end", join_type="inner", right_suffix="_b", use_threads=False)
    groups = []
    for tokens, name in ((a, "at"), (b, "at_b")):
        cut = np.zeros(len(tokens.doc), dtype=np.int64)
        cut[both.column(name).to_numpy()] = 1
        groups.append(np.cumsum(cut) - cut)
    return groups[0], groups[1]


def linked_pairs(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray,
                 width: int) -> pa.Table:
    """``doc, pair, times``: the linked ids, as a * width + b, and how many links each has."""
    if not len(a.doc):
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()),
                         "times": pa.array([], pa.int64())})
    doc_of = np.zeros(group_a[-1] + 1, dtype=np.int64)
    doc_of[group_a] = a.doc
    size = np.cumsum(np.bincount(group_a) * np.bincount(group_b))
    if size[-1] <= JOINED:
        one, other = (pa.table({"group": group, "id": tokens.ids})
                      for tokens, group in ((a, group_a), (b, group_b)))
        links = one.join(other, "group", join_type="inner", right_suffix="_b", use_threads=False)
        rows = pa.table({"doc": doc_of[links.column("group").to_numpy()],
                         "pair": links.column("id").to_numpy().astype(np.int64) * width
                         + links.column("id_b").to_numpy()})
        return rows.group_by(["doc", "pair"], use_threads=False).aggregate(
            [([], "count_all")]).rename_columns({"count_all": "times"})
    # Long groups repeat their ids: each is joined once with its number, a part of them at a time.
    sides = [pa.table({"group": group, "id": tokens.ids}).group_by(
        ["group", "id"], use_threads=False).aggregate([([], "count_all")])
        for tokens, group in ((a, group_a), (b, group_b))]
    number = [np.bincount(x.column("group").to_numpy(), minlength=group_a[-1] + 1) for x in sides]
    part = np.cumsum(number[0] * number[1]) // JOINED
    found = []
    for no in np.unique(part).tolist():
        left, right = (x.filter(pa.array(part[x.column("group").to_numpy()] == no)) for x in sides)
        links = left.join(right, "group", join_type="inner", right_suffix="_b", use_threads=False)
        group, one, other, n, m = (links.column(c).to_numpy() for c in (
            "group", "id", "id_b", "count_all", "count_all_b"))
        rows = pa.table({"doc": doc_of[group], "times": n * m,
                         "pair": one.astype(np.int64) * width + other})
        found.append(rows.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]))
    return pa.concat_tables(found).group_by(["doc", "pair"], use_threads=False).aggregate(
        [("times_sum", "sum")]).rename_columns({"times_sum_sum": "times"})


def group_texts(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray,
                strings: pa.Array, width: int) -> tuple[pa.Array, np.ndarray]:
    """All ids in the order of the groups, each with the sign behind it, and their documents.

    ``strings`` holds every id below ``width`` with a comma, a bar, a semicolon and nothing.
    """
    before_b = np.searchsorted(group_b, group_a, "left")   # tokens of the other side that go first
    before_a = np.searchsorted(group_a, group_b, "right")
    ids, doc = (np.empty(len(a.doc) + len(b.doc), dtype=np.int64) for _ in range(2))
    last_a = np.append(group_a[1:] != group_a[:-1], True)
    last_b = np.append(group_b[1:] != group_b[:-1], True)
    end_b = np.append(b.doc[1:] != b.doc[:-1], True)
    place_a, place_b = np.arange(len(a.doc)) + before_b, np.arange(len(b.doc)) + before_a
    ids[place_a] = a.ids + last_a * width
    ids[place_b] = b.ids + np.where(end_b, 3, last_b * 2) * width
    doc[place_a], doc[place_b] = a.doc, b.doc
    return strings.take(pa.array(ids)), doc


SCHEMA = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
          "pairs array<bigint>, times array<bigint>, block bigint")


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def _encoded(texts: list[bytes | None], encoders: Encoders, strings: pa.Array, width: int) -> list:
    """The columns of ``SCHEMA`` but the last for some texts."""
    n = len(texts)
    expected = [b" " + t if t else b"" for t in texts]
    words = [(t or b"").decode("utf-8", "replace") for t in texts]
    ids = encoders.encode(words)
    a, b = (Tokens.of(x, vocabulary, expected) for x, vocabulary in zip(
        ids, (encoders.bytes_a, encoders.bytes_b)))
    used = np.array([bool(t) and x and y for t, x, y in zip(texts, a.whole, b.whole)], dtype=bool)
    a, b = a.only(used), b.only(used)
    digests = [""] * n
    if not len(a.doc):
        none = np.zeros(n, dtype=np.int64)
        empty = pa.array([[]] * n, pa.list_(pa.int64()))
        return [*(pa.array(none) for _ in range(4)), pa.array(digests), empty, empty]
    group_a, group_b = shared_ends(a, b)
    pieces, doc = group_texts(a, b, group_a, group_b, strings, width)
    ends = np.cumsum(pc.binary_length(pieces).to_numpy())
    data = memoryview(pieces.buffers()[2])
    lo = 0
    for last in np.flatnonzero(np.append(doc[1:] != doc[:-1], True)).tolist():
        digests[doc[last]] = hashlib.sha256(data[lo:ends[last]]).hexdigest()
        lo = int(ends[last])
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    first = np.flatnonzero(np.append(True, group_a[1:] != group_a[:-1]))
    rows = linked_pairs(a, b, group_a, group_b, width).sort_by(
        [("doc", "ascending"), ("pair", "ascending")])
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(
        rows.column("doc").to_numpy(), minlength=n))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks())
             for c in ("pair", "times")]
    return [*(pa.array(x) for x in (
        np.bincount(a.doc, minlength=n), np.bincount(b.doc, minlength=n),
        np.bincount(a.doc[first], minlength=n), _per_doc(size_a * size_b, a.doc[first], n))),
        pa.array(digests), *lists]


def _encode(files: Broadcast, text_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, strings, width = loaded(files.value)
        task, size = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = text_of(batch)
            for at, n in slices(texts, SLICE):
                some = texts.slice(at, n).cast(pa.large_binary()).to_pylist()
                block = np.full(n, (task << 32) + size // BLOCK, dtype=np.int64)
                size += sum(len(t or b"") for t in some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, n), *_encoded(some, encoders, strings, width),
                     pa.array(block)],
                    ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times",
                     "block"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a block hold each pair; a block may come in several parts."""
    for batch in batches:
        pairs = batch.column("pairs")
        rows = pa.table({"block": batch.column("block").take(pc.list_parent_indices(pairs)),
                         "pair": pc.list_flatten(pairs)})
        yield from rows.group_by(["block", "pair"], use_threads=False).aggregate(
            [([], "count_all")]).rename_columns({"count_all": "docs"}).to_batches()


def _looked_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block with ``n_best`` and ``count_sum``."""
    docs = docs.combine_chunks()
    pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    # A block counted in several parts asks for a pair more than once.
    known = counts.group_by("pair", use_threads=False).aggregate([("n", "max"), ("best", "max")])
    links = pa.table({"row": pc.list_parent_indices(pairs), "pair": pc.list_flatten(pairs),
                      "times": pc.list_flatten(times)}).join(known, "pair", use_threads=False)
    links = links.append_column("sum", pc.multiply(links.column("times"), links.column("n_max")))
    links = links.append_column("top", pc.multiply(
        links.column("times"), links.column("best_max").cast(pa.int64())))
    total = links.group_by("row", use_threads=False).aggregate([("sum", "sum"), ("top", "sum")])
    out = {c: np.zeros(len(docs), dtype=np.int64) for c in ("top", "sum")}
    for c, values in out.items():
        values[total.column("row").to_numpy()] = total.column(f"{c}_sum").to_numpy()
    return docs.drop_columns(["pairs", "times", "block"]).append_column(
        "n_best", pa.array(out["top"])).append_column("count_sum", pa.array(out["sum"]))


def align(docs: DataFrame, byte_level: str, pieces: str, text_col: str = "text",
          keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` in a struct ``doc``, with the counts of its tokens, groups and links.

    ``byte_level`` and ``pieces`` are the files of a byte-level BPE vocabulary and of a
    SentencePiece model; the driver reads them and sends their contents along. Columns: ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best`` (links whose pair occurs in as
    many documents as any pair of their first id does) and ``count_sum`` (over the links, the
    documents in which their pair occurs). Null and empty texts, texts that are not UTF-8 and texts
    that the tokens of either side do not spell have no tokens: zeros and an empty digest. Repeated
    rows count as documents of their own. An empty table stays empty.
    """
    files = (Path(byte_level).read_bytes(), Path(pieces).read_bytes())
    width = loaded(files)[2]
    files = docs.sparkSession.sparkContext.broadcast(files)
    rows, text_of, kind = beside(docs, text_col, keep)
    encoded = stored(rows.mapInArrow(_encode(files, text_of), f"doc {kind}, {SCHEMA}"), "encoded")
    asked = stored(encoded.select("block", "pairs").mapInArrow(
        _counted, "block bigint, pair bigint, docs bigint"), "pairs")
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn(
        "a", F.floor(F.col("pair") / width))
    counts = stored(counts, "counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    looked = asked.select("block", "pair").join(counts, "pair")
    return encoded.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(
        _looked_up, f"doc {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                    "groups_sha256 string, n_best bigint, count_sum bigint")
