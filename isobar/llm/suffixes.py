"""Exact substring dedup by common-prefix interval trees over a sparse suffix array.

A string of ``length`` bytes holds an anchor: the place, among the starts of its runs of ``GRAM``
bytes, where a hash of the run is smallest. The anchor depends on the string alone, so equal
strings have equal anchors at equal offsets, and only about one suffix in ninety, those that start
at anchors, has to be sorted. Suffixes whose anchors have the same hash form a bucket. Their
contexts are the bytes that all strings with this anchor span.

* Contexts found twice as they are repeat as a whole. Most repeats end here, by counting.
* In buckets with different contexts the distinct ones form an enhanced suffix array: sorted by the
  bytes from the anchor on, with the lengths of common prefixes. A stack scan builds the tree of
  common-prefix intervals. In every interval the same scan over the bytes before the anchor, read
  backwards, tells whether and where left extensions differ, which yields the maximal repeats with
  all their members, not just neighbours.
* A bucket with more than ``BUCKET`` distinct contexts, such as the edge of a passage that very
  many documents share, is dealt further by the hash of each string in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import beside, stored, utf8

LENGTH = 200
GRAM = 24
BUCKET = 2_000
CHUNK = 1 << 20
KEY = ["id", "digest"]
ANCHOR = "id string, digest bigint, p int, lo int, hi int, g bigint, c bigint"


def _mixed(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a multiple of eight) from each place on."""
    word = words.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[:-step] | (word[step:] << np.uint64(8 * step))
    n = len(words) - gram + 1
    out = np.zeros(n, dtype=np.uint64)
    for at in range(0, gram, 8):
        out = (out ^ word[at:at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach, n = 1, len(values) - width + 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:n], values[width - reach:width - reach + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of all strings of ``length`` bytes inside the texts ``data[starts[d]:starts[d + 1]]``.

    Yields arrays: text, anchor, first and last start of the strings it belongs to (absolute), hash.
    """
    ends = np.repeat(starts[1:], np.diff(starts))
    for first in range(0, max(len(data) - length + 1, 0), CHUNK // 2):
        part = data[first:first + CHUNK // 2 + length - 1]
        if len(part) < length:
            break
        hashes = _mixed(part, gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        packed = (hashes & ~np.uint64(CHUNK - 1)) | places
        best = _sliding_min(packed, length - gram + 1) & np.uint64(CHUNK - 1)
        start = np.flatnonzero(np.arange(first, first + len(best)) + length
                               <= ends[first:first + len(best)])
        if not len(start):
            continue
        at = best[start].astype(np.int64)
        new = (np.diff(at, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1)
        lo, hi = start[new], start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
        text = np.searchsorted(starts, first + lo, side="right") - 1
        yield text, first + at[new], first + lo, first + hi, hashes[at[new]].view(np.int64)


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            raw = data.tobytes()
            for text, at, lo, hi, g in anchors(data, starts, length):
                contexts = np.array([xxhash.xxh3_64_intdigest(raw[a:b + length], p - a)
                                     for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist())],
                                    dtype=np.uint64).view(np.int64)
                owner, base = pa.array(text), starts[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(owner), batch.column("digest").take(owner),
                     *(pa.array(x - base, pa.int32()) for x in (at, lo, hi)),
                     pa.array(g), pa.array(contexts)], [*KEY, "p", "lo", "hi", "g", "c"])

    return run


def _contexts(length: int):
    """The bytes of the listed anchors of each text, before and from the anchor on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for text, asked in zip(batch.column("text"), batch.column("asked")):
                raw = text.as_buffer().to_pybytes()
                for x in asked.as_py():
                    rows.append((x["g"], x["c"], x["n"], raw[x["lo"]:x["p"]],
                                 raw[x["p"]:x["hi"] + length]))
                    size += x["hi"] + length - x["lo"]
                if size > 1 << 23:
                    yield _context_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _context_batch(rows)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
        ["g", "c", "n", "left", "right"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - 1 - (differ.bit_length() - 1) // 8


def prefix_intervals(lcp: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """Intervals ``(depth, first, last)`` of suffixes that share ``depth`` bytes and no more.

    ``lcp[i]`` is the common prefix of the sorted suffixes ``i`` and ``i + 1``. Children come first.
    """
    stack: list[tuple[int, int]] = []
    for i in range(len(lcp) + 1):
        depth, left = (lcp[i] if i < len(lcp) else -1), i
        while stack and stack[-1][0] > depth:
            found, left = stack.pop()
            yield found, left, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def maximal_repeats(lefts: Sequence[bytes], rights: Sequence[bytes],
                    length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Repeats of ``length`` bytes or more through an anchor, as ``(before, after, members)``.

    ``lefts`` and ``rights`` are the bytes before and from the anchor on. A repeat is not followed
    by one byte, nor preceded by one byte, in all its members.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    turned = [left[::-1] for left in lefts]
    reach = max(map(len, lefts))
    for after, first, last in prefix_intervals(lcp):
        if after + reach < length:
            continue
        members = sorted(order[first:last + 1], key=turned.__getitem__)
        lcs = [common_prefix(turned[a], turned[b]) for a, b in zip(members, members[1:])]
        if after + max(lcs) < length:
            continue
        for before, a, b in prefix_intervals(lcs):
            if before + after >= length:
                yield before, after, members[a:b + 1]


def _scan_buckets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            reach: dict[int, tuple[int, int]] = {}
            for before, after, members in maximal_repeats(
                    [r[2] for r in rows], [r[3] for r in rows], length):
                for i in members:  # all repeats of a context hold its anchor: one range in sum
                    a, b = reach.get(i, (0, 0))
                    reach[i] = max(a, before), max(b, after)
            if reach:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[0][0]] * len(reach), pa.int64()),
                     pa.array([rows[i][1] for i in reach], pa.int64()),
                     *(pa.array([x[k] for x in reach.values()], pa.int32()) for k in (0, 1))],
                    ["g", "c", "before", "after"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows ``(g, c, left, right)`` of each bucket; the input is sorted by bucket."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("g", "c", "left", "right"))):
            if rows and rows[0][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _whole_strings(length: int):
    """Every string of a context by its hash, for buckets that are too large to sort at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c, left, right in zip(*(batch.column(k).to_pylist()
                                           for k in ("g", "c", "left", "right"))):
                text = left + right
                digests = [hashlib.blake2b(text[i:i + length], digest_size=16).digest()
                           for i in range(len(text) - length + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * n, pa.int64()), pa.array([c] * n, pa.int64()),
                     pa.array([len(left) - i for i in range(n)], pa.int32()),
                     pa.array(digests, pa.binary())], ["g", "c", "before", "string"])

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """``id, digest, spans``: byte ranges of repeated strings in the rows ``(id, digest, text)``.

    Rows equal in id and text count as often as they occur. Ranges may overlap.
    """
    found = stored(keyed.select(*KEY, "text").mapInArrow(_find_anchors(length), ANCHOR), "anchors")
    # Counts are written before they are joined: adaptive execution splits the hot keys of a join
    # of two exchanges, but not beside an aggregate.
    groups = stored(found.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c0"),
                                           F.max("c").alias("c1")).filter("n > 1"), "buckets")
    again = stored(found.join(groups.select("g", (F.col("c0") != F.col("c1")).alias("differ")),
                              "g"), "repeated")
    whole = [F.col("lo").alias("a"), (F.col("hi") + length).alias("b")]

    classes = stored(again.filter("differ").groupBy("g", "c").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY, "p", "lo", "hi")).alias("one")), "contexts")
    asked = classes.select("one.id", "one.digest", F.struct(
        "g", "c", "n", "one.p", "one.lo", "one.hi").alias("x")).groupBy(*KEY).agg(
        F.collect_list("x").alias("asked"))
    texts = (keyed.select(*KEY, "text").join(asked, KEY)
             .select("asked", F.encode("text", "UTF-8").alias("text"), *KEY))
    contexts = stored(texts.dropDuplicates(KEY).select("text", "asked").mapInArrow(
        _contexts(length), "g bigint, c bigint, n bigint, left binary, right binary"), "bytes")

    sizes = stored(classes.groupBy("g").agg(F.count("*").alias("classes")), "sizes")
    sized = contexts.join(sizes, "g")
    small = (sized.filter(F.col("classes") <= bucket).select("g", "c", "left", "right")
             .repartition("g").sortWithinPartitions("g"))
    scanned = small.mapInArrow(_scan_buckets(length), "g bigint, c bigint, before int, after int")
    strings = sized.filter(F.col("classes") > bucket).select("g", "c", "left", "right").mapInArrow(
        _whole_strings(length), "g bigint, c bigint, before int, string binary")
    twice = stored(strings.groupBy("g", "before", "string").agg(F.count("*").alias("n"))
                   .filter("n > 1").drop("n"), "strings")
    dealt = (strings.join(twice, ["g", "before", "string"], "left_semi")
             .select("g", "c", "before", (F.lit(length) - F.col("before")).alias("after")))
    parts = stored(scanned.unionByName(dealt).groupBy("g", "c").agg(
        F.max("before").alias("before"), F.max("after").alias("after")), "parts")

    counted = again.filter("differ").join(classes.select("g", "c", "n"), ["g", "c"])
    once = (counted.filter("n = 1").join(parts, ["g", "c"])
            .select(*KEY, (F.col("p") - F.col("before")).alias("a"),
                    (F.col("p") + F.col("after")).alias("b")))
    spans = (again.filter("NOT differ").select(*KEY, *whole)
             .unionAll(counted.filter("n > 1").select(*KEY, *whole)).unionAll(once))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: Sequence[str] | None = None, length: int = LENGTH,
                   bucket: int = BUCKET, with_rest: bool = True) -> DataFrame:
    """``docs`` in a struct ``doc`` (of the columns ``keep``), without repeated strings.

    Every byte covered by a string of ``length`` bytes that starts anywhere else too is removed,
    judged on the input. Columns: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and ``rest``, the remaining bytes (null unless ``with_rest``). Null texts count
    as empty; texts shorter than ``length`` keep everything. Repeated rows count as copies of each
    other, null ids as an id. An empty table stays empty.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
        F.xxhash64(F.col(id_col).isNull(), text_col).alias("digest"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, text_of, kind = beside(
        keyed.join(repeated_spans(keyed, length, bucket), KEY, "left"), "text", ["doc", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = itemgetter("a", "b")
        for batch in batches:
            doc, spans = batch.column("doc").field(0), batch.column("doc").field(1)
            out = []
            for text, found in zip(text_of(batch), spans):
                raw = text.as_buffer().to_pybytes()
                gone = merged([pair(x) for x in found.as_py() or ()])
                edges = [0, *(x for span in gone for x in span), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(rest), len(gone),
                            hashlib.sha256(rest).hexdigest(), rest if with_rest else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [doc, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])

    kind = rows.schema["doc"].dataType["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
                                "kept_sha256 string, rest binary")
