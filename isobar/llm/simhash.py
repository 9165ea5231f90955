"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints within ``radius`` bits agree exactly in some ``blocks - radius`` of ``blocks`` equal
blocks. For every such choice the chosen blocks are moved to the front, and the fingerprints are
sorted by the Gray rank of the result: all that share the chosen bits form one top node of the
index, its lower nodes share eight bits more each. A search walks pairs of nodes downwards, adds up
the differences of their shared bit patterns and drops a pair of groups once they pass the radius.

Copies of a fingerprint share their leaf, and their pairs are made apart from the index. A top node that is still large is
dealt again by the same rule on its free bits, until a node is small or its free bits are at most
sixteen, which bounds the distinct fingerprints of a node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import beside, slices, stored
from isobar.llm.components import components
from isobar.llm.shingles import mix

BITS = 64
SHINGLE = 3
RADIUS = 2
LARGE_NODE = 20_000
# Rows that a task deals out, about.
DEALT_ROWS = 1 << 20
PAIRS = 1 << 19


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of a text's runs of ``size`` words, repeats included; 0 without words.

    A-Z are lower-cased; fewer words than ``size`` form one run.
    """
    return simhash(run_hashes(text, size))


def run_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    size = min(size, len(words))
    runs = words if size == 1 else map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    return [digest(run, 42) for run in runs]


def simhash(hashes: Sequence[int]) -> int:
    """The majority of each bit; 0 without hashes."""
    hashes = np.array(hashes, dtype=">u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8)).reshape(-1, BITS)
        votes += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None,
                     size: int = SHINGLE) -> DataFrame:
    """``docs`` in a struct ``doc`` (of the columns ``keep``) and ``bits``, the signed fingerprint.

    Null texts count as empty: fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_of(batch)
            for at, n in slices(texts):
                found = [fingerprint(t or b"", size)
                         for t in texts.slice(at, n).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, n),
                     pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc", "bits"])

    rows, text_of, kind = beside(docs, text_col, keep)
    return rows.mapInArrow(run, f"doc {kind}, bits bigint")


def _gather(value: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """The bits of the spans (first, width; from the top of ``BITS``) side by side."""
    out = np.zeros_like(value)
    for first, width in spans:
        field = value >> np.uint64(BITS - first - width) & np.uint64((1 << width) - 1)
        out = out << np.uint64(width) | field
    return out


def _split(first: int, width: int, parts: int) -> list[tuple[int, int]]:
    cuts = [first + width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _deal(points: DataFrame, width: int, blocks: int, radius: int,
          only: Sequence[str] | None = None) -> DataFrame:
    """Every point once per choice of equal blocks among the ``width`` low bits of ``free``.

    ``node`` becomes a hash of the node before, the choice and its bits, ``free`` the other bits,
    ``rank`` their Gray rank. ``only`` these columns leave the tasks. The choices are made in the
    tasks: as expressions they would make the plan, and the driver's memory, grow with their number.
    """
    spans = _split(BITS - width, width, blocks)
    others = [c for c in points.columns if c not in ("node", "free")]
    names = list(only or [*others, "node", "free", "rank"])
    kinds = {c: points.schema[c].dataType.simpleString() for c in points.columns} | {"rank": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, free = (batch.column(c).to_numpy().view(np.uint64) for c in ("node", "free"))
            for no, chosen in enumerate(combinations(range(blocks), blocks - radius)):
                start = mix(node ^ np.uint64((no + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                rest = _gather(free, [spans[k] for k in range(blocks) if k not in chosen])
                own = {"node": mix(start ^ _gather(free, [spans[k] for k in chosen])),
                       "free": rest, "rank": gray_rank(rest)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[c].view(np.int64)) if c in own else batch.column(c)
                     for c in names], names)

    return points.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def gray_rank(value: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the sequence in which neighbours differ in one bit."""
    for k in (1, 2, 4, 8, 16, 32):
        value = value ^ (value >> np.uint64(k))
    return value


def _patterns(free: np.ndarray, width: int, depth: int) -> np.ndarray:
    """The eight bits that the nodes at ``depth`` share beyond those above, or what is left."""
    shift = width - 8 * (depth + 1)
    return (free >> shift if shift >= 0 else free << -shift) & 255


def _crossed(a: np.ndarray, b: np.ndarray, of_a: np.ndarray,
             of_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the leaves that start at ``a`` and ``b`` and hold ``of_`` rows each."""
    size = of_a * of_b
    ends = np.cumsum(size)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        nth = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
        at = np.searchsorted(ends, nth, side="right")
        nth = nth - (ends[at] - size[at])
        yield a[at] + nth // of_b[at], b[at] + nth % of_b[at]


def _descend(node: np.ndarray, free: np.ndarray, width: int,
             radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one node within ``radius``. Rows are in the order of the index.

    Every row of a leaf takes part; pairs inside a leaf are left out.
    """
    ones = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)
    depth_of = -(-width // 8)
    starts = [np.flatnonzero(np.diff(node, prepend=-1))]  # the first row of every node of a level
    label, pattern = [node], []
    for depth in range(depth_of):
        bits = _patterns(free, width, depth)
        new = np.concatenate(([True], (np.diff(label[-1]) != 0) | (np.diff(bits) != 0)))
        label.append(np.cumsum(new) - 1)
        starts.append(np.flatnonzero(new))
        pattern.append(bits[starts[-1]])
    held = np.diff(np.append(starts[-1], len(node)))  # the rows of every leaf
    # children[d][i]: the nodes of level d + 1 that lie in node i of level d
    first = [np.searchsorted(starts[d + 1], starts[d]) for d in range(depth_of)]
    count = [np.diff(np.append(first[d], len(starts[d + 1]))) for d in range(depth_of)]

    def walk(depth: int, a: np.ndarray, b: np.ndarray, far: np.ndarray):
        if depth == depth_of:
            other = a != b
            a, b = a[other], b[other]
            yield from _crossed(starts[depth][a], starts[depth][b], held[a], held[b])
            return
        size = count[depth][a] * count[depth][b]
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // PAIRS, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(a))):
            n = size[lo:hi]
            at = np.repeat(np.arange(lo, hi), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = first[depth][a[at]] + nth // count[depth][b[at]]
            y = first[depth][b[at]] + nth % count[depth][b[at]]
            gone = far[at] + ones[pattern[depth][x] ^ pattern[depth][y]]
            near = (gone <= radius) & (x <= y)
            if near.any():
                yield from walk(depth + 1, x[near], y[near], gone[near])

    sizes = np.diff(np.append(starts[0], len(node)))
    roots = np.flatnonzero(sizes > 1)
    if len(roots):
        yield from walk(0, roots, roots, np.zeros(len(roots), dtype=np.int64))


# Chooses among pairs of rows: given all rows and the places of both sides, returns places.
Choose = Callable[[pd.DataFrame, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def spanning(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pair per row that connects the same rows as all pairs do.

    For components it is enough, and its size is that of the rows, however many pairs there are.
    """
    root = np.arange(len(rows))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            break
        root = low
    linked = np.flatnonzero(root != np.arange(len(rows)))
    return linked, root[linked]


def _search(radius: int, width: int, columns: Sequence[str], choose: Choose | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _closed(batches, "node"):
            node = np.cumsum(rows["node"].diff().fillna(0).ne(0).to_numpy())
            bits, values = rows["bits"].to_numpy(), rows[["bits", *columns]]
            for a, b in _descend(node, rows["free"].to_numpy(), width, radius):
                # Nodes are told apart by a hash, so the whole fingerprints have the last word.
                near = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)) <= radius
                yield _paired(values, a[near], b[near], choose)

    return run


def _search_equal(columns: Sequence[str], choose: Choose | None):
    """All pairs of rows with one fingerprint."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _closed(batches, "bits"):
            bits = rows["bits"].to_numpy()
            starts = np.flatnonzero(np.append(True, bits[1:] != bits[:-1]))
            held = np.diff(np.append(starts, len(bits)))
            for a, b in _crossed(starts, starts, held, held):
                yield _paired(rows[["bits", *columns]], a[a < b], b[a < b], choose)

    return run


def _paired(values: pd.DataFrame, a: np.ndarray, b: np.ndarray, choose: Choose | None) -> pd.DataFrame:
    if choose is not None:
        a, b = choose(values, a, b)
    x, y = (values.iloc[k].reset_index(drop=True) for k in (a, b))
    return pd.concat([x.add_prefix("a_"), y.add_prefix("b_")], axis=1)


def _closed(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The sorted batches, cut so that no key lies in two of them."""
    rest = None
    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        last = np.flatnonzero((rows[key] != rows[key].iloc[-1]).to_numpy()) if len(rows) else []
        cut = last[-1] + 1 if len(last) else 0
        rest = rows.iloc[cut:]
        if cut:
            yield rows.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def blocks_for(n: int, radius: int) -> int:
    """Blocks such that a top node holds a few of ``n`` fingerprints if these are random."""
    blocks = radius + 1
    while blocks < BITS // 2 and 4 << (BITS * (blocks - radius) // blocks) < n:
        blocks += 1
    return blocks


def near_pairs(points: DataFrame, radius: int = RADIUS, blocks: int | None = None,
               choose: Choose | None = None) -> DataFrame:
    """Pairs of ``points`` whose ``bits`` differ in at most ``radius`` bits.

    Columns ``a_bits``, ``b_bits`` and likewise for all other columns. Every pair is found, some
    more than once, unless ``choose`` takes some of those found together. May be empty. Points with
    other columns may share their ``bits``; they are compared with each other apart from the index.
    """
    columns = [c for c in points.columns if c != "bits"]
    number = points.count()
    blocks = blocks or blocks_for(number, radius)
    rows = points.withColumns({"node": F.lit(0).cast("long"), "free": F.col("bits")})
    # Few narrow rows lie in one partition, but are dealt many times.
    tasks = -(-number * comb(blocks, radius) // DEALT_ROWS)
    rows = rows.repartition(tasks, "bits") if tasks > 1 else rows
    kinds = [f"{side}_{c} {points.schema[c].dataType.simpleString()}"
             for side in "ab" for c in ("bits", *columns)]
    found, width = [], BITS
    if columns:
        twice = stored(points.groupBy("bits").agg(F.count("*").alias("members"))
                       .filter(F.col("members") > 1).select("bits"), "repeated-bits")
        if not twice.isEmpty():
            equal = points.join(twice, "bits", "left_semi").select("bits", *columns)
            found.append(equal.repartition("bits").sortWithinPartitions("bits").mapInPandas(
                _search_equal(columns, choose), ", ".join(kinds)))
    while True:
        dealt, spans = _deal(rows, width, blocks, radius), (width, blocks, radius)
        # Free bits of the choice that leaves most; the others start with zeros, which agree.
        width = sum(sorted((w for _, w in _split(0, width, blocks)), reverse=True)[:radius])
        large = None
        if width > 16:  # at most one node per LARGE_NODE points dealt
            large = stored(_deal(rows, *spans, only=["node"]).groupBy("node").agg(F.count("*").alias("members"))
                           .filter(F.col("members") > LARGE_NODE).select("node"), "large-nodes")
            large = None if large.isEmpty() else large
        small = dealt if large is None else dealt.join(large, "node", "left_anti")
        nodes = small.repartition("node").sortWithinPartitions("node", "rank")
        found.append(nodes.select("node", "free", "bits", *columns).mapInPandas(
            _search(radius, width, columns, choose), ", ".join(kinds)))
        if large is None:
            break
        rows = stored(dealt.drop("rank").join(large, "node", "left_semi"), "index")
    return reduce(DataFrame.unionAll, found)


def link_groups(ids: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``bits`` and ``component_id`` of every fingerprint in ``ids (id, bits)``.

    The component id is the smallest id that is not null among all rows whose fingerprints are
    linked to it through any number of steps; null if all are.
    """
    distinct = stored(ids.groupBy("bits").agg(F.min("id").alias("id")), "fingerprints")
    links = near_pairs(distinct.select("bits"), radius, choose=spanning).toDF("a", "b")
    groups = stored(components(links), "groups")
    rooted = (distinct.join(groups.withColumnRenamed("node", "bits"), "bits", "left")
              .select("bits", "id", F.coalesce("root", "bits").alias("root")))
    least = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return stored(rooted.join(least, "root").select("bits", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: Sequence[str] | None = None, size: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``docs`` in a struct ``doc`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows are kept
    and share their component. An empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"),
                       F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stored(with_fingerprint(rows, keep=["doc", "id"], size=size)
                    .select("doc.doc", "doc.id", "bits"), "marked")
    return (marked.join(link_groups(marked.select("id", "bits"), radius), "bits")
            .select("doc", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
                    "component_id"))
