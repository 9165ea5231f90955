"""SimHash, near copies and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from isobar.llm import copies, ngram_join, simhash, suffixes
from isobar.llm.components import components


def closed(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def bits_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", "ÀB c", "One two", "a b a b a b a b", "x\u000by z ONE two three " * 9):
        assert simhash.fingerprint(text.encode()) == bits_of(text)


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 700)]
    links += [(rng.randrange(800, 2_000), rng.randrange(800, 2_000)) for _ in range(500)]
    rng.shuffle(links)
    want = closed(2_000, links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len({r["node"] for r in got}) == len(got)
    assert {r["node"]: r["root"] for r in got} == {
        x: want[x] for a, b in links if a != b for x in (a, b)}

def test_plan_of_the_index_does_not_grow_with_its_choices(spark):
    points = spark.range(300).selectExpr("xxhash64(id) AS bits")

    def size(radius, blocks):
        found = simhash.near_pairs(points, radius, blocks, choose=simhash.spanning)
        return len(found._jdf.queryExecution().analyzed().toString())

    assert size(6, 8) < 1.2 * size(1, 2)  # 28 choices of blocks, and 2


@pytest.mark.parametrize("radius,blocks,large", [(2, 4, 20_000), (2, 4, 8), (3, 6, 8), (6, 8, 20_000)])
def test_index_finds_every_pair(spark, monkeypatch, radius, blocks, large):
    monkeypatch.setattr(simhash, "LARGE_NODE", large)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    points = {int(v) for v in base}
    for v in base[:20]:
        for _ in range(15):
            points.add(int(v ^ sum(1 << int(k) for k in set(rng.integers(0, 63, radius)))))
    points = np.array(sorted(points), dtype=np.int64)
    near = np.bitwise_count((points[:, None] ^ points).view(np.uint64)) <= radius
    want = {(int(points[i]), int(points[j])) for i, j in np.argwhere(near) if i < j}
    pairs = simhash.near_pairs(spark.createDataFrame([(int(x),) for x in points], "bits bigint"),
                               radius, blocks)
    assert {(min(r), max(r)) for r in map(tuple, pairs.collect())} == want


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab bc cd de ef".split()) for _ in range(rng.randrange(8)))
             for _ in range(250)]
    bits = [bits_of(t) for t in texts]
    links = [(i, j) for i in range(250) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 2]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)),
                                                        "doc_id bigint, text string")).collect()
    assert {r["doc"]["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        i: (f"{bits[i]:016x}", c) for i, c in enumerate(closed(250, links))}


def test_one_of_the_near_copies_stays(spark):
    rng = random.Random(4)

    def fresh(n):
        return [f"{rng.choice('bcdfgh')}{rng.randrange(5000)}" for _ in range(n)]

    docs, family = [], []
    for f in range(60):
        words = fresh(rng.randrange(60, 400))
        for copy in range(rng.randrange(1, 6)):
            edited = list(words)
            for _ in range(rng.randrange(1 + len(words) // 80)):
                edited[rng.randrange(len(edited))] = "zz"
            docs.append(" ".join(edited))
            family.append(f)
    docs += ["same five words in here", "same five words in there"]  # 1 of 2 runs each: not copies
    family += [100, 101]

    def runs(t):
        w = t.split()
        return set(zip(*(w[i:] for i in range(5))))

    sets = [runs(t) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i for i, c in enumerate(closed(len(docs), links)) if i == c}
    got = {r["doc_id"] for r in copies.keep_one(spark.createDataFrame(
        list(enumerate(docs)), "doc_id bigint, text string")).collect()}
    assert want <= got  # nothing goes that is no copy
    assert len(got - want) <= 0.05 * (len(docs) - len(want))  # recall of the search
    assert {family[i] for i in got} == set(family)


def test_all_partners_of_a_large_family_are_tried(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    docs = []
    for _ in range(1_000):  # near the base, but not near each other
        edited = list(base)
        for k in rng.sample(range(150), 3):
            edited[k] = f"x{rng.randrange(10 ** 6)}"
        docs.append(" ".join(edited))
    docs.append(" ".join(base))
    kept = copies.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))
    assert kept.count() <= 2


def test_recall_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    kept = {r["doc_id"] for r in copies.keep_one(docs).collect()}
    exact = ngram_join.linked_documents(docs, keep=["doc_id"])
    want = {r["component_id"] for r in exact.select("component_id").distinct().collect()}
    near = docs.select("text").distinct().count() - len(want)  # copies that are not exact
    assert want <= kept and len(kept - want) <= 0.05 * near


def test_all_points_with_one_fingerprint_are_paired(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    points = [(b, no) for no, b in enumerate([7] * 9 + [5] * 6 + [-1] * 3 + [1 << 40])]
    got = simhash.near_pairs(spark.createDataFrame(points, "bits bigint, no bigint"), 2, 4).collect()
    assert {(min(r.a_no, r.b_no), max(r.a_no, r.b_no)) for r in got} == {
        (i, j) for a, i in points for b, j in points
        if i < j and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_groups_of_one_word_set_are_told_apart(spark):
    rng = random.Random(9)
    words, docs, family = [f"w{k}" for k in range(120)], [], []
    for f in range(12):  # one set of words, in another order per family
        order = rng.sample(words, len(words))
        for _ in range(5):
            edited = list(order)
            k = rng.randrange(len(order) - 1)
            edited[k], edited[k + 1] = edited[k + 1], edited[k]
            docs.append(" ".join(edited))
            family.append(f)
    got = [r["doc_id"] for r in copies.keep_one(spark.createDataFrame(
        list(enumerate(docs)), "doc_id bigint, text string")).collect()]
    assert sorted(family[i] for i in got) == list(range(12))


def test_near_copies_with_null_ids(spark):
    rng = random.Random(10)
    docs = []
    for f in range(6):
        words = [f"f{f}w{rng.randrange(10 ** 6)}" for _ in range(150)]
        for copy in range(4):
            edited = list(words)
            edited[rng.randrange(8, 150)] = "zz"
            docs.append((None if f < 4 or copy == 0 else 10 * f + copy, " ".join(edited)))
    got = copies.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"].split()[7][:2]) for r in got) == [
        (0, "f0"), (0, "f1"), (0, "f2"), (0, "f3"), (41, "f4"), (51, "f5")]


def plain_removal(texts, length):
    where = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where.setdefault(t[i:i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for at in where.values():
        for d, i in at if len(at) > 1 else ():
            gone[d][i:i + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("bucket", [2_000, 1])
def test_repeated_strings_equal_brute_force(spark, bucket):
    rng = random.Random(5)
    words = [rng.choice("abcé") * rng.randrange(1, 6) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=n)) for n in (30, 60, 100, 200)]
    texts = []
    for k in range(50):
        parts = [" ".join(rng.choices(words, k=rng.randrange(80)))]
        for _ in range(rng.randrange(3)):
            cut = rng.randrange(20)
            parts += [rng.choice(passages)[cut:], " ".join(rng.choices(words, k=rng.randrange(40)))]
        texts.append("".join(parts))
    texts += ["é" * 300, "ab" * 150, texts[0], texts[0], "x" * 199, "", passages[3] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    raw = [t.encode() for t in texts]
    gone = plain_removal(raw, 200)
    for r in suffixes.remove_repeats(docs, bucket=bucket).collect():
        mask, data = gone[r["doc"]["doc_id"]], raw[r["doc"]["doc_id"]]
        rest = bytes(b for b, g in zip(data, mask) if not g)
        assert bytes(r["rest"]) == rest and r["n_bytes"] == len(data)
        assert r["n_removed"] == sum(mask) and r["n_spans"] == len(re.findall(b"\1+", bytes(mask)))
        assert r["kept_sha256"] == hashlib.sha256(rest).hexdigest()


def test_long_texts_are_cut_without_loss():
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 300, dtype=np.uint8)
    data = rng.integers(97, 123, suffixes.CHUNK + 5_000, dtype=np.uint8)
    for at in (5, suffixes.CHUNK // 2 - 150, len(data) - 300):  # one across the border of a chunk
        data[at:at + 300] = passage
    seen = {}
    for _, at, lo, hi, _ in suffixes.anchors(data, np.array([0, len(data)])):
        for p, a, b in zip(at, lo, hi):
            for s in range(a, b + 1):
                seen[s] = p - s
    assert len(seen) == len(data) - 199
    for k in range(101):
        assert seen[5 + k] == seen[suffixes.CHUNK // 2 - 150 + k] == seen[len(data) - 300 + k]


def test_interval_tree():
    rights = [b"abcd", b"abce", b"abx", b"b"]
    assert set(suffixes.prefix_intervals([3, 2, 0])) == {(3, 0, 1), (2, 0, 2), (0, 0, 3)}
    lefts = [b"zz1", b"yz1", b"zz1", b"z"]
    found = {(a, b, tuple(sorted(m))) for a, b, m in suffixes.maximal_repeats(lefts, rights, 4)}
    assert found == {(2, 3, (0, 1)), (2, 2, (0, 1, 2)), (3, 2, (0, 2))}
