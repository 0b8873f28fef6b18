"""Exact and near duplicates, components and shards against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import exact, shards, simhash
from parley.llm.components import components


def lowered(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("name", ["odd", "small", "empty"])
@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.length(t).cast("string").cast("binary")])
def test_exact_copies(request, name, digest):
    docs = request.getfixturevalue(name)
    groups = {}
    for r in docs.collect():
        groups.setdefault(lowered(r["text"]), []).append(r["doc_id"])
    want = sorted((i, max(ids), len(ids)) for ids in groups.values() for i in ids)
    found = exact.exact_copies(docs, digest=digest).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == want
    assert sorted(r["doc_id"] for r in found if r["kept"]) == sorted(max(ids) for ids in groups.values())


def test_drop_exact_copies(odd):
    left = exact.drop_exact_copies(odd)
    assert left.columns == odd.columns
    assert left.count() == len({lowered(r["text"]) for r in odd.collect()})


def plain_fingerprint(text):
    words = lowered(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(codes):
    """Smallest id reachable, from {id: code}, by comparing all codes."""
    ids = sorted(codes)
    value = np.array([codes[i] for i in ids], np.uint64)
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 2
    label = np.arange(len(ids))
    while True:
        new = np.where(near, label[None, :], len(ids)).min(1)
        if (new == label).all():
            return {i: ids[x] for i, x in zip(ids, label)}
        label = new


@pytest.mark.parametrize("name", ["odd", "small", "empty"])
def test_near_copies(request, name):
    docs = request.getfixturevalue(name)
    codes = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = plain_components(codes) if codes else {}
    found = simhash.near_copies(docs).collect()
    assert len(found) == docs.count()
    assert {r["doc_id"]: r["code"] % 2**64 for r in found} == codes
    assert {r["doc_id"]: r["component_id"] for r in found} == want


@pytest.mark.parametrize("node", [8, 2048])
def test_dense_codes(spark, node):
    """Thousands of codes near one another, so upper nodes are divided again, and chains."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    codes = {base[0] ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}
    for b in base:
        for _ in range(200):
            b ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            codes.add(b)
    codes |= {rng.getrandbits(64) for _ in range(300)}
    signed = {c: c - 2**64 if c >> 63 else c for c in codes}
    df = spark.createDataFrame([(c,) for c in signed.values()], "code bigint")
    root = {r["node"]: r["root"] for r in components(simhash.code_links(df, 2, node)).collect()}
    want = plain_components({s: c for c, s in signed.items()})
    assert {c: root.get(c, c) for c in signed.values()} == want


def test_links_in_node_prunes():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64))
    gray = np.argsort(codes)
    codes = codes[gray]
    pairs = {(int(a), int(b)) for q, o in simhash.links_in_node(codes, 2) for a, b in zip(q, o)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (10, 3)], "a bigint, b bigint")
    assert {tuple(r) for r in components(links).collect()} == {(5, 3), (4, 3), (3, 3), (10, 3), (9, 8), (8, 8)}
    assert components(links.limit(0)).count() == 0


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("k"))
    for n in (1, 2, 40):
        rows = keys.select("k", shards.jump_shards(F.col("k"), n).alias("j")).select("k", "j.*").collect()
        for r in rows:
            assert r["shard"] == plain_jump(r["k"] % 2**64, n) and r["grown"] == plain_jump(r["k"] % 2**64, n + 1)


@pytest.mark.parametrize("name", ["odd", "small", "empty"])
def test_shard_rows(request, name):
    docs = request.getfixturevalue(name)
    found = shards.shard_rows(docs, 40, cell_rows=2).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(found) == docs.count()
    slots = {}
    for r in found:
        t = text[r["doc_id"]]
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    plan = shards.shard_rows(docs, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digest_of_query(small):
    found = exact.exact_copies(small).select("doc_id", F.lower(F.hex("digest")).alias("h")).collect()
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    assert all(r["h"] == hashlib.sha256(lowered(text[r["doc_id"]])).hexdigest() for r in found)


@pytest.mark.parametrize("drop", [exact.drop_exact_copies, simhash.drop_near_copies])
def test_null_and_repeated_ids_keep_their_texts(spark, drop):
    """Only copies by content go, whatever the ids are."""
    texts = ["the cat sat on the mat today", "quarterly revenue rose by nine percent", "plant the bulbs in early autumn"]
    rows = [(None, t) for t in texts] + [(7, t.replace("the", "our") + " indeed yes") for t in texts]
    docs = spark.createDataFrame(rows + rows[:2] + [(3, texts[2])], "doc_id bigint, text string").repartition(3)
    left = sorted(((r["doc_id"], r["text"]) for r in drop(docs).collect()), key=str)
    assert left == sorted(rows[:2] + rows[3:] + [(3, texts[2])], key=str)
