import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.functions import cues
from parley.functions.vectors import embed
from parley.operators import memory as M


@pytest.fixture(scope="module")
def vectors(spark):
    """300 memories and 120 queries of three users; a third of the memories are copies of one."""
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(300, 8))
    vec[rng.random(300) < 0.34] = vec[0]
    vec = (vec / np.linalg.norm(vec, axis=1, keepdims=True)).astype(np.float32)
    users = rng.integers(0, 3, 300)
    seqs = np.sort(rng.choice(5_000, 300, replace=False))
    asks = [(1_000 + i, int(rng.integers(0, 3)), int(rng.integers(0, 5_000)), vec[rng.integers(0, 300)].tolist()) for i in range(120)]
    asks[0] = (1_000, 0, int(seqs[7]), vec[7].tolist())
    stored = [(i, int(users[i]), int(seqs[i]), vec[i].tolist()) for i in range(300)]
    random.Random(1).shuffle(stored)
    return asks, stored


def brute(asks, stored, fetch, k, capacity, earlier, own):
    found = {}
    for qid, user, seq, vec in asks:
        held = [m for m in sorted(stored, key=lambda m: m[2]) if not earlier or m[2] < seq][-capacity:]
        if own:
            held = [m for m in held if m[1] == user]
        gap = [(float(((np.float64(m[3]) - np.float64(vec)) ** 2).sum()), m[2], m) for m in held]
        near = [m for _, _, m in sorted(gap, key=lambda g: g[:2])[:fetch]]
        found[qid] = [m[0] for m in near if m[1] == user][:k]
    return {q: ids for q, ids in found.items() if ids}


@pytest.mark.parametrize("earlier,own,capacity", [(False, False, 50_000), (True, False, 50_000), (True, False, 40), (False, True, 100)])
@pytest.mark.parametrize("tile,queries", [(8_192, 8_192), (32, 16)])
def test_retrieval(spark, vectors, monkeypatch, earlier, own, capacity, tile, queries):
    monkeypatch.setattr(M, "TILE", tile)
    monkeypatch.setattr(M, "QUERIES", queries)
    monkeypatch.setattr(M, "SEQ_BLOCK", 512)
    asks, stored = vectors
    q = spark.createDataFrame(asks, "query_id bigint, user_id int, seq bigint, vec array<float>")
    m = spark.createDataFrame(stored, "mem_id bigint, user_id int, seq bigint, vec array<float>")
    hits = M.retrieve(q, m, earlier_only=earlier, own_first=own, capacity=capacity)
    got = {}
    for r in hits.orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["mem_id"])
    assert got == brute(asks, stored, 12, 4, capacity, earlier, own)


def test_most_tiles_are_skipped(spark, monkeypatch):
    """Memories in 12 heaps of 64: the rows of a full search, from a fraction of the tiles."""
    monkeypatch.setattr(M, "TILE", 32)
    rng = np.random.default_rng(2)
    heaps = rng.normal(size=(12, 16)) * 10
    vec = (heaps[rng.integers(0, 12, 768)] + rng.normal(size=(768, 16))).astype(np.float32)
    stored = [(i, 0, i, vec[i].tolist()) for i in range(768)]
    asks = [(i, 0, 768, (vec[i] + 0.1).tolist()) for i in range(0, 768, 12)]
    q = spark.createDataFrame(asks, "query_id bigint, user_id int, seq bigint, vec array<float>")
    m = spark.createDataFrame(stored, "mem_id bigint, user_id int, seq bigint, vec array<float>")
    sent = []
    matched = M._matched
    monkeypatch.setattr(M, "_matched", lambda reach, tiles, *more: sent.append((reach.count(), tiles.select("tile").distinct().count())) or matched(reach, tiles, *more))
    got = {}
    for r in M.retrieve(q, m, earlier_only=True).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["mem_id"])
    assert got == brute(asks, stored, 12, 4, 768, True, False)
    searched, tiles = sum(n for n, _ in sent), sent[0][1]
    print(f"{searched} of {tiles * len(asks)} pairs of a tile and a query searched")
    assert searched < 0.35 * tiles * len(asks)


def test_nothing_stored_or_asked(spark):
    q = spark.createDataFrame([(1, 0, 5, [1.0, 0.0])], "query_id bigint, user_id int, seq bigint, vec array<float>")
    m = spark.createDataFrame([(1, 0, 1, [1.0, 0.0])], "mem_id bigint, user_id int, seq bigint, vec array<float>")
    for earlier in (False, True):
        for own in (False, True):
            assert M.retrieve(q, m.limit(0), earlier_only=earlier, own_first=own).count() == 0
            assert M.retrieve(q.limit(0), m, earlier_only=earlier, own_first=own).count() == 0
            assert M.retrieve(q, m, earlier_only=earlier, own_first=own).count() == 1


def test_embedding_is_unit_length(spark):
    df = spark.createDataFrame([("Été dans la mer, été",), ("other words here",), ("été dans la mer été!",)], "text string")
    rows = [np.array(r[0]) for r in embed(df).select("vec").collect()]
    assert all(len(v) == 384 and abs(np.linalg.norm(v) - 1) < 1e-6 for v in rows)
    assert np.allclose(rows[0], rows[2]) and not np.allclose(rows[0], rows[1])


def test_candidates(spark):
    long = "x" * 81
    cases = {
        "Remember: my name is Arin and I hate spiders.": 5,
        "I am here": 3,
        "I am here?": None,
        f"I am {long}?": 3,
        "remember? my name is?": 4,
        "nothing special": None,
        "questions remain": None,
        "  ": None,
        "My name is I am I live I like remember never forget secret quest artifact": 10,
        "i\xa0am here": 3,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = df.orderBy("i").select(cues.memory_candidate(F.col("t"))["tenths"]).collect()
    assert [r[0] for r in got] == list(cases.values())
    plain = df.orderBy("i").select(cues.memory_candidate(F.col("t"), normalize=False)["tenths"]).collect()
    assert plain[-1][0] is None


def test_capacity_over_all_users(spark):
    df = spark.range(1, 101).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("user_id"))
    assert {r["seq"] for r in M.keep_capacity(df, 10).collect()} == set(range(91, 101))
    assert M.keep_capacity(df, 1_000).count() == 100


def test_bound_of_the_nearest():
    rng = np.random.default_rng(3)
    rough = rng.normal(size=(20, 1_000))
    rough[rng.random(rough.shape) < 0.3] = np.inf
    rough[3, 40:] = np.inf
    rough[4, rng.random(1_000) < 0.9] = np.nan
    bound = M._at_most(rough, 12)
    assert (bound >= np.partition(rough, 11, axis=1)[:, 11]).all() and np.isfinite(bound).all()
    assert ((rough <= bound[:, None]).sum(axis=1) >= 12).all()


def test_equal_memories_are_measured_in_bounded_memory():
    """All memories are as near as each other; the pairs to measure are never all at hand."""
    n, asked, dim = 4_096, 64, 128
    vec = lambda rows: pa.chunked_array([pa.array([[1.0] * dim] * rows, pa.list_(pa.float32()))])
    number = lambda rows: pa.array(np.arange(rows))
    left = pa.table({"query_id": number(asked), "user_id": number(asked), "vec": vec(asked), "lo": pa.array([0] * asked), "hi": pa.array([n] * asked)})
    right = pa.table({"mem_id": number(n), "mem_user": number(n), "mem_vec": vec(n), "pos": number(n)})
    tracemalloc.start()
    found = M._search(left, right, 12, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["mem_id"].to_pylist() == [*range(12)] * asked
    assert peak < 120 << 20
