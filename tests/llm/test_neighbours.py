"""Recall and exact scores against brute force; parts in size; odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, part string, vector int"


def brute(rows, k=10, step=10):
    """{query: [(id, distance)]} over usable rows."""
    rows = {i: np.array(v, np.float32).astype(float) for i, v in rows.items()}
    out = {}
    for q in rows:
        if q % step == 0:
            far = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), i) for i, v in rows.items() if i != q)
            out[q] = [(i, d) for d, i in far[:k]]
    return out


def found(df, step=10, **how):
    out = {}
    for r in neighbours.nearest_rows(df, F.col("vec_id") % step == 0, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def make(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("parts", [None, 16])
def test_recall(spark, parts):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    rows = {i: (centres[i % 30] + 0.4 * rng.normal(size=16)).tolist() for i in range(3000)}
    rows |= {i: rows[0] for i in range(3000, 4000)}  # a vector that a quarter of the rows hold
    want = brute(rows)
    got = found(make(spark, rows.items()), parts=parts, tile_rows=128, tile_queries=32)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert hits >= 0.95
    for q in want:
        for i, d in got[q]:
            a, b = np.array(rows[q], np.float32).astype(float), np.array(rows[i], np.float32).astype(float)
            assert d == pytest.approx(float(np.sqrt(((a - b) ** 2).sum())), abs=1e-12)
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))


def test_two_levels(spark):
    """More parts than the sample teaches: parts of parts, of fewer rows, recall as promised."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(80, 16))
    rows = {i: (centres[i % 80] + 0.5 * rng.normal(size=16)).tolist() for i in range(5000)}
    rows |= {i: rows[0] for i in range(5000, 6000)}
    want = brute(rows)
    df = make(spark, rows.items())
    got = found(df, parts=64, sample=1024, tile_rows=128, tile_queries=32)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert hits >= 0.9
    for q in want:
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))


def test_parts_of_parts(spark):
    """Every row lies in one leaf, leaves are many, and a query's leaves hold enough rows."""
    rng = np.random.default_rng(6)
    data = rng.normal(size=(4000, 8)).round(3)
    rows = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(data)], "id bigint, vector array<double>, part int")
    sizes = neighbours._part_sizes(rows)
    routers = neighbours._inner_routers(rows, sizes, 8, 512, 0.98)
    assert set(routers) == {0, 1, 2, 3}
    index = neighbours._deeper(rows, routers, 8).collect()
    assert sorted(r["id"] for r in index) == list(range(4000))
    assert all(r["part"] // 8 == r["id"] % 4 for r in index)
    leaves = {p: sum(r["part"] == p for r in index) for p in {r["part"] for r in index}}
    assert len(leaves) >= 24 and max(leaves.values()) < 1000 / 3
    asked = neighbours._deeper(rows.where("id < 40"), routers, 8, leaves, 300).collect()
    for q in range(40):
        own = [r["part"] for r in asked if r["id"] == q]
        assert len(own) == len(set(own)) and {p // 8 for p in own} == {q % 4}
        assert sum(leaves.get(p, 0) for p in own) >= 300 and len(own) >= routers[q % 4].asked


def test_odd_vectors(spark):
    good = {10: [1.0, 0.0], 20: [0.0, 1.0], 3: [1.0, 1.0], 4: [1.0, 1.0]}
    bad = [
        (30, None), (40, []), (50, [0.0, 0.0]), (60, [1.0, None]), (70, [float("nan"), 1.0]),
        (80, [float("inf"), 1.0]), (90, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
    ]
    df = make(spark, [*good.items(), *bad, (3, [1.0, 1.0])])
    want = brute(good)
    got = found(df)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[10]] == [3, 4, 20]


def test_few_or_no_rows(spark):
    assert found(make(spark, [])) == {}
    assert found(make(spark, [(10, [1.0])])) == {}
    assert found(make(spark, [(10, None)])) == {}
    assert found(make(spark, [(1, [1.0]), (2, [2.0])])) == {}


def test_balanced_parts():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 0.3, (n, 8)) for c, n in ((0, 700), (2, 200), (4, 124))])
    graph = neighbours.nearest(data, data, 10, np.arange(len(data)))
    part = neighbours.balanced_parts(data, graph, 8)
    size = np.bincount(part, minlength=8)
    assert size.max() <= np.ceil(1.1 * len(data) / 8) and size.min() >= np.floor(len(data) / 8 / 1.1) - 1
    kept = (part[graph] == part[:, None]).mean()
    mixed = (rng.permutation(part)[graph] == part[:, None]).mean()
    assert kept > 2 * mixed
