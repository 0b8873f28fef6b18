"""Embedding links: bounds hold, tiles and whole tables against all pairs in double precision."""

import numpy as np
import pytest

from parley.llm import linked
from parley.llm.shared import spread_join, spread_min
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, member string, links int, size int, digest string"


def near_vectors(rng, n, d, spread):
    """Groups of vectors about the threshold apart, some equal, some scaled."""
    centres = rng.normal(size=(max(1, n // 6), d))
    rows = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d))
    rows[n // 2 : n // 2 + n // 8] = rows[: n // 8]
    return rows * rng.choice([1e-3, 1.0, 50.0], n)[:, None]


@pytest.mark.parametrize("d", [3, 64, 2_100])
def test_bounds_hold(d):
    rng = np.random.default_rng(d)
    rows = linked.scaled(near_vectors(rng, 80, d, 0.3))
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    codes, step, rest = linked.quantised(unit)
    assert codes.dtype == np.int8 and abs(codes.astype(int)).max() <= 127
    exact = codes.astype(np.int64) @ codes.astype(np.int64).T
    assert (linked.products(codes, codes) == exact).all()
    apart = abs(exact * step[:, None] * step - unit @ unit.T)
    assert (apart <= rest[:, None] + rest + rest[:, None] * rest + 1e-12).all()


@pytest.mark.parametrize("d,spread", [(8, 0.15), (64, 0.27), (64, 0.001)])
def test_tile_by_all_pairs(d, spread):
    rng = np.random.default_rng(5)
    rows = near_vectors(rng, 700, d, spread)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    want = set(zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))))
    counts = {}
    got = [p for a, b in linked.tile_links(rows, rows, 0.93, True, counts) for p in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want and want
    # full precision is for the pairs near the threshold only
    assert counts["computed"] < 700 * 699 / 2 * 0.2
    across = {p for a, b in linked.tile_links(rows[:300], rows[300:], 0.93, False) for p in zip(a, b + 300)}
    assert across == {(a, b) for a, b in want if a < 300 <= b}


def test_huge_and_tiny_numbers():
    rows = np.array([[1e300, 1e300], [1e-300, 1.1e-300], [1e300, -1e300], [5e-324, 5e-324]])
    pairs = {p for a, b in linked.tile_links(rows, rows, 0.93, True) for p in zip(a.tolist(), b.tolist())}
    assert pairs == {(0, 1), (0, 3), (1, 3)}


def brute(rows, least=0.93):
    """(id, n_links, component) per row, by all pairs and a search over links."""
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not sound(a) or not sound(b) or len(a) != len(b):
                continue
            a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(near_vectors(rng, 240, 8, 0.12))]
    same = rows[7][1]
    rows += [(1_000 + i, same, 1) for i in range(120)]  # one vector with a third of all rows
    inf, nan = float("inf"), float("nan")
    rows += [(2_000, None, 1), (2_001, [0.0] * 8, 1), (2_002, [0.0] * 8, 1), (2_003, [None] + same[1:], 1)]
    rows += [(2_004, [nan] + same[1:], 1), (2_005, [inf] + same[1:], 1), (2_006, [], 1), (2_007, same, None), (2_008, same, None)]
    rows += [(2_009, same[:4], 1), (2_010, same[:4], 1), (None, same, 2), (None, same, 2), (2_011, same, 2), (2_011, same, 2)]
    rows += [(None, [1.0, 2.0], 9), (2_012, [-0.0, 1.0], 8), (2_013, [0.0, 1.0], 8)]
    return rows


@pytest.mark.parametrize("block", [linked.BLOCK, 50])
def test_table_by_all_pairs(spark, table, block):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in table], SCHEMA)
    got = linked.linked_vectors(frame, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id"]
    want = brute(table)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({c for _, n, c in want if n}) > 10


def test_doubles_and_empty(spark):
    assert linked.linked_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1e200, 0.0], 1), (2, [1e-200, 0.0], 1), (3, [0.0, 1.0], 1)]
    got = linked.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_hot_keys_are_dealt_out(spark):
    rows = spark.range(1_000).select("id", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7).alias("k"))
    table = rows.groupBy("k").agg(F.max("id").alias("top"))
    want = {(r["id"], r["k"], r["top"]) for r in rows.join(table, "k").collect()}
    got = spread_join(rows, table, ["k"], F.col("id"), 8).select("id", "k", "top")
    assert {tuple(r) for r in got.collect()} == want and got.count() == 1_000
    least = {(r["id"], r["low"]) for r in spread_min(rows, ["k"], "id", "low", F.col("id"), 8).collect()}
    assert least == {(i, min(j for j, k, _ in want if k == mine)) for i, mine, _ in want}
