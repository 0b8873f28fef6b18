"""Folds and ranks over skewed tables against brute force in Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.operators import sampling as S
from parley.operators.pairing import number_pairs, pair_messages
from parley.plans import ranks
from parley.plans.cells import cells_for
from parley.plans.folds import Order, carry, items_before, measure, number
from parley.plans.sizes import checked_broadcast


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows belongs to one key; turns have gaps."""
    rng = random.Random(7)
    rows = []
    for key in range(30):
        turn = 0
        for _ in range(400 if key == 0 else rng.randint(1, 40)):
            turn += rng.choice([1, 1, 1, 2, 60])
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "human"])
            text = rng.choice(["", "  ", "a", "b c", "why", "quest"])
            rows.append((key, turn, role, text))
    rng.shuffle(rows)
    return rows


def groups(rows):
    out = defaultdict(list)
    for r in sorted(rows):
        out[r[0]].append(r)
    return out


ORDERS = [Order(("k",), "turn"), Order(("k",), "turn", 16), Order(("k",), "turn", 1)]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("parts", [1, 8])
def test_folds(spark, skewed, order, parts):
    df = spark.createDataFrame(skewed, "k int, turn bigint, role string, text string").repartition(parts)
    cue = F.when(F.trim("text") != "", F.col("text"))
    got = carry(df, order, {"now": cue})
    got = carry(got, order, {"old": cue}, before=True)
    got = number(got, order, "n")
    got = items_before(got, order, F.col("text"), 5, "past")
    found = {(r["k"], r["turn"]): (r["now"], r["old"], r["n"], r["past"]) for r in got.collect()}
    want = {}
    for key, rows in groups(skewed).items():
        last, seen = None, []
        for i, (_, turn, _, text) in enumerate(rows, 1):
            before = last
            last = text if text.strip() else last
            want[key, turn] = (last, before, i, seen[-5:])
            seen.append(text)
    assert found == want


@pytest.mark.parametrize("block", [None, 16])
def test_pairing(spark, skewed, block):
    df = spark.createDataFrame(skewed, "conv_id int, turn bigint, role string, text string")
    order = Order(("conv_id",), "turn", block)
    pairs = number_pairs(pair_messages(df, order=order), order)
    got = sorted((r["conv_id"], r["turn"], r["user_turn"], r["user"], r["assistant"], r["pair_no"]) for r in pairs.collect())
    want = []
    for key, rows in groups(skewed).items():
        asked, count = None, 0
        for _, turn, role, text in rows:
            if not text.strip():
                continue
            if role in ("user", "human"):
                asked = (turn, text)
            elif role == "assistant" and asked:
                count += 1
                want.append((key, turn, *asked, text, count))
                asked = None
    assert got == sorted(want)


def test_measure_looks_at_the_longest_group(spark, skewed):
    df = spark.createDataFrame(skewed, "k int, turn bigint, role string, text string")
    assert measure(df, ["k"], "turn").block is None
    order = measure(df, ["k"], "turn", 100)
    longest = max(len(rows) for rows in groups(skewed).values())
    assert order.longest == longest and order.block >= 100
    most = order.cells(df).groupBy(*order.cell_keys).count().agg({"count": "max"}).first()[0]
    assert most <= 200  # blocks of sparse numbers still hold about as many rows


def test_measure_of_milliseconds(spark):
    """Large order numbers alone do not make blocks; a long group gets blocks of about BLOCK rows."""
    start = 1_700_000_000_000
    few = spark.range(1_000).select((F.col("id") % 7).alias("k"), (F.col("id") * 977 + start).alias("at"))
    assert measure(few, ["k"], "at").block is None
    many = spark.range(3_000).select(F.lit(1).alias("k"), (F.col("id") * 977 + start).alias("at"))
    order = measure(many, ["k"], "at", 500)
    assert order.cells(many).select(*order.cell_keys).distinct().count() <= 8
    got = number(many, order, "n").orderBy("at").select("n").collect()
    assert [r["n"] for r in got] == list(range(1, 3_001))


@pytest.fixture(scope="module")
def bursts(spark):
    """Milliseconds of one year: nine tenths of a long group's rows lie in one hour, a few in 2^60."""
    rng = random.Random(11)
    start, hour = 1_700_000_000_000, 3_600_000
    year = 365 * 24 * hour
    at = set()
    while len(at) < 2_700:
        at.add(start + year // 2 + rng.randrange(hour))
    while len(at) < 2_990:
        at.add(start + rng.randrange(year))
    at |= {2**60 + i for i in range(10)}
    rows = [("long", t) for t in at]
    rows += [(f"s{i % 40}", start + rng.randrange(year) * 50 + i) for i in range(800)]
    rows += [(None, start + i * 7_919) for i in range(1_500)]
    rng.shuffle(rows)
    return rows


def test_blocks_of_uneven_numbers(spark, bursts):
    """Rows of one hour of a year still fall into many blocks, and folds over them stay right."""
    df = spark.createDataFrame(bursts, "k string, at bigint")
    order = measure(df, ["k"], "at", 200)
    assert order.cuts is not None and order.longest == 3_000
    sizes = order.cells(df).groupBy(*order.cell_keys).count().where("k = 'long'").collect()
    assert len(sizes) >= 12 and max(r["count"] for r in sizes) <= 400
    cue = F.when(F.col("at") % 5 == 0, F.col("at"))
    named = df.where("k IS NOT NULL")
    got = number(carry(named, order, {"now": cue}), order, "n")
    got = items_before(got, order, F.col("at"), 3, "past")
    found = {(r["k"], r["at"]): (r["now"], r["n"], r["past"]) for r in got.collect()}
    back = order.backward("back")
    turned = carry(named.withColumn("back", -F.col("at")), back, {"next": cue}, before=True)
    ahead = {(r["k"], r["at"]): r["next"] for r in turned.collect()}
    want, want_ahead = {}, {}
    for key, rows in groups([r for r in bursts if r[0]]).items():
        times, last, following = [r[1] for r in rows], None, None
        for i, t in enumerate(times):
            last = t if t % 5 == 0 else last
            want[key, t] = (last, i + 1, times[max(0, i - 3) : i])
        for t in reversed(times):
            want_ahead[key, t] = following
            following = t if t % 5 == 0 else following
    assert found == want and ahead == want_ahead


def test_ranks_of_uneven_numbers(spark, bursts):
    rows = [r for r in bursts if r[0]]
    df = spark.createDataFrame(rows, "k string, at bigint")
    cells = cells_for(df, "at", 100)
    sizes = cells.add(df, "at", "cell").groupBy("k", "cell").count().collect()
    assert len({r["cell"] for r in sizes}) >= 25 and max(r["count"] for r in sizes) <= 200
    assert max(r["cell"] for r in sizes) <= 2 * len(rows) // 100  # as many cells as rows ask for, however wide the numbers
    got = ranks.rank_by_ordinal(df, "at", ["k"], block=100).collect()
    want = {(k, r[1]): i for k, rs in groups(rows).items() for i, r in enumerate(rs, 1)}
    assert {(r["k"], r["at"]): r["rank"] for r in got} == want
    newest = sorted(r[1] for r in rows)[::-1]
    for n in (1, 500, 3_800):
        assert {r["at"] for r in ranks.newest_rows(df, "at", n, 100).collect()} == set(newest[:n])


def test_cells_of_odd_columns(spark):
    """Empty tables, nulls, one number only and negative numbers."""
    empty = spark.createDataFrame([], "at bigint")
    assert cells_for(empty, "at", 10).add(empty, "at", "c").collect() == []
    odd = spark.createDataFrame([(None,), (5,), (-(2**62),), (2**62,)], "at bigint")
    got = cells_for(odd, "at", 1).add(odd, "at", "c")
    cells = [r["c"] for r in got.where("at IS NOT NULL").orderBy("at").collect()]
    assert cells == sorted(cells) and got.where("at IS NULL").first()["c"] is None
    same = spark.createDataFrame([(2**61,)] * 9 + [(0,)], "at bigint")
    cells = cells_for(same, "at", 2).add(same, "at", "c")
    assert {r["at"] for r in cells.orderBy("c").limit(1).collect()} == {0}


@pytest.fixture(scope="module")
def corpus(spark):
    """1,000 rows, a third of them from one source, ids with gaps."""
    rng = random.Random(3)
    ids = sorted(rng.sample(range(5_000), 1_000))
    rows = [(i, "hot" if rng.random() < 0.34 else f"s{rng.randint(0, 40)}") for i in ids]
    rng.shuffle(rows)
    return rows


def keys(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, source string")
    return S.with_key(df, "id")


def test_rank_by_key_and_cutoffs(spark, corpus):
    import hashlib

    md5 = lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest()
    order = sorted(corpus, key=lambda r: md5(r[0]))
    df = keys(spark, corpus)
    ranked = ranks.rank_by_key(df, S.KEY, digits=1)
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {r[0]: i for i, r in enumerate(order, 1)}
    for n in (1, 17, 999, 1_000, 5_000):
        got = {r["id"] for r in ranks.first_by_key(df, S.KEY, n, digits=1).collect()}
        assert got == {r[0] for r in order[:n]}
    got = {r["id"] for r in ranks.key_range(df, S.KEY, 101, 300, digits=1).collect()}
    assert got == {r[0] for r in order[100:300]}
    assert ranks.key_range(df, S.KEY, 2_000, 3_000).count() == 0
    capped = S.cap_sources(df.drop(S.KEY), "source", "id", rows=20)
    want, count = set(), defaultdict(int)
    for i, source in order:
        count[source] += 1
        if count[source] <= 20:
            want.add(i)
    assert {r["id"] for r in capped.collect()} == want


@pytest.mark.parametrize("fraction", [0.02, 0.1, 0.333])
def test_split_is_exact(spark, corpus, fraction):
    df = spark.createDataFrame(corpus, "id bigint, source string")
    rows = S.split_rows(df, fraction, "id").groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in rows}
    assert sizes["test"] == math.ceil(1_000 * fraction) and sum(sizes.values()) == 1_000
    again = S.split_rows(df.repartition(3), fraction, "id")
    first = S.split_rows(df.repartition(8), fraction, "id")
    assert again.exceptAll(first).isEmpty()


@pytest.mark.parametrize("block", [7, 100, 65_536])
def test_rank_by_ordinal(spark, corpus, block):
    df = spark.createDataFrame(corpus, "id bigint, source string")
    got = ranks.rank_by_ordinal(df, "id", ["source"], block=block).collect()
    want, count = {}, defaultdict(int)
    for i, source in sorted(corpus):
        count[source] += 1
        want[i] = count[source]
    assert {r["id"]: r["rank"] for r in got} == want
    for n in (1, 333, 1_000, 2_000):
        newest = {r["id"] for r in ranks.newest_rows(df, "id", n, block).collect()}
        assert newest == {r[0] for r in sorted(corpus)[-n:]}


def test_number_rows(spark, corpus):
    df = spark.createDataFrame(corpus, "id bigint, source string")
    got = ranks.number_rows(df.repartition(5), [F.col("source"), F.desc("id")]).collect()
    want = sorted(corpus, key=lambda r: (r[1], -r[0]))
    assert {r["id"]: r["rank"] for r in got} == {r[0]: i for i, r in enumerate(want, 1)}


def test_interleave_counts_rejected_rows(spark, corpus):
    df = spark.createDataFrame(corpus, "id bigint, source string")
    rows = S.interleave(df, "source", "id", keep=F.col("id") % 3 > 0, take=5).collect()
    streams = {s: [r[0] for r in sorted(corpus) if r[1] == s][:5] for s in {r[1] for r in corpus}}
    want = [
        streams[s][slot] for slot in range(5) for s in sorted(streams)
        if slot < len(streams[s]) and streams[s][slot] % 3 > 0
    ]
    assert [r["id"] for r in rows] == want


def test_buffer_shuffle_stays_in_blocks(spark, corpus):
    df = spark.createDataFrame(corpus, "id bigint, source string")
    rows = S.shuffle_blocks(df, "id", "id", buffer=64).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, 1_001))
    place = {i: n for n, (i, _) in enumerate(sorted(corpus))}
    assert all(place[r["id"]] // 64 == (r["position"] - 1) // 64 for r in rows)


def test_run_rows_continue(spark, corpus):
    df = spark.createDataFrame(corpus, "id bigint, source string")
    run = lambda start: S.rows_of_run(df, "id", start_step=start, steps=5, batch=2, accumulation=4)
    first, second = run(0).collect(), run(5).collect()
    assert len(first) == len(second) == 40
    assert not {r["id"] for r in first} & {r["id"] for r in second}
    assert {r["global_step"] for r in second} == {6, 7, 8, 9, 10}


def test_broadcast_only_when_small(spark):
    small = spark.range(100)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(checked_broadcast(small, 100))
    assert "ResolvedHint" not in plan(checked_broadcast(small, 99))
