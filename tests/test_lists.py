"""Block list records against whole lists, and the list queries with one very long conversation."""

import os
import random

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parley.functions import records as R
from parley.operators import lists
from parley.plans import folds

SMALL = "/root/testdata/sf0.001"
FIELDS = ("role", "from", "content", "value", "text")


def message(rng):
    role = rng.choice(["user", "human", "USER", "assistant", "gpt", "system", "tool", "", None])
    text = rng.choice(["", " ", None, "a", "b c", "d"])
    one, two = rng.choice([("role", "content"), ("from", "value"), ("role", "text")])
    return tuple({one: role, two: text}.get(f) for f in FIELDS)


@pytest.fixture(scope="module", params=[(1, None), (3, None), (3, 2), (256, None)])
def records(request, spark):
    """(whole lists, the same lists in blocks); with a second number, folds over so many blocks go by cells."""
    block, cell = request.param
    rng = random.Random(block)
    rows = [(k, [message(rng) for _ in range(rng.randrange(1, 14))]) for k in range(150)]
    whole = spark.createDataFrame(rows, _schema())
    parts = [(k, b // block, some[b : b + block]) for k, some in rows for b in range(0, len(some), block)]
    cut = spark.createDataFrame(parts, _schema("block bigint, "))
    if cell:
        patch = pytest.MonkeyPatch()
        patch.setattr(lists, "measure", lambda df, keys, by: folds.Order(tuple(keys), by, cell, cell))
        request.addfinalizer(patch.undo)
    return whole, cut


def _schema(more=""):
    item = ", ".join(f"`{f}`: string" for f in FIELDS)
    return f"id bigint, {more}messages array<struct<{item}>>"


def test_message_blocks(records):
    whole, cut = records
    mapped = R.map_chat_record(whole).select("id", "system", F.posexplode("turns").alias("place", "t"))
    want = mapped.select("id", "place", "system", "t.user", "t.assistant").collect()
    assert sorted(lists.message_turns(cut, "id").collect(), key=str) == sorted(want, key=str)


def test_conversation_blocks(records):
    whole, cut = records
    turns = R.conversation_turns(F.col("messages"))
    want = whole.select("id", F.posexplode(turns).alias("place", "t")).select("id", "place", "t.user", "t.assistant").collect()
    got = lists.conversation_turns(cut, "id", "messages").drop("system").collect()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_cut_blocks(spark):
    rows = [(k, t, f"{k}-{t}") for k in (1, 2) for t in random.Random(k).sample(range(10**6), 25)]
    frame = spark.createDataFrame(rows, "k bigint, t bigint, said string")
    for order in (None, folds.Order(("k",), "t", 10_000, 25)):
        got = {(r["k"], r["block"]): r["messages"] for r in lists.cut_blocks(frame, "k", "t", F.col("said"), block=4, order=order).collect()}
        assert sorted(got) == [(k, b) for k in (1, 2) for b in range(7)] and max(map(len, got.values())) == 4
        for k in (1, 2):
            assert [x for b in range(7) for x in got[k, b]] == [s for _, _, s in sorted(r for r in rows if r[0] == k)]


def test_total_before(spark):
    rows = [(k, t, (k * t) % 5) for k in (1, 2, 3) for t in range(40)]
    frame = spark.createDataFrame(rows, "k bigint, t bigint, v bigint")
    for block in (None, 7):
        got = folds.total_before(frame, folds.Order(("k",), "t", block, 40), "v", "sum").collect()
        assert {(r["k"], r["t"]): r["sum"] for r in got} == {
            (k, t): sum(v for kk, tt, v in rows if kk == k and tt < t) for k, t, _ in rows
        }


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, their conversations with one of 100,000 messages."""
    out = tmp_path_factory.mktemp("lists")
    for name in os.listdir(SMALL):
        if name != "conversations.parquet":
            os.symlink(f"{SMALL}/{name}", out / name)
    n = F.col("id")
    role = F.when(n == 7, "system").when(n % 2 == 0, "user").otherwise("assistant")
    long = spark.range(100_000).select(
        F.lit(1_000_003).cast("bigint").alias("conv_id"), n.alias("turn"), role.alias("role"), F.concat(F.lit("said "), n.cast("string")).alias("text")
    )
    given = spark.read.parquet(f"{SMALL}/conversations.parquet")
    given.unionByName(long).write.parquet(str(out / "conversations.parquet"))
    return str(out)


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder, "/*.parquet")


@pytest.mark.parametrize("name", ["map_message_lists", "map_conversation_lists", "transcript_lists", "chat_texts"])
def test_hot_conversation(spark, con, folder, name):
    assert compare.difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], folder) is None


def test_no_list_is_longer_than_a_block(spark, folder):
    from parley.catalog.records import _message_blocks

    assert _message_blocks(spark, folder, "role", "content", "messages").agg(F.max(F.size("messages"))).first()[0] == lists.BLOCK


def test_whole_transcripts(spark, folder):
    """A conversation is one row, however many blocks it has."""
    rows = entry.queries()["transcript_lists"](spark, folder)
    assert rows.columns == ["conv_id", "text"]
    long = rows.where("conv_id = 1000003").collect()
    speaker = lambda n: "System" if n == 7 else "Assistant" if n % 2 else "User"
    assert [r["text"] for r in long] == ["\n".join(f"{speaker(n)}: said {n}" for n in range(100_000))]


def test_joined_parts(spark):
    rows = [(1, p, t) for p, t in random.Random(1).sample([(p, "" if p % 5 == 3 else f"t{p}") for p in range(30)], 30)]
    parts = spark.createDataFrame([*rows, (2, 0, ""), (2, 1, "")], "id bigint, part bigint, text string")
    got = {r["id"]: r["text"] for r in lists.joined_parts(parts, "id", "\n").collect()}
    assert got == {1: "\n".join(f"t{p}" for p in range(30) if p % 5 != 3), 2: ""}


def test_whole_chat_texts(spark, folder):
    """A conversation is one row with one system block, however many blocks of turns it has."""
    rows = entry.queries()["chat_texts"](spark, folder)
    assert rows.columns == ["conv_id", "text"]
    (long,) = rows.where("conv_id = 1000003").collect()
    assert long["text"].count("<|system|>") == 1 and long["text"].startswith("<|system|>\n")
    assert long["text"].count("<|assistant|>") == 49_999 and long["text"].count("<|user|>") == 49_999


def test_chat_text_of_no_filled_turn(spark, tmp_path):
    """Turns that normalize to nothing make no text, as in the SQL."""
    rows = [(1, 0, "user", "###"), (1, 1, "assistant", "***"), (2, 0, "user", "ask"), (2, 1, "assistant", "said")]
    frame = spark.createDataFrame(rows, spark.read.parquet(f"{SMALL}/conversations.parquet").schema)
    # numbers that get no cue prefix
    frame.select((F.col("conv_id") * 8).alias("conv_id"), (F.col("turn") * 8).alias("turn"), "role", "text").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    got = entry.queries()["chat_texts"](spark, str(tmp_path)).collect()
    assert [r["conv_id"] for r in got] == [16] and got[0]["text"].endswith("<|user|>\nask\n<|assistant|>\nsaid\n")
