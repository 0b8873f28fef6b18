"""Queries over a table in which one conversation holds thousands of messages."""

import os
import random

import compare
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
#: Queries that fold, pair or gather conversations.
NAMES = [
    "pair_turns", "sft_split_counts", "sft_triples", "map_message_lists", "map_conversation_lists",
    "transcripts", "transcript_lists", "chat_texts", "validated_rows", "preference_rows", "drop_blank_turns",
    "state_after_turn", "state_before_turn", "emotion_carry", "world_carry", "history_windows", "recent_pairs",
    "persona_usage", "personas_to_save", "switch_prompts", "turn_prompts", "memory_capacity", "store_prompts",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, their conversations with one of 5,000 messages."""
    out = tmp_path_factory.mktemp("long")
    for name in os.listdir(SMALL):
        if name != "conversations.parquet":
            os.symlink(f"{SMALL}/{name}", out / name)
    rng = random.Random(1)
    words = ["re", "on", "the", "ing", "er"]
    rows = [(1_000_003, i, ("user", "assistant")[i % 2], " ".join(rng.choices(words, k=7))) for i in range(5_000)]
    given = spark.read.parquet(f"{SMALL}/conversations.parquet")
    long = spark.createDataFrame(rows, given.schema)
    given.unionByName(long).coalesce(1).write.parquet(str(out / "conversations.parquet"))
    return str(out)


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder, "/*.parquet")


@pytest.mark.parametrize("name", NAMES)
def test_long_conversation(spark, con, folder, name):
    assert compare.difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], folder) is None
