"""The physical plans we want, on the smallest tables."""

import re

import pytest

from parley.catalog import QUERIES
from parley.catalog.base import table
from parley.operators import sampling, store

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    """Physical plan text, without the plans of kept small tables."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(line for line in text.split("\n") if "InMemoryRelation" not in line)


def exchanges(df):
    return re.findall(r"Exchange (\w+)\(([^#(]*)", plan(df))


@pytest.mark.parametrize("name", ["recent_messages", "top_memories"])
def test_top_n_per_group_is_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_pairing_shuffles_once(spark):
    assert exchanges(QUERIES["pair_turns"](spark, FOLDER)) == [("hashpartitioning", "conv_id")]


@pytest.mark.parametrize("name", ["state_before_turn", "state_after_turn", "turn_prompts"])
def test_a_whole_replay_shuffles_twice(spark, name):
    """Once to pair the messages and once for all the folds."""
    found = [e for e in exchanges(QUERIES[name](spark, FOLDER)) if e[0] == "hashpartitioning"]
    assert [key.split("#")[0] for _, key in found] == ["conv_id", "conv_id"]


def test_split_and_cap_do_not_move_rows(spark):
    docs = table(spark, FOLDER, "documents")
    assert exchanges(sampling.split_rows(docs, 0.1, "doc_id")) == []
    capped = plan(sampling.cap_sources(docs, "source", "doc_id", rows=3))
    assert "BroadcastHashJoin" in capped and "SortMergeJoin" not in capped
    assert exchanges(sampling.route_stages(docs, "source", {"src0": ["a", "b"]})) == []


def test_upsert_and_delete_do_not_move_the_base(spark):
    for name in ("upsert_rows", "delete_rows", "cascade_delete"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["find_row"](spark, FOLDER))
    assert "EqualTo(o_orderkey,77)" in text
    text = plan(QUERIES["column_pruning"](spark, FOLDER))
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in text
    newest = plan(store.find(table(spark, FOLDER, "documents").select("doc_id"), "doc_id", 1))
    assert "ReadSchema: struct<doc_id:bigint>" in newest


def test_texts_without_special_characters_stay_in_the_jvm(spark):
    """Only texts that need it are handed to Python: the others arrive there as null."""
    text = QUERIES["normalize_basic"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_nfkc\(CASE WHEN ", text)
