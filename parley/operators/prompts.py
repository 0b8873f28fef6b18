"""Prompt tables: one assembled prompt per turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import render
from parley.functions.vectors import embed
from parley.operators.memory import recalled_texts, remember, retrieve
from parley.operators.replay import DYNAMIC, replay_states, template_profile
from parley.operators.validate import valid_profiles
from parley.plans.folds import Order
from parley.plans.sizes import checked_broadcast
from parley.session import cut_lineage

_FIELDS = [*fixed.PROFILE_REQUIRED, fixed.PROFILE_OPTIONAL]


def with_profile_prompt(states: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``profile_prompt`` of the turn's character; null for an id nobody knows."""
    stored = valid_profiles(profiles).select(
        F.col("id").alias("character_id"),
        render.profile_prompt({f: F.col(f) for f in _FIELDS}).alias("__stored"),
    )
    made = render.profile_prompt(template_profile(F.col("character_name")))
    dynamic = F.startswith(F.col("character_id"), F.lit(DYNAMIC))
    return (
        states.join(checked_broadcast(stored), "character_id", "left")
        .withColumn("profile_prompt", F.when(dynamic, made).otherwise(F.col("__stored")))
        .drop("__stored")
    )


def assemble(
    states: DataFrame,
    memories: Column | None = None,
    max_chars: int = fixed.MAX_CHARS,
    max_tokens: int | None = None,
) -> DataFrame:
    """Add ``prompt`` from the state columns; a turn with a missing part gets the minimal one."""
    none = F.lit(None).cast("array<string>")
    world = render.world_block(
        F.col("location"),
        F.col("time"),
        F.col("current_event"),
        F.col("story_progress"),
        F.array("character_name"),
        F.lit(None).cast("map<string,string>"),
    )
    whole = render.full_prompt(
        F.col("profile_prompt"),
        render.emotion_block(F.col("character_id"), F.col("emotion")),
        world,
        none if memories is None else memories,
        F.col("history"),
        F.col("user"),
    )
    tail = render.keep_tail(whole, max_chars, max_tokens)
    return states.withColumn("prompt", F.coalesce(tail, render.fallback_prompt(F.col("user"))))


def replay_prompts(
    turns: DataFrame,
    profiles: DataFrame,
    order: Order,
    seq: Column | None = None,
    initial_id: str = fixed.DEFAULT_CHARACTER,
    initial_name: str | None = None,
    max_chars: int = fixed.MAX_CHARS,
    capacity: int | None = fixed.MEMORY_CAPACITY,
) -> DataFrame:
    """All folds of a scripted conversation and one prompt per turn.

    With ``seq``, the global number of a turn over all users, memories of earlier turns are
    looked up too, the newest ``capacity`` that the store held at the turn; ``turns`` then needs
    ``user_id``.
    """
    states = with_profile_prompt(
        replay_states(turns, profiles, order, initial_id, initial_name), profiles
    )
    if seq is None:
        return assemble(states, max_chars=max_chars)
    # read three times below: once for the queries, for the memories and for the prompts
    numbered = cut_lineage(states.withColumn("seq", seq))
    queries = embed(
        numbered.where(F.col("user") != "").select(F.col("seq").alias("query_id"), "user_id", "seq", "user"),
        "user",
    )
    memory = embed(remember(numbered, F.col("seq"), F.col("seq")))
    hits = retrieve(queries, memory, capacity=capacity, earlier_only=True)
    recalled = recalled_texts(hits, memory).withColumnRenamed("query_id", "seq")
    joined = numbered.join(recalled, "seq", "left")
    return assemble(joined, F.col("memories"), max_chars).drop("seq")


def store_prompts(
    turns: DataFrame, characters: DataFrame, layout: str = "line_per_part"
) -> DataFrame:
    """Add ``prompt`` in the chat apps' form; state is the initial one there.

    ``turns`` holds ``character_id``, ``memories``, ``history`` and ``user``.
    """
    world = render.world_block(*[F.lit(v) for v in fixed.WORLD_DEFAULTS.values()])
    who = characters.select(
        F.col("id").alias("character_id"), "name", "personality", "world", "tone"
    )
    placeholder = dict(zip(("name", "personality", "world", "tone"), fixed.PLACEHOLDER_CHARACTER))
    joined = turns.join(checked_broadcast(who), "character_id", "left")
    character = {f: F.coalesce(f, F.lit(v)) for f, v in placeholder.items()}
    prompt = render.store_prompt(
        character,
        world,
        F.lit(fixed.DEFAULT_EMOTION),
        F.col("memories"),
        F.col("history"),
        F.col("user"),
        layout,
    )
    return joined.withColumn("prompt", prompt).drop(*placeholder)
