"""List records of any length: a conversation comes as block rows, each with a run of its messages.

No row and no task holds a conversation. A block is mapped inside its row; what it needs from the
blocks before it (the message that still waits for an answer, the number of turns so far) and from
the whole conversation (the last system text, the last reply) travels in one small row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.arrays import let
from parley.functions.records import one_turn, pair_up, spoken, transcript
from parley.functions.text import strip
from parley.plans.folds import Order, carry, measure, number, settle, total_before
from parley.plans.once import once

#: Messages, or turns, of a block.
BLOCK = 256


def cut_blocks(
    rows: DataFrame, key: str, by: str, item: Column, name: str = "messages", block: int = BLOCK, order: Order | None = None
) -> DataFrame:
    """(key, block, list): the rows of a key in order, ``block`` to a list; blocks count from 0."""
    order = order or measure(rows, [key], by)
    placed = number(settle(rows.select(key, by, item.alias("__item")), order), order, "__no")
    cut = placed.withColumn("block", F.floor((F.col("__no") - 1) / block))
    lists = cut.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("__no", "__item"))).alias("__rows"))
    return lists.select(key, "block", F.transform("__rows", lambda r: r["__item"]).alias(name))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _summaries(said: DataFrame, key: str) -> DataFrame:
    """Per block: the message before its first one, turns before it, and of the whole record turns, system, reply."""
    talk = F.filter("__said", lambda m: m["role"].isin(fixed.USER_ROLES + fixed.ASSISTANT_ROLES))
    replies = F.filter("__said", lambda m: m["role"].isin(fixed.ASSISTANT_ROLES))
    systems = F.filter("__said", lambda m: m["role"] == fixed.SYSTEM_ROLE)
    small = said.select(
        key,
        "block",
        _last(talk).alias("__end"),
        F.coalesce(F.get(talk, F.lit(0))["role"].isin(fixed.ASSISTANT_ROLES), F.lit(False)).alias("__answers"),
        F.size(pair_up(F.col("__said"))).alias("__inner"),
        _last(systems)["content"].alias("__system"),
        _last(replies)["content"].alias("__reply"),
    )
    order = measure(small, [key], "block")
    small = carry(settle(small, order), order, {"__open": F.col("__end")}, before=True).drop("__end")
    waits = F.coalesce(F.col("__open.role").isin(fixed.USER_ROLES), F.lit(False))
    small = small.withColumn("__open", F.when(waits & F.col("__answers"), F.col("__open")))
    small = small.withColumn("__turns", F.col("__inner") + F.col("__open").isNotNull().cast("int"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("block"))).alias(c)
    whole = small.groupBy(key).agg(
        F.sum("__turns").alias("__total"), F.min("block").alias("__first"), last("__system"), last("__reply")
    )
    placed = total_before(small, order, "__turns", "__before")
    return placed.select(key, "block", "__open", "__before").join(whole, key)


def _turns(blocks: DataFrame, key: str, said: Column, alone: bool, default_system: Column) -> DataFrame:
    said_rows = once(blocks, "__said", said)
    rows = said_rows.join(_summaries(said_rows, key), [key, "block"])
    waiting = F.when(F.col("__open").isNotNull(), F.array("__open")).otherwise(
        F.array().cast(said_rows.schema["__said"].dataType)
    )
    turns = let(F.concat(waiting, "__said"), pair_up)
    if alone:  # without any pair the last reply stands by itself, once for the record
        single = one_turn(F.lit(""), F.coalesce("__reply", F.lit("")))
        none = (F.col("__total") == 0) & (F.col("block") == F.col("__first"))
        turns = F.when(none, single).otherwise(turns)
    return rows.select(
        key,
        F.coalesce("__system", default_system).alias("system"),
        "__before",
        F.posexplode(turns).alias("__at", "__t"),
    ).select(key, (F.col("__before") + F.col("__at")).cast("int").alias("place"), "system", "__t.user", "__t.assistant")


def message_turns(
    blocks: DataFrame, key: str, messages: str = "messages", default_system: str | Column = fixed.CHAT_SYSTEM
) -> DataFrame:
    """(key, place, system, user, assistant) of ``messages`` lists in blocks; blank messages do not count.

    The same turns as ``map_chat_record`` makes of whole lists: the last system text holds for the
    record, and a record without any pair is its last reply behind an empty user text.
    """
    said = F.filter(
        spoken(F.col(messages), ["role", "from"], ["content", "value", "text"]), lambda m: strip(m["content"]) != ""
    )
    default = F.lit(default_system) if isinstance(default_system, str) else default_system
    return _turns(blocks, key, said, True, default)


def conversation_turns(
    blocks: DataFrame, key: str, conversations: str = "conversations", default_system: str | Column = fixed.CHAT_SYSTEM
) -> DataFrame:
    """(key, place, system, user, assistant) of ``conversations`` lists in blocks; blank messages count."""
    said = spoken(F.col(conversations), ["from", "role"], ["value", "content"])
    default = F.lit(default_system) if isinstance(default_system, str) else default_system
    return _turns(blocks, key, said, False, default)


def transcript_parts(blocks: DataFrame, key: str, conversations: str = "conversations") -> DataFrame:
    """(key, part, text): one part of the transcript per block; the parts joined by newlines are the whole."""
    return blocks.select(key, F.col("block").alias("part"), transcript(F.col(conversations)).alias("text"))


def joined_parts(parts: DataFrame, key: str, between: str) -> DataFrame:
    """(key, text): the parts (key, part, text) of every key in order as one text; empty ones count for nothing."""
    told = F.filter(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"] != "")
    whole = F.array_join(F.transform(told, lambda p: p["text"]), between)
    return parts.groupBy(key).agg(whole.alias("text"))
