"""Message tables -> user / assistant turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.text import strip
from parley.plans.folds import Order, carry, last_rows, measure, number, settle


def pair_messages(
    messages: DataFrame,
    key: str = "conv_id",
    by: str = "turn",
    *,
    text: str = "text",
    keep_blank: bool = False,
    order: Order | None = None,
) -> DataFrame:
    """One row per answered user message: key, order, ``user``, ``assistant``, ``user_<by>``.

    Other roles, and blank texts unless kept, are dropped first; an assistant row then pairs
    with the row before it if that one is the user's.
    """
    order = order or measure(messages, [key], by)
    role = F.lower("role")
    is_user, is_reply = role.isin(fixed.USER_ROLES), role.isin(fixed.ASSISTANT_ROLES)
    talk = messages.where(is_user | is_reply)
    if not keep_blank:
        talk = talk.where(strip(F.col(text)) != "")
    asked = F.struct(
        is_user.alias("by_user"), F.col(text).alias("user"), F.col(by).alias("turn")
    )
    seen = carry(settle(talk, order), order, {"__prev": asked}, before=True)
    extra = [c for c in messages.columns if c not in (key, by, "role", text)]
    return seen.where(is_reply & F.col("__prev.by_user")).select(
        key,
        *extra,
        by,
        F.col("__prev.turn").alias(f"user_{by}"),
        F.col("__prev.user").alias("user"),
        F.col(text).alias("assistant"),
    )


def number_pairs(pairs: DataFrame, order: Order, name: str = "pair_no") -> DataFrame:
    """Turn number among the pairs of a conversation, from 1."""
    return number(pairs, order, name)


def last_pairs(pairs: DataFrame, key: str, by: str, n: int = fixed.MAX_TURNS) -> DataFrame:
    """The last ``n`` pairs of every conversation."""
    return last_rows(pairs, [key], [F.desc(by)], n, "__rn").drop("__rn")


def gather_turns(pairs: DataFrame, key: str, by: str, n: int = fixed.MAX_TURNS) -> DataFrame:
    """(key, turns): the last ``n`` pairs of a conversation as one array, oldest first."""
    rows = last_pairs(pairs, key, by, n).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(by, "user", "assistant"))).alias("__rows")
    )
    return rows.select(
        key, F.transform("__rows", lambda r: F.struct(r["user"], r["assistant"])).alias("turns")
    )


def last_system(messages: DataFrame, key: str, by: str, text: str = "text") -> DataFrame:
    """(key, system): the last system message that is not blank."""
    return (
        messages.where((F.lower("role") == fixed.SYSTEM_ROLE) & (strip(F.col(text)) != ""))
        .groupBy(key)
        .agg(F.max_by(text, by).alias("system"))
    )


def transcripts(
    messages: DataFrame,
    key: str,
    by: str,
    line: Column,
    lines_per_row: int = 1_000,
) -> DataFrame:
    """(key, part, text): lines of a conversation in order, newline-joined.

    A conversation longer than ``lines_per_row`` messages goes on in the next part, so a row,
    and the task that builds it, stays small whatever the conversation holds.
    """
    cut = messages.select(
        key, F.floor(F.col(by) / lines_per_row).alias("part"), F.col(by), line.alias("__line")
    ).where(F.col("__line").isNotNull())
    rows = cut.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct(by, "__line"))).alias("__rows")
    )
    joined = F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n")
    return rows.select(key, "part", strip(joined).alias("text"))
