"""Multi-party chat: every participant's view of a dialogue, rendered with loss masks.

For each participant the same dialogue is rendered once: that speaker's turns as the assistant's,
those of all others as a named user's, shared turns (system) as they are. The mask covers the
assistant's contents with their end mark. Only DataFrame functions are used.

A dialogue is rendered in parts of ``PART`` turns, whatever its length and its numbers, so no task
ever holds a whole dialogue. All turns are placed by one range-partitioned sort of the table, which
splits a dialogue like any other run of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import spread_join, spread_min
from parley.plans.ranks import number_rows

PART = 256
SHARED = "system"
UNKNOWN = "unknown"
# Fixed marks of the chat format.
START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    """A text cannot hold a mark of the format."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def perspectives(
    messages: DataFrame,
    chat_col: str = "conv_id",
    order_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    *,
    shared: str = SHARED,
    part: int = PART,
) -> DataFrame:
    """(chat, speaker, part, turns, text, mask) for every speaker but the shared one, and every part.

    ``mask`` is an array of (start, end) in code points of ``text``, end exclusive: the contents
    to learn. Turns stand in order of their number, ties in order of speaker and text, ``part`` of them
    in a part. A null
    text is empty, a null speaker is ``unknown``, a null number comes before all others; rows
    without a chat id belong to no dialogue and are left out, and so are dialogues in which only
    the shared speaker speaks. Repeated rows are turns of their own.
    """
    lines = messages.where(F.col(chat_col).isNotNull()).select(
        F.col(chat_col).alias("chat"),
        F.coalesce(F.col(order_col).cast("bigint"), F.lit(-1)).alias("at"),
        _safe(F.coalesce(F.col(speaker_col).cast("string"), F.lit(UNKNOWN))).alias("who"),
        _safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("said"),
    )
    # equal turns may trade places, but not all of them meet in one range
    order = [F.col(c) for c in ("chat", "at", "who", "said", "tie")]
    placed = number_rows(lines.withColumn("tie", F.monotonically_increasing_id()), order, "place").drop("at", "tie")
    cut = spread_min(placed, ["chat"], "place", "first", F.col("place"))
    parts = (
        cut.withColumn("part", F.floor((F.col("place") - F.col("first")) / part))
        .groupBy("chat", "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "who", "said"))).alias("lines"))
    )
    speakers = lines.where(F.col("who") != shared).select("chat", F.col("who").alias("speaker")).distinct()

    def segment(line: Column) -> Column:
        own = line["who"] == F.col("speaker")
        head = (
            F.when(own, F.lit("assistant\n"))
            .when(line["who"] == shared, F.lit("system\n"))
            .otherwise(F.concat(F.lit("user name="), line["who"], F.lit("\n")))
        )
        return F.struct(
            own.alias("own"),
            F.concat(F.lit(START), head).alias("head"),
            F.concat(line["said"], F.lit(END)).alias("body"),
        )

    def place(so_far: Column, seg: Column) -> Column:
        start = so_far["at"] + F.length(seg["head"])
        end = start + F.length(seg["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(seg["own"], F.concat(so_far["mask"], span)).otherwise(so_far["mask"]).alias("mask")
        )

    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("mask"))
    return (
        spread_join(parts, speakers, ["chat"], F.col("part"))
        .withColumn("segments", F.transform("lines", segment))
        .select(
            F.col("chat").alias(chat_col),
            "speaker",
            "part",
            F.size("segments").alias("turns"),
            F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
            F.aggregate("segments", start, place, lambda x: x["mask"]).alias("mask"),
        )
    )


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
