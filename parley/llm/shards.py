"""Shards by jump consistent hashing: no ring, no table, and a further shard takes rows only into itself.

The published jump is a walk over buckets b0 < b1 < ...; the shard among n is the last one below
n. The walk does not depend on n, so one walk gives the shard for n and for n + 1 shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published hash: 64-bit linear congruential generator, 31 bits per draw.
MULTIPLIER = 2862933555777941757
DRAW = float(1 << 31)

_LOW = 0xFFFFFFFF
#: Rows of one shard that are numbered together in one task.
CELL_ROWS = 10_000


def _times(a: Column, factor: int) -> tuple[Column, Column]:
    """A 32-bit number times a 32-bit factor as (low 32 bits, rest), without leaving 63 bits."""
    small, large = a * F.lit(factor & 0xFFFF), a * F.lit(factor >> 16)
    low = small + F.shiftleft(large.bitwiseAND(F.lit(0xFFFF)), 16)
    return low.bitwiseAND(F.lit(_LOW)), F.shiftright(low, 32) + F.shiftright(large, 16)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64, the key held in two halves (products wrap nowhere)."""
    product, carry = _times(low, MULTIPLIER & _LOW)
    plus = product + F.lit(1)
    crossed, _ = _times(high, MULTIPLIER & _LOW)
    upper, _ = _times(low, MULTIPLIER >> 32)
    over = carry + F.shiftright(plus, 32) + crossed + upper
    return over.bitwiseAND(F.lit(_LOW)), plus.bitwiseAND(F.lit(_LOW))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown`` among one more, from a 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def walk(at: Column, _: Column) -> Column:
        high, low = _step(at["high"], at["low"])
        goes = at["next"] <= F.lit(shards)
        reached = at["next"]
        draw = F.lit(DRAW) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        return F.when(
            goes,
            F.struct(
                high.alias("high"),
                low.alias("low"),
                F.floor((reached + F.lit(1)).cast("double") * draw).alias("next"),
                F.when(reached < shards, reached).otherwise(at["shard"]).alias("shard"),
                reached.alias("grown"),
            ),
        ).otherwise(at)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_LOW)).alias("low"),
        F.lit(0).cast("bigint").alias("next"),
        F.lit(0).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("grown"),
    )
    # a bucket number grows by at least one a step, so this many steps always suffice
    steps = F.sequence(F.lit(0), F.lit(shards))
    return F.aggregate(steps, start, walk, lambda at: F.struct(at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown")))


def shard_rows(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, grown_shard, slot (gapless from 0 in a shard).

    The key is the id alone, hashed; null ids share one key. Size is the text's UTF-8 bytes
    (null: none) plus 16; the checksum of a null text is that of an empty one. Slots run through
    cells of a shard's ids: ids alone are counted first, then each cell is numbered in its own
    task, however many rows a shard has. Other columns are not read.
    """
    key = F.xxhash64(F.col(id_col))
    cells = max(1, math.ceil(docs.count() / (shards * cell_rows)))
    placed = docs.withColumn("__jump", jump_shards(key, shards)).select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.col("__jump.shard").alias("shard"),
        F.col("__jump.grown").alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("cell"), F.col(id_col)), F.lit(cells)).alias("cell"),
    )
    before = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("rows"))
        .select(
            "shard",
            "cell",
            F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")).alias("upto"),
            "rows",
        )
        .select("shard", "cell", (F.col("upto") - F.col("rows")).alias("before"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = placed.select(
        "id",
        (F.octet_length(text).cast("bigint") + F.lit(16)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard",
        "grown_shard",
        "cell",
    )
    inside = Window.partitionBy("shard", "cell").orderBy("id", "size", "text_crc32")
    return (
        rows.join(before, ["shard", "cell"])
        .withColumn("slot", F.col("before") + F.row_number().over(inside) - 1)
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "grown_shard", "slot")
    )
