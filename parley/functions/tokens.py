"""Token columns. Any ``Column -> ARRAY<INT>`` function can replace the built-in tokenizer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.text import WORD
from parley.plans.once import once

VOCABULARY = 32_000
Tokenizer = Callable[[Column, int], Column]


def word_pieces(text: Column) -> Column:
    """Words and single marks, in order."""
    return F.regexp_extract_all(text, F.lit(rf"[{WORD}]+|[^{WORD}\s]"), F.lit(0))


def hashed_pieces(text: Column, limit: int = fixed.MAX_TOKENS, vocabulary: int = VOCABULARY) -> Column:
    """Ids of the first ``limit`` pieces: leading md5 digits modulo the vocabulary size."""
    return F.transform(
        F.slice(word_pieces(text), 1, limit),
        lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("int") % vocabulary),
    )


def tokenize(
    df: DataFrame, text: str = "text", limit: int = fixed.MAX_TOKENS, tokenizer: Tokenizer = hashed_pieces
) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``; rows without tokens are dropped."""
    return (
        once(df, "input_ids", tokenizer(F.col(text), limit))
        .where(F.size("input_ids") > 0)
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    )


def pad(df: DataFrame, length: int = fixed.MAX_TOKENS, pad_id: int = 0) -> DataFrame:
    """Pad ids and mask to ``length`` and copy the ids to ``labels``."""
    fill = lambda value: F.array_repeat(F.lit(value), F.lit(length) - F.size("input_ids"))
    padded = df.withColumns(
        {
            "attention_mask": F.concat("attention_mask", fill(0)),
            "input_ids": F.concat("input_ids", fill(pad_id)),
        }
    )
    return padded.withColumn("labels", F.col("input_ids"))
