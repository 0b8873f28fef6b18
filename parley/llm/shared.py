"""Helpers of the operators: tables written between steps, and texts taken apart in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import working_folder

#: Bytes of text that a Python step takes in hand at once; one longer text is a slice of its own.
SLICE_BYTES = 8 << 20
ROW_KEY = "__row_key"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends here.

    A lost executor then costs a re-read, and two readers of the rows see the same ones.
    """
    folder = working_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def any_row(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def repeats(df: DataFrame, key: str) -> bool:
    """Whether some value of the key stands in more than one row."""
    return any_row(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))


def with_row_key(df: DataFrame, rank: Column, key: Column) -> DataFrame:
    """The rows, written once, with a struct that no two share: ordered by ``rank``, then ``key``, then place."""
    own = F.struct(rank.alias("rank"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    return settled(df.withColumn(ROW_KEY, own), "keyed")


def first_of(keys: list[str]) -> Column:
    """True for one row of each group of repeated keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) == 1


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space: the distinct ones, their number at each place, the row ends.

    Empty strings may be among them; a null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    steps = np.repeat(starts - (ends - lengths), lengths)
    return steps + np.arange(ends[-1])


def ragged_join(sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of given sizes laid end to end: positions that spell ``codes``, and each code's run length."""
    starts, lengths = np.cumsum(sizes) - sizes, sizes[codes]
    return ragged_take(starts[codes], lengths), lengths


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of letters in lower case: the distinct ones, their number at each place, the row ends."""
    words, codes, ends = words_of(texts)
    bare = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL]+", " ")
    terms, inner, inner_ends = words_of(bare)
    filled = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64) > 0
    keep = filled[inner] if len(inner) else np.empty(0, bool)
    sizes = np.diff(np.append(0, np.cumsum(keep))[inner_ends])
    places, lengths = ragged_join(sizes, codes)
    return terms, inner[keep][places], np.append(0, np.cumsum(lengths))[ends]


# -- hot keys -------------------------------------------------------------------------------------

SALTS = 64


def salt_of(by: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(salts))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: Column, salts: int = SALTS) -> DataFrame:
    """Inner join with a table of few rows per key, for rows of which many may share a key.

    ``by`` differs among the rows of a key and salts them. Only the (key, salt) pairs that occur meet
    the table; then rows and pairs meet by key and salt. No null among the keys.
    """
    salted = rows.withColumn("__salt", salt_of(by, salts))
    pairs = salted.select(*keys, "__salt").distinct().join(table, keys)
    return salted.join(pairs, [*keys, "__salt"]).drop("__salt")


def spread_min(rows: DataFrame, keys: list[str], value: str, name: str, by: Column, salts: int = SALTS) -> DataFrame:
    """Rows with the smallest ``value`` of their key as ``name``, combined and sent back by salt."""
    salted = rows.withColumn("__salt", salt_of(by, salts))
    parts = salted.groupBy(*keys, "__salt").agg(F.min(value).alias("__least"))
    least = parts.groupBy(*keys).agg(F.min("__least").alias(name))
    pairs = parts.select(*keys, "__salt").join(least, keys)
    return salted.join(pairs, [*keys, "__salt"]).drop("__salt")
