"""Harmonic packing of documents into token sequences.

A class holds pieces of one reciprocal of the capacity: capacity / 1, / 2, / 4, ... down to one
token. A document is cut into full sequences and the binary parts of its rest, largest first, so
every piece lies in a class exactly, and a bin of class ``k`` is full with ``k`` pieces. Every
task fills the bins of its own classes, without a shuffle: a bin of class ``k`` is written as soon
as its ``k`` pieces are there. What is left in a task's last bins goes into sequences of 1, 2, 4,
... pieces, which are powers of two themselves, so no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import ragged_take, slices
from parley.llm.tokens import word_encoder

CAPACITY = 2_048
SEPARATOR = 1
_TASK_BITS = 40


class _Bins:
    """The open bins of one task; a piece is (id, start, doc_tokens, ids)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}
        self.next = TaskContext.get().partitionId() << _TASK_BITS

    def _sequence(self, pieces: list[tuple], size: int) -> Iterator[tuple]:
        for at, (key, start, tokens, ids) in enumerate(pieces):
            yield key, start, size, tokens, self.next, at * size, ids
        self.next += 1

    def add(self, size: int, pieces: list[tuple]) -> Iterator[tuple]:
        count = self.capacity // size
        held = self.open.setdefault(size, [])
        held += pieces
        full = len(held) - len(held) % count
        for start in range(0, full, count):
            yield from self._sequence(held[start : start + count], size)
        del held[:full]

    def rest(self) -> Iterator[tuple]:
        for size, held in self.open.items():
            while held:
                count = 1 << (len(held).bit_length() - 1)
                yield from self._sequence(held[:count], size)
                del held[:count]


def _pieces(tokens: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(piece length, rows, starts) for documents of so many tokens."""
    full = tokens // capacity
    rows = np.repeat(np.arange(len(tokens)), full)
    yield capacity, rows, ragged_take(np.zeros(len(full), np.int64), full) * capacity
    size = capacity >> 1
    while size:
        rows = np.flatnonzero(tokens & size)
        yield size, rows, tokens[rows] & ~(2 * size - 1)
        size >>= 1


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` is binary: little-endian unsigned 32-bit token ids. A document's ids end with
    ``separator``; a null text has nothing else. Start counts its ids before the piece, offset
    the ids before the piece in its sequence. Sequences are full, or hold a power of two of ids.
    ``tokenizer`` is a file of the ``tokenizers`` library that never joins text across white
    space; every executor must have it. Repeated rows are documents of their own; other columns
    are not read.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, encoder, key_type = _Bins(capacity), word_encoder(path), None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 7
            types = [key_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=schema.names
            )

        for batch in batches:
            key_type = batch.column(0).type
            for part in slices(batch, 1):
                ids, ends = encoder.encode(part.column(1))
                ends = ends + np.arange(len(ends))
                whole = np.full(ends[-1], separator, "<u4")
                whole[ragged_take(ends[:-1], np.diff(ends) - 1)] = ids
                tokens, data, keys = np.diff(ends), memoryview(whole.tobytes()), part.column(0).to_pylist()
                found = []
                for size, docs_at, starts in _pieces(tokens, capacity):
                    at = (ends[:-1][docs_at] + starts) * 4
                    pieces = [
                        (keys[d], s, n, bytes(data[a : a + 4 * size]))
                        for d, s, n, a in zip(docs_at.tolist(), starts.tolist(), tokens[docs_at].tolist(), at.tolist())
                    ]
                    found += bins.add(size, pieces)
                yield rows(found)
        if key_type is not None:
            yield rows(list(bins.rest()))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)
