"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms. The score adds a weight per term and, for every pair of
its terms, the product of their latent vectors, so an insult beside a mention of a group can
count for more than both. The model is trained on a bounded sample of labelled rows; every term
of that sample has a weight and a vector, because a term may tell only beside another; a term that
tells little by itself, or is rare, moves by smaller steps. Every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import slices, terms_of

BUCKETS = 1 << 24
#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
FACTORS = 8
#: Terms in fewer rows, or with a smaller score of their own, begin with damped steps.
_LEAST_ROWS, _LEAST_Z = 5, 4.0
_DAMPED = 0.1


@dataclass(frozen=True)
class Machine:
    buckets: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: np.ndarray, buckets: np.ndarray, count: int) -> np.ndarray:
        """Probabilities for ``count`` rows from distinct (row, bucket) pairs; unknown buckets are passed over."""
        at = np.searchsorted(self.buckets, buckets)
        known = at < len(self.buckets)
        known[known] = self.buckets[at[known]] == buckets[known]
        return _sigmoid(self.margins(rows[known], at[known], count))

    def margins(self, rows: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        out = self.bias + np.bincount(rows, self.weights[at], count)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(rows, v, count) ** 2 - np.bincount(rows, v * v, count))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def hashed_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of the texts."""
    terms, codes, ends = terms_of(texts)
    hashed = np.fromiter((zlib.crc32(t.encode()) % BUCKETS for t in terms.to_pylist()), np.int64, len(terms))
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    pairs = np.unique(rows * BUCKETS + hashed[codes] if len(codes) else np.empty(0, np.int64))
    return pairs // BUCKETS, pairs % BUCKETS


def _alone(at: np.ndarray, hits: np.ndarray, count: int, p: float) -> np.ndarray:
    """Where a term tells by itself: its share of positive rows differs from the whole's, by the normal score."""
    seen = np.bincount(at, minlength=count)
    z = np.abs(np.bincount(at, hits, count) - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p), 1e-9))
    return (seen >= _LEAST_ROWS) & (z >= _LEAST_Z)


def fit(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, epochs: int = 30, seed: int = 7) -> Machine:
    """Logistic loss, L2, adaptive steps, small batches. No rows, or one class only: a constant score.

    All buckets take part. Batches are put together once and come in another order every epoch; one
    moves the parameters of its own terms only, so its cost does not depend on how many there are.
    """
    p = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.0
    bias = float(np.log(p / (1 - p))) if 0 < p < 1 else -5.0
    if not len(labels) or labels.min() == labels.max():
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, FACTORS)))
    kept, at = np.unique(buckets, return_inverse=True)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept), np.float32), rng.normal(0, 0.01, (len(kept), FACTORS)).astype(np.float32)
    alone = _alone(at, labels[rows], len(kept), labels.mean())
    gw = np.where(alone, 1e-8, _DAMPED).astype(np.float32)
    gv, gb = np.repeat(gw[:, None], FACTORS, 1), 1e-8
    batches = _batches(rows, at.astype(np.int32), rng.permutation(len(labels)))
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            batch, inside, own, terms, by_term, ends = batches[i]
            mine, vectors = w[own], v[own]
            starts = np.flatnonzero(np.diff(inside, prepend=-1))
            there, beside = inside[starts], vectors[terms]
            sums, squares = np.zeros((2, len(batch), FACTORS), np.float32)
            if len(terms):
                sums[there] = np.add.reduceat(beside, starts, 0)
                squares[there] = np.add.reduceat(beside * beside, starts, 0)
            margin = bias + np.bincount(inside, mine[terms], len(batch)) + 0.5 * (sums**2 - squares).sum(1)
            loss = ((_sigmoid(margin) - labels[batch]) / len(batch)).astype(np.float32)
            if len(terms):
                rows_by_term = inside[by_term]
                dw = np.add.reduceat(loss[rows_by_term], ends)
                dv = np.add.reduceat((loss[:, None] * sums)[rows_by_term], ends, 0) - dw[:, None] * vectors
                dw, dv = dw + 1e-4 * mine, dv + 1e-3 * vectors
                gw[own] += dw**2
                gv[own] += dv**2
                w[own] = mine - 0.3 * dw / np.sqrt(gw[own])
                v[own] = vectors - 0.05 * dv / np.sqrt(gv[own])
            gb += float(loss.sum()) ** 2
            bias -= 0.1 * float(loss.sum()) / gb**0.5
    return Machine(kept, bias, w, v)


def _batches(rows: np.ndarray, at: np.ndarray, order: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per batch: its rows, and for its pairs the place of the row, the terms, and the pairs by term."""
    start, found = np.searchsorted(rows, np.arange(len(order) + 1)), []
    for batch in np.array_split(order, max(1, len(order) // 256)):
        inside = np.repeat(np.arange(len(batch), dtype=np.int16), start[batch + 1] - start[batch])
        pairs = [at[start[b] : start[b + 1]] for b in batch]
        own, terms = np.unique(np.concatenate(pairs), return_inverse=True)
        by_term = np.argsort(terms, kind="stable").astype(np.int32)
        starts = np.searchsorted(terms[by_term], np.arange(len(own)))
        found.append((batch, inside, own, terms.astype(np.int32), by_term, starts))
    return found


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their ids."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id")  # at most ``sample`` narrow rows
        .select("text", "label")
        .mapInArrow(_bucket_lists, "label double, buckets array<int>")
        .limit(sample)
        .toArrow()
    )
    lists = rows.column("buckets").combine_chunks()
    flat, ends = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()
    return fit(np.repeat(np.arange(len(lists)), np.diff(ends)), flat, rows.column("label").to_numpy())


def _bucket_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0):
            rows, buckets = hashed_terms(part.column(0))
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(1), lists], ["label", "buckets"])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row; a null, empty or wordless text gets the model's constant. Rows may repeat."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = machine.scores(*hashed_terms(part.column(1)), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], [id_col, "score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType())]))


def held_out(key: Column) -> Column:
    """One row in five, by the id alone; a null id is not held out (and has no label to learn from)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted. Held-out labels are never read."""
    machine = train(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col, label, sample)
    return score(docs, machine, id_col, text_col).select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
