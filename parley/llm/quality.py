"""Quality: a weak-label model over overlapping heuristic labellers, and a hashed linear scorer.

Every labeller votes low, fine or nothing on a text. How often each vote combination occurs is
counted over all documents; expectation-maximisation on that small table estimates, per labeller,
how it votes on low and on fine texts, without any true label. The posteriors of a bounded sample
of documents then train a linear scorer over hashed word shapes, which scores every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import slices, words_of

LABELLERS = ("symbols", "shouting", "echoes", "variety", "cells", "word_length", "marks")
NOTHING, FINE, LOW = 0, 1, 2
#: Words below which a share is weak evidence: no labeller says fine, and only some say low.
FEW_WORDS = 5
#: Labellers that may say low on few words, and the words added to the text's length for it.
ON_FEW, DAMP_FEW = ("symbols", "shouting", "echoes", "cells"), 8
BUCKETS = 1 << 16
#: P(fine) of a text on which no labeller votes: in doubt it stays.
IN_DOUBT = 0.9
#: Words added to a text's length when shares are taken, so a few words are weak evidence.
DAMP = 20
#: Most documents that the scorer is fitted on.
SAMPLE = 20_000


def _shapes(words: pa.Array) -> pa.Array:
    """Lower-case runs as a, upper-case runs as A, digit runs as 0, runs of one mark as two of it."""
    out = words
    for pattern, to in ((r"\p{Ll}+|\p{Lo}+", "a"), (r"\p{Lu}{2,}", "AA"), (r"\p{Lu}", "A"), (r"[0-9]+", "0")):
        out = pc.replace_substring_regex(out, pattern, to)
    for mark in "*%$#&!?.,-_=|":
        out = pc.replace_substring_regex(out, f"[{mark}]{{3,}}" if mark != "-" else r"\-{3,}", mark * 2)
    return out


class Words:
    """Words of some texts: distinct ones, codes, row of each, and sums per row."""

    def __init__(self, texts: pa.Array):
        words, codes, ends = words_of(texts)
        filled = (pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) > 0)[codes]
        rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.words, self.codes, self.rows = words, codes[filled], rows[filled]
        self.count = len(texts)
        self.total = np.bincount(self.rows, minlength=self.count)

    def share(self, of_word: np.ndarray) -> np.ndarray:
        """Per row the mean over its words of a value of the distinct word."""
        return np.bincount(self.rows, of_word[self.codes], self.count) / np.maximum(self.total, 1)

    def echo(self) -> np.ndarray:
        """Whether a word repeats the one before it in its row."""
        same = np.zeros(len(self.codes), bool)
        same[1:] = (self.codes[1:] == self.codes[:-1]) & (self.rows[1:] == self.rows[:-1])
        return same


def _number(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64)


def votes(texts: pa.Array) -> np.ndarray:
    """Votes of all labellers, a row for each text."""
    words = Words(texts)
    w = words.words
    size = _number(pc.utf8_length(w))
    plain = _number(pc.utf8_length(pc.replace_substring_regex(w, r"[^\pL\pN]+", "")))
    upper = _number(pc.and_(pc.utf8_is_upper(w), pc.greater(pc.utf8_length(w), 1)))
    marks = _number(pc.match_substring_regex(w, r"[^\pL\pN\s]{2,}$"))
    echo = np.bincount(words.rows, words.echo(), words.count) / np.maximum(words.total, 1)
    pairs = np.unique(words.rows * max(1, len(w)) + words.codes)
    variety = np.bincount(pairs // max(1, len(w)), minlength=words.count) / np.maximum(words.total, 1)
    # a long text repeats common words: the share expected falls with the logarithm of the length
    variety = variety + 0.05 * np.log2(np.maximum(words.total, 128) / 128)
    length = words.share(size)
    symbols = 1 - words.share(plain) / np.maximum(length, 1e-9)
    measured = [  # value, fine up to, low from
        (symbols, 0.06, 0.12),
        (words.share(upper), 0.05, 0.25),
        (echo, 0.04, 0.12),
        (-variety, -0.62, -0.45),
        (words.share((plain == 0).astype(float)), 0.04, 0.1),
        (np.abs(length - 6), 1.0, 2.0),
        (words.share(marks), 0.02, 0.1),
    ]
    out = np.full((words.count, len(LABELLERS)), NOTHING, np.int8)
    enough = words.total >= FEW_WORDS
    damped = words.total / (words.total + DAMP_FEW)
    for i, (value, fine, low) in enumerate(measured):
        out[enough & (value <= fine), i] = FINE
        out[enough & (value >= low), i] = LOW
        if LABELLERS[i] in ON_FEW:
            out[~enough & (value * damped >= low), i] = LOW
    return out


@dataclass(frozen=True)
class Labellers:
    """What expectation-maximisation found: P(low), and P(vote | class, voted) as [labeller, class, vote]."""

    low: float
    table: np.ndarray

    def posterior(self, seen: np.ndarray) -> np.ndarray:
        """P(fine) for rows of votes."""
        logs = np.log([1 - self.low, self.low]) + sum(
            np.log(self.table[i][:, seen[:, i]].T) for i in range(seen.shape[1])
        )
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return np.where((seen == NOTHING).all(1), IN_DOUBT, p[:, 0] / p.sum(1))

    def accuracy(self) -> dict[str, float]:
        """Share of a labeller's votes that the model holds to be right."""
        prior = np.array([1 - self.low, self.low])
        return dict(zip(LABELLERS, self.table[:, 0, FINE] * prior[0] + self.table[:, 1, LOW] * prior[1]))


def estimate(seen: np.ndarray, weight: np.ndarray, rounds: int = 200) -> Labellers:
    """EM from vote combinations and how many documents have each. The start: any low vote means low.

    Texts without a vote take no part.
    """
    weight = np.where((seen == NOTHING).all(1), 0.0, weight)
    fine = np.where((seen == LOW).any(1), 0.1, 0.95)
    model = Labellers(0.1, np.full((seen.shape[1], 2, 3), 0.5))
    for _ in range(rounds):
        by_class = np.stack([fine * weight, (1 - fine) * weight], 1)
        total = by_class.sum(0)
        table = np.stack(
            [np.stack([by_class[seen[:, i] == v].sum(0) for v in (FINE, LOW)], 1) for i in range(seen.shape[1])]
        )
        table = (table + 0.5) / (table.sum(2, keepdims=True) + 1.0)
        # a labeller that says nothing says nothing about the class either
        table = np.concatenate([np.ones((*table.shape[:2], 1)), table], 2)
        model = Labellers(float((total[1] + 0.5) / (total.sum() + 1)), table)
        new = model.posterior(seen)
        if len(new) == 0 or np.abs(new - fine).max() < 1e-9:
            break
        fine = new
    return model


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) by row: root share of every hashed word shape, of echoes and bare marks, and a mark of few words.

    Few words on which a labeller votes have no such mark, and their shares are not damped.
    """
    words = Words(texts)
    shapes = _shapes(words.words).dictionary_encode()
    hashed = np.fromiter((zlib.crc32(s.encode()) % BUCKETS for s in shapes.dictionary.to_pylist()), np.int64, len(shapes.dictionary))
    of_word = hashed[shapes.indices.to_numpy()] if len(shapes) else np.empty(0, np.int64)
    echo = np.where(words.echo(), zlib.crc32(b"echo") % BUCKETS, zlib.crc32(b"new") % BUCKETS)
    # words without a letter or digit are one kind, whatever their marks
    bare = ~pc.match_substring_regex(words.words, r"[\pL\pN]").to_numpy(zero_copy_only=False).astype(bool)[words.codes]
    keys = [words.rows * BUCKETS + of_word[words.codes], words.rows * BUCKETS + echo]
    keys = np.concatenate([*keys, words.rows[bare] * BUCKETS + zlib.crc32(b"bare") % BUCKETS])
    pairs, times = np.unique(keys, return_counts=True)
    rows = pairs // BUCKETS
    short = words.total < FEW_WORDS
    voted = short.copy()
    voted[short] = (votes(texts.filter(pa.array(short))) != NOTHING).any(1)
    values = np.sqrt(times / np.where(voted, words.total, words.total + DAMP)[rows])
    # on few words most labellers are silent: the scorer is to learn that apart from their shapes
    few = np.flatnonzero(short & ~voted)
    rows, order = np.append(rows, few), np.argsort(np.append(rows, few), kind="stable")
    buckets = np.append(pairs % BUCKETS, np.full(len(few), zlib.crc32(b"few") % BUCKETS))
    return rows[order], buckets[order], np.append(values, np.ones(len(few)))[order]


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, buckets, values = _features(texts)
        margin = self.bias + np.bincount(rows, self.weights[buckets] * values, len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, target: np.ndarray, rounds: int = 300) -> Scorer:
    """Logistic regression on soft targets by full-batch adaptive steps; no rows: everything is fine."""
    w, bias, g, gb = np.zeros(BUCKETS), 1.0, np.full(BUCKETS, 1e-8), 1e-8
    if not len(target):
        return Scorer(w, bias)
    for _ in range(rounds):
        margin = bias + np.bincount(rows, w[buckets] * values, len(target))
        loss = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target) / len(target)
        dw = np.bincount(buckets, loss[rows] * values, BUCKETS) + 1e-6 * w
        g, gb = g + dw**2, gb + loss.sum() ** 2
        w, bias = w - 0.5 * dw / np.sqrt(g), bias - 0.2 * loss.sum() / np.sqrt(gb)
    return Scorer(w, float(bias))


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0):
            found = votes(part.column(0))
            combos, times = np.unique(found, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(combos[:, i].astype(np.int32)) for i in range(len(LABELLERS))], pa.array(times)],
                [*LABELLERS, "rows"],
            )


def label_model(docs: DataFrame, text_col: str = "text") -> Labellers:
    """Votes of all documents, counted by combination: at most 3^7 rows come to the driver."""
    schema = ", ".join(f"{x} int" for x in LABELLERS) + ", rows bigint"
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_vote_rows, schema).groupBy(*LABELLERS).agg(F.sum("rows").alias("rows")).toArrow()
    seen = np.stack([counts.column(x).to_numpy() for x in LABELLERS], 1).astype(int)
    order = np.lexsort(seen.T)
    return estimate(seen[order], counts.column("rows").to_numpy()[order].astype(float))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Labellers, Scorer]:
    """The label model of all documents, and the scorer fitted on at most ``sample`` of them, chosen by id hash."""
    model = label_model(docs, text_col)
    chosen = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                rows, buckets, values = _features(part.column(0))
                ends = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(model.posterior(votes(part.column(0)).astype(int))),
                        pa.ListArray.from_arrays(ends, pa.array(buckets)),
                        pa.ListArray.from_arrays(ends, pa.array(values)),
                    ],
                    ["fine", "buckets", "values"],
                )

    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id")  # at most ``sample`` ids
        .select("text")
        .mapInArrow(run, "fine double, buckets array<bigint>, values array<double>")
        .limit(sample)
        .toArrow()
    )
    lists = rows.column("buckets").combine_chunks()
    at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    values = rows.column("values").combine_chunks().flatten().to_numpy()
    return model, fit(at, lists.flatten().to_numpy(), values, rows.column("fine").to_numpy())


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows with all their columns and ``quality_score`` (0 to 1, higher is better), whole texts scored.

    Null, empty and wordless texts get the scorer's constant. Every row is scored by its text
    alone; an input column named ``quality_score`` is replaced.
    """
    _, scorer = train(docs, id_col, text_col, sample)
    base = docs.drop("quality_score")
    names = base.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = pa.array(scorer.scores(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*names, "quality_score"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def keep_fine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **how) -> DataFrame:
    """The rows whose score is at least ``least``, with their own columns."""
    scored = quality(docs.withColumnsRenamed({"quality_score": "__own"}), id_col, text_col, **how)
    kept = scored.where(F.col("quality_score") >= least).drop("quality_score")
    return kept.withColumnsRenamed({"__own": "quality_score"})
