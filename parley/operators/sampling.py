"""Corpus sampling, mixing, sharding and splitting. All choices depend on seed and row key only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import fixed
from parley.plans.folds import last_rows
from parley.plans.ranks import (
    first_by_key,
    key_range,
    mark_first_share,
    rank_by_key,
    rank_by_ordinal,
    seeded_key,
)

KEY = "__key"


def with_key(df: DataFrame, *ids: str, seed: int = fixed.SEED) -> DataFrame:
    return df.withColumn(KEY, seeded_key(*[F.col(c).cast("string") for c in ids], seed=seed))


def shuffle_rows(df: DataFrame, *ids: str, seed: int = fixed.SEED) -> DataFrame:
    """Seeded global shuffle: a range-partitioned sort by key."""
    return with_key(df, *ids, seed=seed).orderBy(KEY).drop(KEY)


def cap_sources(
    df: DataFrame, source: str, *ids: str, rows: int = fixed.ROWS_PER_SOURCE, seed: int = fixed.SEED
) -> DataFrame:
    """A seeded uniform sample of at most ``rows`` rows per source; smaller sources stay whole."""
    return first_by_key(with_key(df, *ids, seed=seed), KEY, rows, [source]).drop(KEY)


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a column missing in one part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def route_stages(df: DataFrame, source: str, stages: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``stage`` and repeat a row for every stage its source feeds; other sources go.

    The registry is program text and small, so it travels as a literal map: no join, and a hot
    source moves nowhere.
    """
    entries = [
        part
        for name, feeds in stages.items()
        for part in (F.lit(name), F.array(*[F.lit(s) for s in feeds]))
    ]
    return df.withColumn("stage", F.explode(F.try_element_at(F.create_map(*entries), F.col(source))))


def with_slot(df: DataFrame, source: str, by: str, name: str = "slot") -> DataFrame:
    """Add the raw row number inside the source, from 1: rejected rows use a slot too."""
    return rank_by_ordinal(df, by, [source], name)


def interleave(
    df: DataFrame, source: str, by: str, keep: Column | None = None, take: int | None = None
) -> DataFrame:
    """Round-robin over sources (in name order) until all are used up.

    Slots are counted on raw rows; ``take`` bounds the raw rows per source, and only then does
    ``keep`` drop the rows whose mapper gave nothing. The order is (slot, source).
    """
    # a bounded take keeps that many rows per source and task before anything moves
    slotted = with_slot(df, source, by) if take is None else last_rows(df, [source], [F.col(by)], take, "slot")
    if keep is not None:
        slotted = slotted.where(keep)
    return slotted.orderBy("slot", source)


def repeat_epochs(df: DataFrame, epochs: int, *ids: str, seed: int = fixed.SEED) -> DataFrame:
    """The corpus ``epochs`` times, each epoch with a shuffle key of its own in ``epoch_key``."""
    every = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    keyed = seeded_key(F.col("epoch").cast("string"), *[F.col(c).cast("string") for c in ids], seed=seed)
    return every.withColumn("epoch_key", keyed)


def assign_shards(df: DataFrame, file: str, by: str, workers: int) -> DataFrame:
    """Add ``shard``: row ordinal inside its file, from 0, modulo the number of workers."""
    ordered = rank_by_ordinal(df, by, [file], "__ordinal")
    return ordered.withColumn("shard", ((F.col("__ordinal") - 1) % workers).cast("int")).drop("__ordinal")


def shuffle_blocks(
    df: DataFrame, by: str, *ids: str, buffer: int = fixed.SHUFFLE_BUFFER, seed: int = fixed.SEED
) -> DataFrame:
    """Local shuffle: rows change places only inside blocks of ``buffer`` consecutive rows.

    Adds ``position``, the new place of the row, from 1.
    """
    ordered = rank_by_ordinal(with_key(df, *ids, seed=seed), by, (), "__ordinal")
    blocks = ordered.withColumn("__shuffle", F.floor((F.col("__ordinal") - 1) / buffer))
    window = Window.partitionBy("__shuffle").orderBy(KEY)
    return blocks.withColumn(
        "position", F.col("__shuffle") * buffer + F.row_number().over(window)
    ).drop(KEY, "__ordinal", "__shuffle")


def split_rows(df: DataFrame, fraction: float, *ids: str, seed: int = fixed.SEED) -> DataFrame:
    """Add ``split``: exactly ``ceil(rows * fraction)`` rows are ``test``, the others ``train``."""
    marked = mark_first_share(with_key(df, *ids, seed=seed), KEY, fraction, "__test")
    return marked.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop(KEY, "__test")


def rows_of_run(
    df: DataFrame,
    *ids: str,
    start_step: int = 0,
    steps: int = fixed.RUN_STEPS,
    batch: int = fixed.STEP_BATCH,
    accumulation: int = fixed.STEP_ACCUMULATION,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Rows that one run consumes from the shuffled corpus, with the ``global_step`` using them."""
    per_step = batch * accumulation
    first, last = start_step * per_step + 1, (start_step + steps) * per_step
    used = key_range(with_key(df, *ids, seed=seed), KEY, first, last)
    ranked = rank_by_key(used, KEY, name="__rank")
    step = F.floor((F.col("__rank") - 1 + (first - 1)) / per_step) + 1
    return ranked.withColumn("global_step", step.cast("int")).drop(KEY, "__rank")


def latest_checkpoint(manifest: DataFrame, path: str = "path") -> DataFrame:
    """One row (path, step): the highest ``checkpoint-<number>``; other names do not count."""
    step = F.regexp_extract(path, r"(?:^|/)checkpoint-([0-9]+)$", 1).try_cast("bigint")
    return (
        manifest.select(F.col(path).alias("path"), step.alias("step"))
        .where(F.col("step").isNotNull())
        .agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))
    )


def corpus_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))
