"""Structured Streaming jobs: the batch column functions over rows that arrive over time.

Every job takes what is there and stops (``availableNow``) unless another trigger is given, and
goes on from its checkpoint when started again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parley import fixed
from parley.functions.records import map_chat_record
from parley.operators.memory import keep_capacity, remember
from parley.operators.validate import curate, validate_rows
from parley.sources.files import CORRUPT, parse_json_lines
from parley.sources.live import apply_changes
from parley.sources.snapshots import load_snapshot, save_snapshot, save_view
from parley.sources.tables import LOG

FILES_PER_BATCH = 1_000


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet",
    glob: str | None = None, files_per_batch: int = FILES_PER_BATCH, bytes_per_batch: str | None = None,
) -> DataFrame:
    """Arriving files; a batch is bounded by bytes (as ``"1g"``) where given, else by files."""
    bound = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    reader = spark.readStream.schema(schema).option(*bound)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(kind).load(folder)


def append_to(rows: DataFrame, target: str, checkpoint: str, kind: str = "parquet", **trigger) -> StreamingQuery:
    writer = rows.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.option("path", target).trigger(**(trigger or {"availableNow": True})).start()


def corpus_texts(
    lines: DataFrame, max_turns: int = fixed.MAX_TURNS, max_chars: int = fixed.MAX_CHARS
) -> DataFrame:
    """Validated training texts of JSON lines as they arrive. ``corpus_rejects`` has the other lines."""
    records = map_chat_record(parse_json_lines(lines))
    known = records.where(F.col(CORRUPT).isNull() & F.col("turns").isNotNull())
    return validate_rows(known, max_turns, max_chars).select("system", "turns", "text")


def corpus_rejects(lines: DataFrame) -> DataFrame:
    """(path, value, reason) of the lines that ``corpus_texts`` cannot use; run both on one source."""
    path = F.col("path") if "path" in lines.columns else F.lit(None).cast("string")
    kept = lines.withColumns({"__path": path, "__value": F.col("value")})
    records = map_chat_record(parse_json_lines(kept.drop("path")))
    reason = F.when(F.col(CORRUPT).isNotNull(), "not a JSON object").when(F.col("turns").isNull(), "no known shape")
    return records.select(F.col("__path").alias("path"), F.col("__value").alias("value"), reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def strict_corpus_texts(lines: DataFrame, **limits) -> DataFrame:
    """As ``corpus_texts``, but the first line that cannot be used fails the batch."""
    records = map_chat_record(parse_json_lines(lines.withColumn("__value", F.col("value"))))
    bad = F.col(CORRUPT).isNotNull() | F.col("turns").isNull()
    wrong = F.raise_error(F.concat(F.lit("unusable corpus line: "), F.col("__value"))).cast("boolean")
    return validate_rows(records.where(F.when(bad, wrong).otherwise(True)), **limits).select("system", "turns", "text")


def curated_logs(logs: DataFrame, min_score: float = fixed.MIN_LOG_SCORE) -> DataFrame:
    return curate(logs, min_score)


def read_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return read_stream(spark, folder, LOG, "json")


def extracted_memories(turns: DataFrame, mem_id: Column, seq: Column) -> DataFrame:
    """Memory rows of arriving turns, to be appended."""
    return remember(turns, mem_id, seq)


def _each_batch(
    rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def keep_memory(
    memories: DataFrame, folder: str, checkpoint: str, rows: int = fixed.MEMORY_CAPACITY, **trigger
) -> StreamingQuery:
    """Maintain the capped memory table: every batch writes the version holding the newest rows."""
    schema = memories.schema

    def work(batch: DataFrame, number: int) -> None:
        held = load_snapshot(batch.sparkSession, folder, schema, before=number + 1)
        save_snapshot(keep_capacity(held.unionByName(batch), rows), folder, number + 1)

    return _each_batch(memories, work, checkpoint, trigger)


def keep_view(
    changes: DataFrame, folder: str, checkpoint: str, key: str, version: str, **trigger
) -> StreamingQuery:
    """Maintain a store table: every batch of changes rewrites the buckets of its keys.

    The table keeps the ``version`` column, so a late change never replaces a newer row.
    """

    def work(batch: DataFrame, number: int) -> None:
        save_view(batch, folder, key, version, number + 1)

    return _each_batch(changes, work, checkpoint, trigger)


def keep_store(
    changes: DataFrame, folder: str, checkpoint: str, by: Sequence[Column], n: int = fixed.TOP_MEMORIES, **trigger
) -> StreamingQuery:
    """Maintain sessions, messages and the first ``n`` messages of each, with deletions that cascade and feeds.

    See ``parley.sources.live`` for the columns of a change and what can be read meanwhile.
    """

    def work(batch: DataFrame, number: int) -> None:
        apply_changes(batch, folder, number + 1, by, n)

    return _each_batch(changes, work, checkpoint, trigger)
