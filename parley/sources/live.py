"""A chat store kept from a feed of changes: sessions, their messages, newest messages, and who must be told.

A change is a row with ``kind`` (``session`` or ``message``), ``id``, ``session`` (of a message; of a
session its own id), ``version`` and ``deleted``; all other columns are the row's contents. What
holds depends on the changes alone, not on their order or batches:

- of one id the highest version holds, at equal versions a deletion, else the greater hash of the row;
- a session's deletion takes along its messages up to that version, also those that arrive later
  and even if the session is created again; messages of unknown sessions stay.

Tables lie in cells: a message's by session and, so that no session is one cell, by its own id.
A batch rewrites the cells it touches. Deleted rows stay as marks, which late changes meet, but for
messages that went with their session: the session's own mark keeps them away. Every batch also
writes what it changed, in a feed that tells a reader exactly how to bring a copy up to date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.store import recent_messages
from parley.plans.sizes import checked_broadcast
from parley.sources.snapshots import (
    BUCKET, last_version, manifest_of, read_buckets, save_snapshot, versions, write_buckets,
)

SESSIONS, MESSAGES, RECENT, FEED, RECENT_FEED = "sessions", "messages", "recent", "feed", "recent_feed"
#: Cells by session, and by message inside each of them.
CELLS, SALTS = 64, 16
PUT, DELETE = "put", "delete"
_KEPT = ["buried", "batch", "op"]
#: A feed keeps all its versions; who owns the store clears those that every reader has seen.
_ALL = 1 << 30


def _stored(changes: T.StructType) -> T.StructType:
    """Columns of a table: those of a change, the session's last deletion, and what the last batch did."""
    fields = [f for f in changes.fields if f.name != "kind"]
    return T.StructType([*fields, *T._parse_datatype_string("buried bigint, batch int, op string").fields])


def _session_cell(column: str = "session") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(CELLS)).cast("int")


def _message_cell(session: str = "session", key: str = "id") -> Column:
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    return (_session_cell(session) * SALTS + salt).cast("int")


def _cells(rows: DataFrame, cell: Column) -> list[int]:
    """At most as many numbers as there are cells."""
    return [r[0] for r in rows.select(cell.alias("c")).distinct().collect()]


def _part(spark: SparkSession, folder: str, schema: T.StructType, manifest: dict[int, int], cells: Sequence[int]) -> DataFrame:
    return read_buckets(spark, folder, schema, {b: manifest[b] for b in cells if b in manifest})


def _merged(held: DataFrame, changes: DataFrame, number: int) -> DataFrame:
    """Held rows after the changes, with ``was``: whether a row was live before them."""
    contents = [c for c in held.columns if c not in _KEPT]
    keys = checked_broadcast(changes.select("id").distinct())
    fresh = changes.select(
        *contents,
        F.when(F.col("deleted"), F.col("version")).alias("buried"),
        F.lit(number).alias("batch"),
        F.lit(None).cast("string").alias("op"),
        F.lit(False).alias("was"),
    )
    held = held.withColumn("was", ~F.col("deleted"))
    row = F.struct(*contents, "batch", "op")
    # of equal rows the held one stays, so a repeated change is nothing new
    order = F.struct("version", "deleted", F.xxhash64(*contents), -F.col("batch"))
    found = (
        held.join(keys, "id", "left_semi")
        .unionByName(fresh)
        .groupBy("id")
        .agg(F.max_by(row, order).alias("row"), F.max("buried").alias("buried"), F.max("was").alias("was"))
        .select("row.*", "buried", "was")
    )
    return held.join(keys, "id", "left_anti").unionByName(found)


def _told(rows: DataFrame, number: int, taken: Column) -> DataFrame:
    """``op`` and ``batch`` where this batch changed what a reader sees; rows ``taken`` count as deleted."""
    live = ~F.col("deleted") & ~taken
    op = F.when(F.col("was") & ~live, DELETE).when(live & (F.col("batch") == number), PUT)
    rows = rows.withColumn("__op", op)
    return rows.withColumns(
        {
            "deleted": F.col("deleted") | taken,
            "batch": F.when(F.col("__op").isNotNull(), number).otherwise(F.col("batch")),
            "op": F.when(F.col("batch") == number, F.col("__op")).otherwise(F.coalesce("__op", "op")),
        }
    ).drop("__op")


def _save_sessions(changes: DataFrame, folder: str, number: int, schema: T.StructType) -> None:
    spark, place = changes.sparkSession, f"{folder}/{SESSIONS}"
    manifest = manifest_of(spark, place, before=number)
    touched = _cells(changes, _session_cell("id"))
    rows = _merged(_part(spark, place, schema, manifest, touched), changes, number)
    rows = _told(rows, number, F.lit(False)).select(*schema.names, _session_cell("id").alias(BUCKET))
    write_buckets(rows, place, number, manifest, touched)


def _save_messages(changes: DataFrame, gone: DataFrame, folder: str, number: int, schema: T.StructType) -> None:
    spark, place, above = changes.sparkSession, f"{folder}/{MESSAGES}", f"{folder}/{SESSIONS}"
    manifest = manifest_of(spark, place, before=number)
    of_gone = [c * SALTS + s for c in _cells(gone, _session_cell("id")) for s in range(SALTS)]
    touched = sorted({*_cells(changes, _message_cell()), *of_gone})
    rows = _merged(_part(spark, place, schema, manifest, touched), changes, number)
    sessions = _part(spark, above, schema, manifest_of(spark, above, before=number + 1), sorted({c // SALTS for c in touched}))
    graves = sessions.where("buried is not null").select(F.col("id").alias("session"), F.col("buried").alias("__until"))
    rows = rows.join(checked_broadcast(graves), "session", "left")
    taken = F.coalesce(F.col("version") <= F.col("__until"), F.lit(False))
    # once told, a message that went with its session needs no mark of its own
    rows = _told(rows.where(~taken | F.col("was")), number, taken).select(*schema.names, _message_cell().alias(BUCKET))
    write_buckets(rows, place, number, manifest, touched)


def _changed(spark: SparkSession, place: str, number: int, schema: T.StructType) -> DataFrame:
    """What version ``number`` of a table put or deleted, from the cells that it wrote."""
    manifest = manifest_of(spark, place, before=number + 1)
    written = [c for c, at in manifest.items() if at == number]
    return _part(spark, place, schema, manifest, written).where((F.col("batch") == number) & F.col("op").isNotNull())


def _save_feed(folder: str, name: str, rows: DataFrame, number: int) -> None:
    save_snapshot(rows.drop("buried", "deleted"), f"{folder}/{name}", number, keep=_ALL)


def _save_recent(
    spark: SparkSession, folder: str, number: int, schema: T.StructType, by: Sequence[Column], n: int
) -> None:
    """The first ``n`` live messages of every session, and the feed of what changed among them.

    New messages meet the rows held. Only a session that lost or changed a held row is read again.
    """
    base, place = f"{folder}/{MESSAGES}", f"{folder}/{RECENT}"
    told = _changed(spark, base, number, schema)
    manifest = manifest_of(spark, place, before=number)
    touched = _cells(told, _session_cell())
    held = _part(spark, place, schema, manifest, touched)
    moved = checked_broadcast(told.select("session").distinct())
    again = told.join(checked_broadcast(held.select("id")), "id", "left_semi").select("session").distinct()
    of_again = [c * SALTS + s for c in _cells(again, _session_cell()) for s in range(SALTS)]
    again = checked_broadcast(again)
    whole = _part(spark, base, schema, manifest_of(spark, base, before=number + 1), of_again).where(~F.col("deleted"))
    candidates = (
        held.join(moved, "session", "left_semi")
        .unionByName(told.where(F.col("op") == PUT))
        .join(again, "session", "left_anti")
        .unionByName(whole.join(again, "session", "left_semi"))
    )
    rows = held.join(moved, "session", "left_anti").unionByName(recent_messages(candidates, "session", by, n).drop("rn"))
    now = write_buckets(rows.withColumn(BUCKET, _session_cell()), place, number, manifest, touched)
    new = _part(spark, place, schema, now, touched)
    put = new.join(held.select("id", "batch"), ["id", "batch"], "left_anti").withColumn("op", F.lit(PUT))
    lost = held.join(new.select("id"), "id", "left_anti").withColumn("op", F.lit(DELETE))
    feed = put.unionByName(lost.select(*put.columns)).withColumn("batch", F.lit(number)).withColumn("kind", F.lit("message"))
    _save_feed(folder, RECENT_FEED, feed, number)


def apply_changes(changes: DataFrame, folder: str, number: int, by: Sequence[Column], n: int) -> None:
    """Batch ``number`` of changes, into all tables of the store. Done again, it gives the same store.

    Changes of another kind, or without an id, a session, a version or a word on deletion, are left
    out. ``by`` orders the messages of a session, of which the first ``n`` are held ready; it must
    tell any two apart. A message stays in its session.
    """
    spark, schema = changes.sparkSession, _stored(changes.schema)
    known = ["id", "session", "version", "deleted"]
    sound = changes.where(F.col("kind").isin("session", "message")).dropna(subset=known)
    save_snapshot(sound, f"{folder}/changes", number)
    batch = spark.read.schema(changes.schema).parquet(f"{folder}/changes/snapshot={number}")
    sessions, messages = (batch.where(F.col("kind") == kind).drop("kind") for kind in ("session", "message"))
    _save_sessions(sessions, folder, number, schema)
    gone = sessions.where("deleted")
    _save_messages(messages, gone, folder, number, schema)
    told = [
        _changed(spark, f"{folder}/{name}", number, schema).withColumn("kind", F.lit(kind))
        for name, kind in ((SESSIONS, "session"), (MESSAGES, "message"))
    ]
    _save_feed(folder, FEED, told[0].unionByName(told[1]), number)
    _save_recent(spark, folder, number, schema, by, n)


def load_live(spark: SparkSession, folder: str, name: str, changes: T.StructType) -> DataFrame:
    """Live rows of ``sessions``, ``messages`` or ``recent`` after the last whole batch."""
    schema, done = _stored(changes), last_version(spark, f"{folder}/{RECENT_FEED}")
    place = f"{folder}/{name}"
    manifest = {} if done is None else manifest_of(spark, place, before=done + 1)
    return read_buckets(spark, place, schema, manifest).where(~F.col("deleted")).drop(*_KEPT, "deleted")


def load_feed(spark: SparkSession, folder: str, name: str, changes: T.StructType, after: int = 0) -> DataFrame:
    """What the whole batches after number ``after`` put and deleted: ``feed`` or ``recent_feed``."""
    fields = [f for f in _stored(changes).fields if f.name not in ("buried", "deleted")]
    schema = T.StructType([*fields, T.StructField("kind", T.StringType())])
    done = versions(spark, f"{folder}/{RECENT_FEED}")
    paths = [f"{folder}/{name}/snapshot={v}" for v in done if v > after]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replay(feed: DataFrame) -> DataFrame:
    """The rows that a reader of a whole feed holds in the end."""
    # what left the newest messages in a batch never comes back in the same one
    newest = F.max_by(F.struct(*[c for c in feed.columns if c not in ("kind", "id")]), "batch").alias("row")
    return feed.groupBy("kind", "id").agg(newest).select("kind", "id", "row.*").where(F.col("op") == PUT).drop("op", "batch")
