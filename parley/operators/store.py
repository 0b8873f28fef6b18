"""Chat store tables: lookups, upserts, deletes and seeds as new table versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.text import slug, strip
from parley.plans.folds import last_rows
from parley.plans.ranks import rank_by_ordinal, running_rows
from parley.plans.sizes import checked_broadcast
from parley.session import cut_lineage

CHARACTER_SCHEMA = "id string, name string, personality string, world string, tone string"
_BLOCK = 65_536


def newest_first(df: DataFrame, updated: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(updated), *ties)


def by_name(characters: DataFrame, name: str = "name", *ties: str) -> DataFrame:
    return characters.orderBy(name, *ties)


def find(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)


def find_many(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a key table."""
    return df.join(checked_broadcast(keys.select(key).distinct()), key, "left_semi")


def messages_of(messages: DataFrame, session: str, value, by: str) -> DataFrame:
    return messages.where(F.col(session) == value).orderBy(by)


def messages_in_order(messages: DataFrame, session: str, by: str) -> DataFrame:
    """All sessions' messages in time order, range-partitioned."""
    return messages.orderBy(session, by)


def recent_messages(messages: DataFrame, session: str, by: Sequence[Column], n: int) -> DataFrame:
    """Newest ``n`` messages of every session, numbered from the newest."""
    return last_rows(messages, [session], by, n)


def newest_versions(changes: DataFrame, key: str, version: str | Column) -> DataFrame:
    """One row per key, the one of the highest version."""
    at = F.col(version) if isinstance(version, str) else version
    row = F.max_by(F.struct(*changes.columns), at).alias("__row")
    return changes.groupBy(key).agg(row).select("__row.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str | Column | None = None) -> DataFrame:
    """Table after replacing and adding rows by key.

    The base is only filtered by the changed keys, so with few changes it is not shuffled.
    ``version`` orders several changes of one key.
    """
    newest = changes if version is None else newest_versions(changes, key, version)
    untouched = base.join(checked_broadcast(newest.select(key)), key, "left_anti")
    return untouched.unionByName(newest.select(*base.columns))


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(checked_broadcast(keys.select(key).distinct()), key, "left_anti")


def delete_sessions(
    sessions: DataFrame, messages: DataFrame, keys: DataFrame, key: str, session: str
) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) without the given sessions; memories stay."""
    gone = keys.select(F.col(key).alias(session))
    return delete(sessions, keys, key), delete(messages, gone, session)


def rename(
    sessions: DataFrame, changes: DataFrame, key: str, title: str, updated: str
) -> DataFrame:
    """Set title and update time of known sessions: the newest change of each; unknown ones do nothing."""
    new = newest_versions(changes, key, updated).select(
        key, F.col(title).alias("__title"), F.col(updated).alias("__updated")
    )
    return (
        sessions.join(checked_broadcast(new), key, "left")
        .withColumns(
            {title: F.coalesce("__title", title), updated: F.coalesce("__updated", updated)}
        )
        .drop("__title", "__updated")
    )


def touch(
    sessions: DataFrame, messages: DataFrame, key: str, session: str, created: str, updated: str
) -> DataFrame:
    """Move a session's update time to its newest message."""
    newest = messages.groupBy(F.col(session).alias(key)).agg(F.max(created).alias("__newest"))
    return (
        sessions.join(newest, key, "left")
        .withColumn(updated, F.greatest(updated, "__newest"))
        .drop("__newest")
    )


def default_characters(df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    rows = [r for r in fixed.STORE_CHARACTERS if only is None or r[0] in only]
    return df.sparkSession.createDataFrame(rows, CHARACTER_SCHEMA)


def seed_defaults(characters: DataFrame, overwrite: bool) -> DataFrame:
    """Add the default characters: two that overwrite, or four where their id is missing."""
    if overwrite:
        return upsert(characters, default_characters(characters, fixed.ALWAYS_SEEDED), "id")
    defaults = default_characters(characters)
    held = characters.join(F.broadcast(defaults.select("id")), "id", "left_semi").select("id").distinct()
    return characters.unionByName(defaults.join(held, "id", "left_anti").select(*characters.columns))


def active_character(
    requests: DataFrame, characters: DataFrame, current: Column, key: str = "requested"
) -> DataFrame:
    """Add ``active``: the requested character, else the default one, else the current one."""
    known = characters.select(F.col("id").alias(key), F.col("name").alias("__asked"))
    fallback = (
        characters.where(F.col("id") == fixed.DEFAULT_CHARACTER).agg(F.max("name")).scalar()
    )
    return (
        requests.join(checked_broadcast(known), key, "left")
        .withColumn("active", F.coalesce(F.col("__asked"), fallback, current))
        .drop("__asked")
    )


def _free_numbers(new: DataFrame, taken: DataFrame) -> DataFrame:
    """Give the j-th newcomer of a base name the j-th free number of that name.

    With the taken numbers t(0) < t(1) < ..., that is j plus the count of i with t(i) - i <= j:
    a running count over the merged positions, cut into blocks, so one name may hold any share
    of the rows.
    """
    slots = rank_by_ordinal(taken.distinct(), "number", ["base"], "__i")
    steps = (
        slots.groupBy("base", (F.col("number") - (F.col("__i") - 1)).alias("pos"))
        .agg(F.count("*").alias("stored"))
        .withColumn("newcomer", F.lit(None).cast("bigint"))
    )
    ranked = rank_by_ordinal(new, "newcomer", ["base"], "pos")
    marks = steps.select("base", "pos", "stored", "newcomer").unionByName(
        ranked.select("base", "pos", F.lit(0).cast("bigint").alias("stored"), "newcomer")
    )
    cells = marks.withColumn("__cell", F.floor(F.col("pos") / _BLOCK))
    before = running_rows(
        cells.groupBy("base", "__cell").agg(F.sum("stored").alias("__rows")), ["base"], "__cell"
    )
    window = Window.partitionBy("base", "__cell").orderBy("pos", F.desc("stored"))
    inside = F.sum("stored").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return (
        cells.withColumn("__inside", inside)
        .join(before, ["base", "__cell"])
        .where(F.col("newcomer").isNotNull())
        .select("newcomer", "base", (F.col("pos") + F.col("__before") + F.col("__inside")).alias("number"))
    )


def _numbered_id(base: Column, number: Column) -> Column:
    return F.when(number == 1, base).otherwise(F.concat(base, F.lit("_"), number.cast("string")))


def _readings(ids: DataFrame) -> DataFrame:
    """(base, number): an id is its own name number 1, and ``x_7`` is number 7 of ``x``."""
    pattern = r"(?s)^(.*)_([1-9][0-9]{0,17})$"
    bare = ids.select(F.col("id").alias("base"), F.lit(1).cast("bigint").alias("number"))
    suffixed = ids.select(
        F.regexp_extract("id", pattern, 1).alias("base"),
        F.regexp_extract("id", pattern, 2).try_cast("bigint").alias("number"),
    ).where(F.col("number") >= 2)
    return bare.unionByName(suffixed)


def unique_ids(
    new: DataFrame, existing: DataFrame, requested: str, name: str, newcomer: str
) -> DataFrame:
    """Add ``id`` to new characters: slug, then ``_2``, ``_3``, ... while taken.

    ``newcomer`` is the arrival number. Where a numbered name meets a literal one (``x`` gives
    ``x_2`` and somebody is called ``x 2``) the earlier arrival keeps the id and the later ones
    of the losing name are numbered again. Rounds are written to the shared folder, so the
    plan of a round does not contain those before it.
    """
    asked = F.coalesce(F.nullif(strip(F.col(requested)), F.lit("")), F.col(name))
    open_ = new.select(F.col(newcomer).alias("newcomer"), slug(asked, "letters").alias("base"))
    taken, done = existing.select("id"), None
    # the first arrival of all that are open always keeps its id, so every round settles some
    while True:
        numbered = _free_numbers(open_, _readings(taken))
        given = cut_lineage(numbered.withColumn("id", _numbered_id(F.col("base"), F.col("number"))))
        first = given.groupBy("id").agg(F.min("newcomer").alias("__first"))
        judged = given.join(first, "id").withColumn("lost", F.col("newcomer") != F.col("__first"))
        lost_from = judged.where("lost").groupBy("base").agg(F.min("newcomer").alias("__from"))
        again = F.coalesce(F.col("newcomer") >= F.col("__from"), F.lit(False))
        judged = cut_lineage(judged.join(lost_from, "base", "left").withColumn("again", again))
        kept = judged.where(~F.col("again")).select("newcomer", "id")
        done = kept if done is None else done.unionByName(kept)
        open_ = judged.where("again").select("newcomer", "base")
        if open_.isEmpty():
            break
        taken = taken.unionByName(kept.select("id"))
    return new.join(done.withColumnRenamed("newcomer", newcomer), newcomer)


def with_new_ids(rows: DataFrame, *keys: str, created: str = "created_at", now: Column | None = None) -> DataFrame:
    """Rows to insert: an id and a creation time.

    Without keys the id is random; with keys it derives from them, so a rerun gives the same id.
    """
    identity = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256) if keys else F.uuid()
    return rows.withColumns({"id": identity, created: F.current_timestamp() if now is None else now})
