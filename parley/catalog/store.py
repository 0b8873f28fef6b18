"""Queries of the chat store: keyed tables, lookups, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import fixed
from parley.catalog.base import query, table
from parley.operators import memory as M
from parley.operators import store as ST
from parley.plans.ranks import number_sorted

SESSIONS = (
    "sessions AS (SELECT user_id AS id, min(ts) AS created_at, arg_max(ts, event_id) AS updated_at, "
    "'chat ' || user_id AS title FROM events GROUP BY user_id)"
)


def _sessions(spark, sf):
    """One session per user of the event table."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.min("ts").alias("created_at"), F.max_by("ts", "event_id").alias("updated_at"))
        .withColumn("title", F.concat(F.lit("chat "), F.col("id").cast("string")))
    )


@query(
    "sessions_newest_first",
    f"WITH {SESSIONS} SELECT *, row_number() OVER (ORDER BY updated_at DESC, id) AS position FROM sessions",
)
def sessions_newest_first(spark, sf):
    return number_sorted(ST.newest_first(_sessions(spark, sf), "updated_at", "id"), "position")


@query("find_row", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def find_row(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ST.find(orders, "o_orderkey", 77)


@query(
    "find_rows_by_keys",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
def find_rows_by_keys(spark, sf):
    keys = table(spark, sf, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ST.find_many(orders, keys.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query(
    "messages_of_session",
    "SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY turn) AS position FROM conversations WHERE conv_id = 3",
)
def messages_of_session(spark, sf):
    return number_sorted(ST.messages_of(table(spark, sf, "conversations"), "conv_id", 3, "turn"), "position")


@query(
    "messages_in_order",
    "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS position FROM conversations",
)
def messages_in_order(spark, sf):
    messages = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return number_sorted(ST.messages_in_order(messages, "conv_id", "turn"), "position")


@query(
    "recent_messages",
    "SELECT user_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 24",
)
def recent_messages(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    recent = ST.recent_messages(events, "user_id", [F.desc("ts"), F.desc("event_id")], 24)
    return recent.select("user_id", "event_id", "rn")


@query(
    "characters_by_name",
    "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS position FROM customer",
)
def characters_by_name(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return number_sorted(ST.by_name(customers, "c_name", "c_custkey"), "position")


CHANGES = (
    "changes AS (SELECT o_custkey AS c_custkey, 'Renamed ' || o_orderkey AS c_name, (o_orderkey % 25)::INT "
    "AS c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, "
    "o_orderkey DESC) AS rn FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000 "
    "ELSE o_custkey END AS o_custkey) FROM orders WHERE o_orderstatus = 'P')) WHERE rn = 1)"
)


def _changes(spark, sf):
    """Character changes from orders, several per customer and some of new ones."""
    orders = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    key = F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1_000_000).otherwise(0)
    return orders.select(
        key.alias("c_custkey"),
        F.concat(F.lit("Renamed "), F.col("o_orderkey").cast("string")).alias("c_name"),
        (F.col("o_orderkey") % 25).cast("int").alias("c_nationkey"),
        F.struct("o_orderdate", "o_orderkey").alias("version"),
    )


@query(
    "upsert_rows",
    f"WITH {CHANGES} SELECT * FROM changes UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer "
    "WHERE c_custkey NOT IN (SELECT c_custkey FROM changes)",
)
def upsert_rows(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return ST.upsert(base, _changes(spark, sf), "c_custkey", "version")


@query(
    "delete_rows",
    "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
)
def delete_rows(spark, sf):
    gone = table(spark, sf, "customer").where(F.col("c_nationkey") < 5)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return ST.delete(orders, gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


@query(
    "cascade_delete",
    "SELECT 'session' AS kind, c_custkey AS id FROM customer WHERE c_nationkey >= 5 UNION ALL "
    "SELECT 'message', o_orderkey FROM orders WHERE o_custkey NOT IN "
    "(SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
)
def cascade_delete(spark, sf):
    sessions = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    messages = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    gone = sessions.where(F.col("c_nationkey") < 5)
    left, kept = ST.delete_sessions(sessions, messages, gone, "c_custkey", "o_custkey")
    return left.select(F.lit("session").alias("kind"), F.col("c_custkey").alias("id")).unionByName(
        kept.select(F.lit("message").alias("kind"), F.col("o_orderkey").alias("id"))
    )


@query(
    "rename_sessions",
    f"WITH {SESSIONS}, ch AS (SELECT l_orderkey AS id, 'order ' || l_orderkey AS title, max(l_shipdate) AS updated_at "
    "FROM lineitem GROUP BY l_orderkey) SELECT s.id, coalesce(ch.title, s.title) AS title, "
    "coalesce(ch.updated_at, s.updated_at) AS updated_at FROM sessions s LEFT JOIN ch ON s.id = ch.id",
)
def rename_sessions(spark, sf):
    key = F.col("l_orderkey")
    changes = (
        table(spark, sf, "lineitem")
        .groupBy(key.alias("id"))
        .agg(F.max("l_shipdate").alias("updated_at"))
        .withColumn("title", F.concat(F.lit("order "), F.col("id").cast("string")))
    )
    renamed = ST.rename(_sessions(spark, sf), changes, "id", "title", "updated_at")
    return renamed.select("id", "title", "updated_at")


@query(
    "touch_sessions",
    "SELECT c_custkey, greatest(TIMESTAMP '1998-01-01', max(o_orderdate)) AS updated_at "
    "FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
)
def touch_sessions(spark, sf):
    sessions = table(spark, sf, "customer").select(
        "c_custkey", F.lit("1998-01-01").cast(table(spark, sf, "orders").schema["o_orderdate"].dataType).alias("updated_at")
    )
    messages = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    return ST.touch(sessions, messages, "c_custkey", "o_custkey", "o_orderdate", "updated_at")


SUPPLIER = (
    "chars AS (SELECT CASE s_suppkey WHEN 1 THEN 'wizard' WHEN 2 THEN 'historian' ELSE 's' || s_suppkey END AS id, "
    "s_name AS name, 'calm' AS personality, 'sea' AS world, 'dry' AS tone FROM supplier)"
)


def _characters(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.when(key == 1, "wizard").when(key == 2, "historian")
        .otherwise(F.concat(F.lit("s"), key.cast("string"))).alias("id"),
        F.col("s_name").alias("name"),
        F.lit("calm").alias("personality"),
        F.lit("sea").alias("world"),
        F.lit("dry").alias("tone"),
    )


def _defaults_sql(only=None):
    rows = [r for r in fixed.STORE_CHARACTERS if only is None or r[0] in only]
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
    return f"defaults AS (SELECT * FROM (VALUES {values}) d(id, name, personality, world, tone))"


@query(
    "seed_defaults_overwrite",
    f"WITH {SUPPLIER}, {_defaults_sql(['wizard', 'detective'])} SELECT * FROM defaults UNION ALL "
    "SELECT * FROM chars WHERE id NOT IN (SELECT id FROM defaults)",
)
def seed_defaults_overwrite(spark, sf):
    return ST.seed_defaults(_characters(spark, sf), overwrite=True)


@query(
    "seed_defaults_missing",
    f"WITH {SUPPLIER}, {_defaults_sql()} SELECT * FROM chars UNION ALL "
    "SELECT * FROM defaults WHERE id NOT IN (SELECT id FROM chars)",
)
def seed_defaults_missing(spark, sf):
    return ST.seed_defaults(_characters(spark, sf), overwrite=False)


@query(
    "active_character",
    f"WITH {SUPPLIER} SELECT c_custkey, coalesce(a.name, (SELECT name FROM chars WHERE id = 'wizard'), 'Character') "
    "AS active FROM customer LEFT JOIN chars a ON a.id = 's' || c_custkey",
)
def active_character(spark, sf):
    key = F.col("c_custkey")
    requests = table(spark, sf, "customer").select(
        key, F.concat(F.lit("s"), key.cast("string")).alias("requested")
    )
    found = ST.active_character(requests, _characters(spark, sf), F.lit("Character"))
    return found.select("c_custkey", "active")


@query(
    "unique_character_ids",
    """
    WITH new AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g')
        AS base FROM part),
    held AS (SELECT DISTINCT base FROM new WHERE p_partkey % 9 = 0),
    late AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS j FROM new)
    SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS id FROM (
      SELECT p_partkey, late.base, j + CASE WHEN held.base IS NULL THEN 0 ELSE 1 END AS n
      FROM late LEFT JOIN held ON late.base = held.base)""",
)
def unique_character_ids(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    held = parts.where(F.col("p_partkey") % 9 == 0).select(
        F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9_]+", "_"), "_+", "_").alias("id")
    ).distinct()
    return ST.unique_ids(
        parts.withColumn("requested", F.lit("")), held, "requested", "name", "p_partkey"
    ).select("p_partkey", "id")


@query(
    "insert_with_derived_ids",
    "SELECT sha256(conv_id || chr(31) || turn) AS id, conv_id, turn FROM conversations",
)
def insert_with_derived_ids(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return ST.with_new_ids(rows, "conv_id", "turn").select("id", "conv_id", "turn")


@query(
    "insert_with_random_ids",
    "SELECT role, count(*) AS rows, count(*) AS ids, 36 AS shortest, 36 AS longest, count(*) AS dated "
    "FROM conversations GROUP BY role",
)
def insert_with_random_ids(spark, sf):
    """Random ids are of one form, and all of them differ; every row has its time."""
    rows = ST.with_new_ids(table(spark, sf, "conversations"))
    return rows.groupBy("role").agg(
        F.count("*").alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.min(F.length("id")).alias("shortest"),
        F.max(F.length("id")).alias("longest"),
        F.count("created_at").alias("dated"),
    )


@query(
    "top_memories",
    "SELECT user_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY round(value) DESC, event_id DESC) AS rn FROM events) WHERE rn <= 12",
)
def top_memories(spark, sf):
    items = table(spark, sf, "events").select("user_id", "event_id", F.round("value").alias("score"))
    return M.top_memories(items, "user_id", "score", "event_id").select("user_id", "event_id", "rn")


@query(
    "recent_memories",
    "SELECT user_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 12",
)
def recent_memories(spark, sf):
    items = table(spark, sf, "events").select("user_id", "event_id")
    return M.recent_memories(items, "user_id", "event_id").select("user_id", "event_id", "rn")
