"""Registry of queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.spread import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Chosen columns of a table for heavy text work."""
    return spread(table(spark, folder, name).select(*columns))


# Generated prose holds hardly any cue words, so every message gets a prefix by its number.
CUE_PREFIX = [
    "",
    "Remember my name is Arin. ",
    "We are in the old town at night. ",
    "Thank you, that is great. ",
    "Why is the quest secret? ",
    "Roleplay as a pirate and sing. ",
    "I hate spiders. To be continued. ",
    "Help, is he a liar? ",
]


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with cue prefixes: conv_id, user_id, turn, role, text."""
    return with_cues(table(spark, folder, "conversations"))


def with_cues(messages: DataFrame) -> DataFrame:
    n = (F.col("conv_id") * 7 + F.col("turn")) % 8
    prefix = F.get(F.array(*[F.lit(p) for p in CUE_PREFIX]), n.cast("int"))
    return messages.select(
        "conv_id",
        (F.col("conv_id") % 10).alias("user_id"),
        "turn",
        "role",
        F.concat(prefix, "text").alias("text"),
    )


_PREFIX_SQL = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(CUE_PREFIX))
CHAT = (
    "chat AS (SELECT conv_id, conv_id % 10 AS user_id, turn, role, "
    f"(CASE (conv_id * 7 + turn) % 8 {_PREFIX_SQL} END) || text AS text FROM conversations)"
)


def pairs_sql(source: str, name: str = "pairs") -> str:
    """CTE of answered user messages: conv_id, turn, user_turn, user_text, reply."""
    return (
        f"{name} AS (SELECT conv_id, turn, user_turn, user_text, reply FROM ("
        "SELECT conv_id, turn, role, text AS reply, "
        "lag(role) OVER w AS prev_role, lag(text) OVER w AS user_text, lag(turn) OVER w AS user_turn "
        f"FROM {source} WHERE role IN ('user', 'assistant') AND trim(text) <> '' "
        "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
        "WHERE role = 'assistant' AND prev_role = 'user')"
    )


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def tags_sql(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def symbols_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s.,!?;:''\"()\\-]', ' ', 'g')"


def collapse_sql(source: str, name: str) -> str:
    """CTEs ending in ``name`` (id, t): words said three or more times in a row kept once."""
    return f"""
    {name}_tok AS (
      SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
      FROM (SELECT id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS toks FROM {source})),
    {name}_mark AS (
      SELECT *, regexp_matches(tok, '^[\\p{{L}}\\p{{N}}_]') AS is_word,
        regexp_full_match(lag(tok, 1) OVER w, '\\s+') AND lower(lag(tok, 2) OVER w) = lower(tok) AS again
      FROM {name}_tok WINDOW w AS (PARTITION BY id ORDER BY i)),
    {name}_run AS (
      SELECT *, sum(CASE WHEN is_word AND NOT coalesce(again, false) THEN 1 ELSE 0 END)
        OVER (PARTITION BY id ORDER BY i) AS run FROM {name}_mark),
    {name}_len AS (
      SELECT *, sum(CASE WHEN is_word THEN 1 ELSE 0 END) OVER (PARTITION BY id, run) AS words FROM {name}_run),
    {name}_drop AS (
      SELECT *, is_word AND coalesce(again, false) AND words >= 3 AS gone FROM {name}_len),
    {name}_keep AS (
      SELECT *, gone OR (NOT is_word AND coalesce(lead(gone) OVER (PARTITION BY id ORDER BY i), false)) AS cut
      FROM {name}_drop),
    {name}_text AS (SELECT id, string_agg(tok, '' ORDER BY i) AS t FROM {name}_keep WHERE NOT cut GROUP BY id),
    {name} AS (SELECT s.id, coalesce(x.t, '') AS t FROM {source} s LEFT JOIN {name}_text x ON s.id = x.id)"""


def aggressive_sql(source: str, name: str) -> str:
    """CTEs ending in ``name`` (id, t): the aggressive clean-up of every text of ``source``."""
    return (
        f"{name}_bare AS (SELECT id, {symbols_sql(tags_sql('t'))} AS t FROM {source}), "
        + collapse_sql(f"{name}_bare", f"{name}_one")
        + f", {name} AS (SELECT id, {squeeze_sql('t')} AS t FROM {name}_one)"
    )
