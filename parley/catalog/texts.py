"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.catalog.base import (
    aggressive_sql,
    collapse_sql,
    query,
    squeeze_sql,
    symbols_sql,
    table,
    tags_sql,
    texts,
)
from parley.functions import text as X


@query("normalize_basic", f"SELECT doc_id, {squeeze_sql('text')} AS clean FROM documents")
def normalize_basic(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", X.normalize_basic(F.col("text")).alias("clean"))


@query("normalize_compatibility", f"SELECT doc_id, {squeeze_sql('text')} AS clean FROM documents")
def normalize_compatibility(spark, sf):
    """Full-width letters, a ligature and a wide space, which NFKC takes back."""
    wide = F.translate("text", "eno ", "\uff45\uff4e\uff4f\u3000")
    dressed = F.replace(wide, F.lit("fi"), F.lit("\ufb01"))
    rows = texts(spark, sf, "documents", "doc_id", "text")
    return rows.select("doc_id", X.normalize_basic(dressed).alias("clean"))


@query("strip_html_tags", f"SELECT page_id, {tags_sql('html')} AS clean FROM pages")
def strip_html_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("clean"))


@query("strip_symbols", f"SELECT doc_id, {symbols_sql('text')} AS clean FROM documents")
def strip_symbols(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", X.strip_symbols(F.col("text")).alias("clean"))


@query(
    "collapse_repeated_words",
    "WITH src AS (SELECT doc_id AS id, text AS t FROM documents), "
    + collapse_sql("src", "one")
    + " SELECT id AS doc_id, t AS clean FROM one",
)
def collapse_repeated_words(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", X.collapse_repeats(F.col("text")).alias("clean"))


@query(
    "normalize_aggressive",
    "WITH src AS (SELECT doc_id AS id, text AS t FROM documents), "
    + aggressive_sql("src", "done")
    + " SELECT id AS doc_id, t AS clean FROM done",
)
def normalize_aggressive(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", X.normalize_aggressive(F.col("text")).alias("clean")
    )


@query(
    "normalize_aggressive_pages",
    "WITH src AS (SELECT page_id AS id, html AS t FROM pages), "
    + aggressive_sql("src", "done")
    + " SELECT id AS page_id, t AS clean FROM done",
)
def normalize_aggressive_pages(spark, sf):
    return texts(spark, sf, "pages", "page_id", "html").select(
        "page_id", X.normalize_aggressive(F.col("html")).alias("clean")
    )


def _slug_sql(kept: str, fallback: bool = True) -> str:
    x = (
        f"trim(regexp_replace(regexp_replace(lower(trim(text, chr(10) || chr(32))), '[^{kept}]+', '_', 'g'), "
        "'_+', '_', 'g'), '_')"
    )
    return f"coalesce(nullif({x}, ''), 'character')" if fallback else x


@query(
    "slugify_names",
    f"SELECT doc_id, {_slug_sql('a-z0-9_')} AS ascii_slug, "
    f"{_slug_sql('\\p{L}\\p{Nd}_')} AS letter_slug, "
    f"{_slug_sql('\\p{L}\\p{M}\\p{N}_', False)} AS any_slug FROM documents",
)
def slugify_names(spark, sf):
    t = F.col("text")
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id",
        X.slug(t).alias("ascii_slug"),
        X.slug(t, "letters").alias("letter_slug"),
        X.slug(t, "alphanumeric").alias("any_slug"),
    )


ATTACH_LIMIT = 500


@query(
    "attachment_blocks",
    f"""
    WITH cut AS (
      SELECT doc_id, source, text,
        list_max(list_filter(range(0, {ATTACH_LIMIT} + 1), lambda n: strlen(left(text, n)) <= {ATTACH_LIMIT})) AS n
      FROM documents),
    head AS (
      SELECT doc_id, source, left(text, n) ||
        CASE WHEN strlen(left(text, n)) < {ATTACH_LIMIT} AND strlen(text) > strlen(left(text, n))
             THEN chr(65533) ELSE '' END AS body FROM cut)
    SELECT doc_id, 'see file' || chr(10) || chr(10) || '[Attachment: ' || source || ']' || chr(10)
      || trim(body, chr(10) || chr(32)) AS message FROM head""",
)
def attachment_blocks(spark, sf):
    block = X.attachment_block(F.col("source"), F.encode("text", "UTF-8"), ATTACH_LIMIT)
    return table(spark, sf, "documents").select(
        "doc_id", X.attach(F.lit("see file \n"), block).alias("message")
    )


STOPS = [". ", " the ", "\n", "</s>"]


def _stop_sql() -> str:
    at = ", ".join(
        "nullif(strpos(text, {}), 0)".format("chr(10)" if s == "\n" else f"'{s}'") for s in STOPS
    )
    return (
        f"SELECT doc_id, CASE WHEN least({at}) IS NULL THEN text "
        f"ELSE left(text, least({at})::BIGINT - 1) END AS reply FROM documents"
    )


@query("cut_at_stop", _stop_sql())
def cut_at_stop(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.cut_at_stop(F.col("text"), STOPS).alias("reply")
    )


@query(
    "salvage_json",
    """
    SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN (props::JSON ->> 'k')::BIGINT END AS k
    FROM events""",
)
def salvage_json(spark, sf):
    kind, props = F.col("event_id") % 4, F.col("props")
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Sure, here it is: "), props, F.lit(" I hope this helps.")))
        .when(kind == 2, F.concat(F.lit("{broken "), props))
        .otherwise("no object here")
    )
    schema = T.StructType([T.StructField("k", T.LongType())])
    return table(spark, sf, "events").select(
        "event_id", X.parse_salvaged(reply, schema)["k"].alias("k")
    )
