"""Profiles, turn scripts, logs, run records and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import fixed
from parley.functions.text import attachment_block, strip
from parley.plans.folds import carry, measure
from parley.plans.sizes import checked_broadcast
from parley.session import cut_lineage
from parley.sources.files import read_lines, with_line_numbers

LOG = "ts timestamp, user_id string, character string, user string, assistant string, quality_score double"


#: Between two profiles of one file.
DOCUMENT_END = "\n---\n"


def read_profiles(spark: SparkSession, folder: str, many: bool = False) -> DataFrame:
    """Profile table from flat ``key: value`` files; ``id`` is the path below ``folder`` without ending.

    With ``many`` a file holds any number of profiles between lines of ``---``, is read in splits, and
    ``id`` goes on with ``#`` and the profile's name.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,yml}")
    found = reader.text(folder, lineSep=DOCUMENT_END) if many else reader.text(folder, wholetext=True)
    files = found.select("value", F.col("_metadata.file_path").alias("path"))
    if many:
        files = files.where(strip(F.col("value")) != "")

    def value(key: str) -> Column:
        line = F.regexp_extract("value", rf"(?m)^{key}:[ \t]*(.*)$", 1)
        return F.regexp_replace(strip(line), "^([\"'])(.*)\\1$", "$2").alias(key)

    below = F.regexp_extract("path", r"^.*?" + _quoted(folder.rstrip("/").rsplit("/", 1)[-1]) + r"/(.+)\.ya?ml$", 1)
    named = F.concat_ws("#", below, F.nullif(value("name"), F.lit(""))) if many else below
    return files.select(
        named.alias("id"), *[value(k) for k in [*fixed.PROFILE_REQUIRED, fixed.PROFILE_OPTIONAL]]
    )


def _quoted(name: str) -> str:
    return rf"\Q{name}\E"


#: Begins the line with a script's name.
SCRIPT_NAME = "--- "


def _named_scripts(lines: DataFrame) -> DataFrame:
    """(path, row_no, value): lines counted in their script, the name behind the path; the lines of names go."""
    order = measure(lines, ["path"], "row_no")
    is_name = F.startswith("value", F.lit(SCRIPT_NAME))
    name = F.concat(F.col("path"), F.lit("#"), strip(F.substring("value", len(SCRIPT_NAME) + 1, 1 << 30)))
    held = carry(lines, order, {"__in": F.when(is_name, F.struct(name.alias("name"), F.col("row_no").alias("at")))})
    path, at = F.coalesce("__in.name", "path"), F.coalesce("__in.at", F.lit(0))
    return held.where(~is_name).select(path.alias("path"), (F.col("row_no") - at).alias("row_no"), "value")


def read_turn_scripts(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """(path, turn, user) of scripted user turns.

    A file is a JSON list of texts, or one JSON text or object with ``user`` or ``text`` a line; its
    first sign that is no blank tells which. Files of lines are read by line and numbered by file
    split, so a script of any length is many tasks; a list is put together from its own lines. With ``many`` a file holds any number of scripts, each
    behind a line of ``---`` and its name, which ``path`` then ends with after ``#``.
    """
    texts = T.ArrayType(T.StringType())
    # read many times below, and opening a small file costs more than its lines
    found = cut_lineage(read_lines(spark, path).where(strip(F.col("value")) != ""))
    lines = with_line_numbers(found).select("path", "row_no", "value")
    if many:
        lines = _named_scripts(cut_lineage(lines))
    opening = F.substring(F.ltrim(strip(F.col("value"))), 1, 1)
    forms = lines.where(F.col("row_no") == 1).select("path", (opening == "[").alias("is_list"))
    told = lines.join(checked_broadcast(forms), "path")
    body = strip(F.col("value"))
    plain = F.get(F.from_json(F.concat(F.lit("["), body, F.lit("]")), texts), F.lit(0))
    key = lambda k: F.nullif(F.get_json_object(body, f"$.{k}"), F.lit(""))
    said = F.when(F.startswith(body, F.lit('"')), plain).otherwise(F.coalesce(key("user"), key("text")))
    wrong = F.raise_error(F.concat(F.lit("invalid turn line: "), body)).cast("string")
    by_line = told.where(~F.col("is_list")).select("path", F.col("row_no").alias("turn"), F.coalesce(said, wrong).alias("user"))
    whole = told.where("is_list").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row_no", "value"))).alias("rows"))
    listed = F.from_json(F.array_join(F.transform("rows", lambda r: r["value"]), "\n"), texts, {"mode": "FAILFAST"})
    of_lists = whole.select("path", F.posexplode(listed).alias("__i", "user"))
    return by_line.unionByName(of_lists.select("path", (F.col("__i") + 1).cast("bigint").alias("turn"), "user"))


def run_records(
    turns: DataFrame, session: str, meta: Column, by: str = "turn", turns_per_record: int = 1_000
) -> DataFrame:
    """Records (meta, part, turns) of replayed sessions.

    A session longer than ``turns_per_record`` turns goes on in the next part, so a record stays
    small whatever the session holds.
    """
    part = F.floor((F.col(by) - 1) / turns_per_record)
    item = F.struct(F.col(by).alias("turn"), "user", "assistant")
    grouped = turns.withColumn("__meta", meta).groupBy(session, part.alias("part"))
    return grouped.agg(
        F.first("__meta").alias("meta"), F.array_sort(F.collect_list(item)).alias("turns")
    )


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines (chat logs, run records)."""
    rows.write.mode("append").json(path)


def log_rows(turns: DataFrame, score: Column, now: Column | None = None) -> DataFrame:
    """Chat-log rows of turns with ``user_id``, ``character_id``, ``user`` and ``assistant``."""
    return turns.select(
        (F.current_timestamp() if now is None else now).alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("character_id").alias("character"),
        "user",
        "assistant",
        score.cast("double").alias("quality_score"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def read_attachments(spark: SparkSession, path: str, limit: int = fixed.ATTACHMENT_BYTES) -> DataFrame:
    """(path, name, block) of files to attach."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("name"), attachment_block(name, F.col("content"), limit).alias("block"))
