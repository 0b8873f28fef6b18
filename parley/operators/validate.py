"""Row filters, validation and reject reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.arrays import tail
from parley.functions.render import chat_text
from parley.functions.text import strip
from parley.plans.once import once


def filled_turns(turns: Column) -> Column:
    """Turns with both sides stripped, those with a blank side dropped."""
    trimmed = F.transform(
        turns,
        lambda t: F.struct(
            strip(F.coalesce(t["user"], F.lit(""))).alias("user"),
            strip(F.coalesce(t["assistant"], F.lit(""))).alias("assistant"),
        ),
    )
    return F.filter(trimmed, lambda t: (t["user"] != "") & (t["assistant"] != ""))


def validate_rows(
    rows: DataFrame, max_turns: int = fixed.MAX_TURNS, max_chars: int = fixed.MAX_CHARS
) -> DataFrame:
    """Valid rows of (system, turns, ...), with ``text`` added.

    Blank turns go, the last ``max_turns`` stay, rows without turns go; a text over
    ``max_chars`` becomes a single turn holding its tail.
    """
    system = strip(F.coalesce(F.nullif("system", F.lit("")), F.lit(fixed.CHAT_SYSTEM)))
    kept = once(rows, "turns", tail(filled_turns(F.col("turns")), max_turns)).where(
        F.size("turns") > 0
    )
    first = once(
        kept.withColumn("system", system), "__text", chat_text(F.col("system"), F.col("turns"))
    )
    too_long = F.length("__text") > max_chars
    cut = F.when(
        too_long,
        F.array(
            F.struct(
                F.lit(fixed.TRUNCATED_USER).alias("user"),
                F.right("__text", F.lit(max_chars)).alias("assistant"),
            )
        ),
    )
    framed = first.withColumn("__cut", cut)
    # only the cut rows are rendered again; for the others the turns are null here
    again = chat_text(F.lit(fixed.CHAT_SYSTEM), F.col("__cut"))
    return framed.withColumns(
        {
            "system": F.when(too_long, F.lit(fixed.CHAT_SYSTEM)).otherwise(F.col("system")),
            "turns": F.coalesce("__cut", "turns"),
            "text": F.when(too_long, again).otherwise(F.col("__text")),
        }
    ).drop("__text", "__cut")


def require_rows(df: DataFrame, what: str = "dataset is empty after validation") -> DataFrame:
    """The same rows, or an error when there are none (reads one row)."""
    if df.isEmpty():
        raise ValueError(what)
    return df


def split_rejects(rows: DataFrame, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): rows that could not be parsed or have no known shape, with a reason."""
    no_turns = F.when(F.col("turns").isNull(), F.lit("record of no known shape"))
    reason = no_turns
    if corrupt in rows.columns:
        reason = F.coalesce(F.when(F.col(corrupt).isNotNull(), F.lit("malformed row")), no_turns)
    marked = rows.withColumn("reason", reason)
    where = [c for c in ("path", "row_no", corrupt) if c in rows.columns]
    return (
        marked.where(F.col("reason").isNull()).drop("reason", corrupt),
        marked.where(F.col("reason").isNotNull()).select(*where, "reason"),
    )


def refuse_rejects(rows: DataFrame) -> DataFrame:
    """Strict form: the job fails, naming file and row, at the first row of no known shape."""
    place = [F.col(c).cast("string") for c in ("path", "row_no") if c in rows.columns]
    message = F.concat_ws(":", F.lit("invalid row"), *place)
    checked = F.when(F.col("turns").isNull(), F.raise_error(message)).otherwise(F.col("turns"))
    return rows.withColumn("turns", checked)


def long_texts(df: DataFrame, column: str = "text", n: int = fixed.MIN_TEXT_CHARS) -> DataFrame:
    """Texts of ``n`` characters or more, stripped."""
    return df.withColumn(column, strip(F.col(column))).where(F.length(column) >= n)


def mapped_only(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose mapper gave a text."""
    return df.where(F.col(column) != "")


def curate(logs: DataFrame, min_score: float = fixed.MIN_LOG_SCORE, score: str = "quality_score") -> DataFrame:
    """Log rows of at least ``min_score``; a missing score counts as zero."""
    return logs.where(F.coalesce(F.col(score), F.lit(0.0)) >= min_score)


def missing_fields(required: Sequence[str] = fixed.PROFILE_REQUIRED) -> Column:
    """Names of required columns that are null or blank, in order."""
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))


def valid_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with every required field, all fields stripped."""
    fields = [*fixed.PROFILE_REQUIRED, fixed.PROFILE_OPTIONAL]
    return profiles.where(F.size(missing_fields()) == 0).withColumns(
        {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in fields}
    )


def safe_id(identifier: Column) -> Column:
    """True for an id that names something inside a folder: no empty id, ``.`` or ``..`` part."""
    clean = F.btrim(F.replace(strip(identifier), F.lit("\\"), F.lit("/")), F.lit("/"))
    dots = F.exists(F.split(clean, "/"), lambda part: part.isin(".", ".."))
    return (clean != "") & ~dots


def decode_store_rows(rows: DataFrame, required: Sequence[str], role: str | None = None) -> DataFrame:
    """Rows with all required fields; an unknown role reads as the assistant's."""
    kept = rows.dropna(subset=list(required))
    if role is None:
        return kept
    known = F.col(role).isin("system", "user", "assistant")
    return kept.withColumn(role, F.when(known, F.col(role)).otherwise("assistant"))
