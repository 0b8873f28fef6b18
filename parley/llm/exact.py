"""Exact duplicates by skew-safe combining.

Copies are first combined inside each map task, then per (digest, salt) and last per digest. A
salt belongs to a map task, so a text that fills a third of the table reaches a combining task
as one row per map task of that salt, and the last one as one row per salt. The whole text is a
key beside the digest at both shuffles, so texts are equal only if their contents are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import ROW_KEY, any_row, ascii_lower, first_of, repeats, settled, with_row_key

SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    normal: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when their ``normal`` forms are; null counts as empty. The row with the
    largest id stays. Of rows that repeat the id as well, one stays. A null id is smaller than
    any other. Other columns of the input are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), normal(F.coalesce(F.col(text_col), F.lit(""))).alias("normal")
    ).withColumn("digest", digest(F.col("normal")))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "normal", "salt")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
    )
    groups = salted.groupBy("digest", "normal").agg(
        F.max("keep_id").alias("keep_id"), F.sum("size").alias("group_size")
    )
    by_digest = settled(
        groups.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count("*").alias("texts"),
        ),
        "exact",
    )
    narrow = rows.select("id", "digest")
    clash = by_digest.where("texts > 1").select("digest")
    if any_row(clash):  # different texts share a digest: those groups are told apart by content again
        sure = narrow.join(by_digest.where("texts = 1").drop("texts"), "digest")
        of_clash = groups.join(clash, "digest", "left_semi")
        marked = sure.unionByName(rows.join(of_clash, ["digest", "normal"]).drop("normal"))
    else:
        marked = narrow.join(by_digest.drop("texts"), "digest")
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    if repeats(docs, id_col):
        marked = marked.withColumn("first", first_of(["digest", "keep_id", "id"]))
        kept = kept & F.col("first")
    return marked.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Where ids repeat or lack, rows are told apart by a key of their own."""
    if repeats(docs, id_col):
        keyed = with_row_key(docs, F.col(id_col).isNotNull(), F.col(id_col))
        stay = exact_copies(keyed, ROW_KEY, text_col).where("kept").select(F.col(f"{ROW_KEY}.row").alias("__stays"))
        return keyed.join(stay, F.col(f"{ROW_KEY}.row") == F.col("__stays"), "left_semi").drop(ROW_KEY)
    stay = exact_copies(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__stays"))
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col("__stays")), "left_semi")
