"""The registered queries of the operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parley.catalog.base import Query, table
from parley.llm import chat, exact, linked, neighbours, packing, periods, pieces, pii, quality, shards, simhash, spectrum, toxicity
from parley.plans.once import once

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_harmonic_packing")
def op1_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op2_piece_transducer")
def op2_piece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(F.struct("doc_id", F.xxhash64(text).alias("text")).alias("row"), "text")
    coded = pieces.encode_pieces(docs, "row")
    key = F.struct("row.*", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"))
    back = pieces.decode_pieces(coded.select(key.alias("row"), "ids"), "row")
    return back.select(
        "row.doc_id", "row.n_pieces", "row.ids_hash", (F.xxhash64("text") == F.col("row.text")).alias("round_trip")
    )


@query("op3_simhash_gray")
def op3_simhash_gray(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_code(F.col("code")).alias("fingerprint"), "component_id")


@query("op4_weak_label_quality")
def op4_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.quality(table(spark, folder, "documents"))
    return scored.select(
        "doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted")
    )


@query("op5_pii_disclosure")
def op5_pii_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal(table(spark, folder, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.spans_text(of(*pii.KINDS)), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


@query("op6_learned_partitions")
def op6_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_rows(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_jump_shards")
def op7_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = shards.shard_rows(table(spark, folder, "documents"), 40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op8_exact_salted",
    f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, {_LOWERED} AS t FROM documents) WINDOW same AS (PARTITION BY t)
    """,
)
def op8_exact_salted(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact.exact_copies(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


_HEAD = (
    "'<|im_start|>' || CASE WHEN l.who = s.speaker THEN 'assistant' WHEN l.who = 'system' THEN 'system' "
    "ELSE 'user name=' || l.who END || chr(10)"
)


@query(
    "op9_perspectives",
    f"""
    WITH lines AS (
      SELECT conv_id, coalesce(turn, -1) AS place, replace(coalesce(role, 'unknown'), '<|im_', '< |im_') AS who,
        replace(coalesce(text, ''), '<|im_', '< |im_') AS said
      FROM conversations WHERE conv_id IS NOT NULL),
    speakers AS (SELECT DISTINCT conv_id, who AS speaker FROM lines WHERE who <> 'system'),
    cut AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY place, who, said) - 1) // {chat.PART} AS part FROM lines),
    seg AS (
      SELECT l.conv_id, s.speaker, l.part, l.place, l.who, l.said,
        {_HEAD} AS head, l.said || '<|im_end|>' || chr(10) AS body
      FROM cut l JOIN speakers s ON l.conv_id = s.conv_id),
    placed AS (
      SELECT *, sum(length(head) + length(body)) OVER (
        PARTITION BY conv_id, speaker, part ORDER BY place, who, said ROWS UNBOUNDED PRECEDING) AS upto FROM seg)
    SELECT conv_id, speaker, part, CAST(count(*) AS INTEGER) AS turns,
      string_agg(head || body, '' ORDER BY place, who, said) AS text,
      coalesce(string_agg(CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ','
        ORDER BY place, who, said) FILTER (WHERE who = speaker), '') AS mask
    FROM placed GROUP BY conv_id, speaker, part
    """,
)
def op9_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.perspectives(table(spark, folder, "conversations"))
    return views.withColumn("mask", chat.mask_text(F.col("mask")))


@query("op10_factorization_toxicity")
def op10_factorization_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a hash of its id, with a periodic tail; the others as they are."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(hashed / 10).alias("g"), (hashed % 10 == 0).alias("chosen"))
    rows = once(rows, "words", F.when(F.col("chosen"), words))
    n = F.size("words")
    rows = rows.withColumn("a", F.expr("cast(if(size(words) > 0, g % size(words), 0) as int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)"))
    tail = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))),
    )
    return rows.select("doc_id", F.when(F.col("chosen") & (n > 0), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.word_runs(planted(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


@query("op12_linked_embeddings")
def op12_linked_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    found = linked.linked_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op13_whitened_embeddings")
def op13_whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spectrum.whiten(table(spark, folder, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
