"""Queries of sampling, mixing, sharding, splitting and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import fixed
from parley.catalog.base import query, squeeze_sql, symbols_sql, table, texts
from parley.functions import text as X
from parley.functions.tokens import hashed_pieces, pad, tokenize
from parley.operators import sampling as S
from parley.plans.ranks import number_sorted, rank_by_key

KEY = "md5('42-' || doc_id)"


def _docs(spark, sf, *more):
    return table(spark, sf, "documents").select("doc_id", "source", *more)


@query(
    "shuffle_positions",
    f"SELECT doc_id, row_number() OVER (ORDER BY {KEY}) AS position FROM documents",
)
def shuffle_positions(spark, sf):
    docs = S.with_key(_docs(spark, sf).select("doc_id"), "doc_id")
    return rank_by_key(docs, S.KEY, name="position").drop(S.KEY)


@query(
    "shuffle_rows",
    f"SELECT doc_id, source, row_number() OVER (ORDER BY {KEY}) AS position FROM documents",
)
def shuffle_rows(spark, sf):
    return number_sorted(S.shuffle_rows(_docs(spark, sf), "doc_id"), "position")


CAP = 20


@query(
    "cap_per_source",
    f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {KEY}) AS rn "
    f"FROM documents) WHERE rn <= {CAP}",
)
def cap_per_source(spark, sf):
    return S.cap_sources(_docs(spark, sf), "source", "doc_id", rows=CAP)


@query(
    "concatenate_sources",
    "SELECT 'document' AS kind, doc_id AS id, lang, text FROM documents "
    "UNION ALL SELECT 'page', page_id, NULL, html FROM pages "
    "UNION ALL SELECT 'benchmark', item_id, NULL, text FROM benchmark",
)
def concatenate_sources(spark, sf):
    part = lambda name, kind, key, text, *more: table(spark, sf, name).select(
        F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"), *more
    )
    return S.concatenate(
        [
            part("documents", "document", "doc_id", "text", "lang"),
            part("pages", "page", "page_id", "html"),
            part("benchmark", "benchmark", "item_id", "text"),
        ]
    )


# every source feeds a stage, every fourth one two
ROUTES = {
    f"src{i}": [fixed.STAGES[i % 3], *([fixed.STAGES[(i + 1) % 3]] if i % 4 == 3 else [])] for i in range(20)
}
_ROUTE_ROWS = ", ".join(f"('{s}', '{t}')" for s, stages in ROUTES.items() for t in stages)


@query(
    "route_stages",
    f"SELECT doc_id, d.source, stage FROM documents d JOIN (VALUES {_ROUTE_ROWS}) r(source, stage) "
    "ON d.source = r.source",
)
def route_stages(spark, sf):
    return S.route_stages(_docs(spark, sf), "source", ROUTES)


@query(
    "stage_counts",
    f"SELECT stage, d.source, count(*) AS rows FROM documents d JOIN (VALUES {_ROUTE_ROWS}) r(source, stage) "
    "ON d.source = r.source GROUP BY stage, d.source",
)
def stage_counts(spark, sf):
    return S.corpus_counts(S.route_stages(_docs(spark, sf), "source", ROUTES), "stage", "source")


@query(
    "source_counts",
    "SELECT source, lang, count(*) AS rows FROM documents GROUP BY source, lang",
)
def source_counts(spark, sf):
    return S.corpus_counts(_docs(spark, sf, "lang"), "source", "lang")


_SLOT = "row_number() OVER (PARTITION BY source ORDER BY doc_id)"


@query(
    "interleave_sources",
    f"SELECT doc_id, source, slot FROM (SELECT *, {_SLOT} AS slot FROM documents) WHERE n_chars >= 500",
)
def interleave_sources(spark, sf):
    docs = _docs(spark, sf, "n_chars")
    return S.interleave(docs, "source", "doc_id", keep=F.col("n_chars") >= 500).drop("n_chars")


@query(
    "take_per_source",
    f"SELECT doc_id, source, slot FROM (SELECT *, {_SLOT} AS slot FROM documents) WHERE slot <= 7 AND n_chars >= 500",
)
def take_per_source(spark, sf):
    docs = _docs(spark, sf, "n_chars")
    return S.interleave(docs, "source", "doc_id", F.col("n_chars") >= 500, take=7).drop("n_chars")


@query(
    "repeat_epochs",
    "SELECT doc_id, epoch, md5('42-' || epoch || '-' || doc_id) AS epoch_key FROM documents, range(1, 4) r(epoch)",
)
def repeat_epochs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return S.repeat_epochs(docs, 3, "doc_id")


_CLEAN = squeeze_sql(symbols_sql("text"))


@query(
    "worker_shards",
    f"SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS shard "
    f"FROM documents WHERE length({_CLEAN}) >= 300",
)
def worker_shards(spark, sf):
    clean = X.squeeze(X.strip_symbols(F.col("text")))
    valid = texts(spark, sf, "documents", "doc_id", "source", "text").where(F.length(clean) >= 300).select("doc_id", "source")
    return S.assign_shards(valid, "source", "doc_id", 4)


@query(
    "buffer_shuffle",
    f"""
    WITH o AS (SELECT doc_id, {KEY} AS k, (row_number() OVER (ORDER BY doc_id) - 1) // 512 AS b FROM documents)
    SELECT doc_id, b * 512 + row_number() OVER (PARTITION BY b ORDER BY k) AS position FROM o""",
)
def buffer_shuffle(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return S.shuffle_blocks(docs, "doc_id", "doc_id")


def _split_sql(fraction: str) -> str:
    return (
        f"SELECT doc_id, source, CASE WHEN rn <= ceil(n * {fraction}) THEN 'test' ELSE 'train' END AS split FROM "
        f"(SELECT *, row_number() OVER (ORDER BY {KEY}) AS rn, count(*) OVER () AS n FROM documents)"
    )


@query("split_two_percent", _split_sql("0.02"))
def split_two_percent(spark, sf):
    return S.split_rows(_docs(spark, sf), 0.02, "doc_id")


@query("split_ten_percent", _split_sql("0.1"))
def split_ten_percent(spark, sf):
    return S.split_rows(_docs(spark, sf), 0.10, "doc_id")


@query(
    "run_budget",
    f"""
    SELECT doc_id, ((rn - 1) // 16 + 1)::INT AS global_step FROM
      (SELECT doc_id, row_number() OVER (ORDER BY {KEY}) AS rn FROM documents)
    WHERE rn BETWEEN 5 * 16 + 1 AND 805 * 16""",
)
def run_budget(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return S.rows_of_run(docs, "doc_id", start_step=5)


@query(
    "latest_checkpoint",
    "SELECT arg_max(path, step) AS path, max(step) AS step FROM (SELECT path, "
    "TRY_CAST(regexp_extract(path, '(?:^|/)checkpoint-([0-9]+)$', 1) AS BIGINT) AS step FROM "
    "(SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'runs/checkpoint-best' ELSE 'runs/checkpoint-' || o_orderkey END "
    "AS path FROM orders)) WHERE step IS NOT NULL",
)
def latest_checkpoint(spark, sf):
    key = F.col("o_orderkey")
    path = F.when(key % 3 == 0, "runs/checkpoint-best").otherwise(
        F.concat(F.lit("runs/checkpoint-"), key.cast("string"))
    )
    return S.latest_checkpoint(table(spark, sf, "orders").select(path.alias("path")))


LIMIT = 64
_IDS = (
    "SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')[1:"
    f"{LIMIT}], lambda w: ('0x' || substr(md5(w), 1, 7))::INT % 32000) AS ids FROM documents"
)


@query(
    "tokenize_texts",
    f"SELECT doc_id, array_to_string(ids, ' ') AS ids, len(ids) AS n_ids, len(ids) AS n_mask "
    f"FROM ({_IDS}) WHERE len(ids) > 0",
)
def tokenize_texts(spark, sf):
    tokens = tokenize(texts(spark, sf, "documents", "doc_id", "text"), limit=LIMIT)
    return tokens.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
        F.size("input_ids").alias("n_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_mask"),
    )


@query(
    "token_totals",
    "SELECT source, sum(n)::BIGINT AS tokens, max(n) AS longest FROM (SELECT source, least(1024, "
    "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))) AS n FROM documents) "
    "WHERE n > 0 GROUP BY source",
)
def token_totals(spark, sf):
    tokens = tokenize(texts(spark, sf, "documents", "source", "text"), tokenizer=hashed_pieces)
    size = F.size("input_ids")
    return tokens.groupBy("source").agg(F.sum(size).alias("tokens"), F.max(size).alias("longest"))


@query(
    "pad_tokens",
    f"""
    SELECT doc_id, array_to_string(list_concat(ids, list_transform(range({LIMIT} - len(ids)), lambda x: 0)), ' ') AS ids,
      array_to_string(list_concat(list_transform(ids, lambda x: 1),
        list_transform(range({LIMIT} - len(ids)), lambda x: 0)), ' ') AS mask,
      array_to_string(list_concat(ids, list_transform(range({LIMIT} - len(ids)), lambda x: 0)), ' ') AS labels
    FROM ({_IDS}) WHERE len(ids) > 0""",
)
def pad_tokens(spark, sf):
    tokens = pad(tokenize(texts(spark, sf, "documents", "doc_id", "text"), limit=LIMIT), LIMIT)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return tokens.select(
        "doc_id",
        joined("input_ids").alias("ids"),
        joined("attention_mask").alias("mask"),
        joined("labels").alias("labels"),
    )
