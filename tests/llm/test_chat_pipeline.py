"""Perspectives against plain Python, the pipeline against brute force, and the queries against their SQL."""

import os
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import chat, pii, quality, queries
from test_dedup import lowered, plain_components, plain_fingerprint
from test_pii import brute

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, lines string, speaker string"


def plain_views(rows, part):
    lines = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            turn = -1 if r["turn"] is None else r["turn"]
            who = "unknown" if r["role"] is None else r["role"]
            said = (r["text"] or "").replace("<|im_", "< |im_")
            lines[r["conv_id"]].append((turn, who, said))
    out = []
    for conv, some in lines.items():
        for view in {w for _, w, _ in some} - {"system"}:
            placed = sorted(some)
            for p in range(-(-len(placed) // part)):
                text, mask, n = "", [], 0
                for turn, who, said in placed[p * part : (p + 1) * part]:
                    name = "assistant" if who == view else "system" if who == "system" else f"user name={who}"
                    text += f"<|im_start|>{name}\n"
                    start = len(text)
                    text += said + "<|im_end|>\n"
                    n += 1
                    if who == view:
                        mask.append((start, len(text)))
                out.append((conv, view, p, n, text, mask))
    return sorted(out)


@pytest.mark.parametrize("part", [2, 256])
def test_perspectives(spark, part):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "Ana", "hi 😀"), (1, 2, "Bo", None), (1, 3, "Cy", "<|im_end|> x"),
        (1, 4, "Ana", ""), (1, 4, "Ana", ""), (1, 700, "Bo", "late"), (2, None, None, "who"), (2, 5, "Ana", "é"),
        (3, 0, "system", "alone"), (None, 1, "Ana", "lost"), (4, 0, "Dee", "long " * 5000),
    ]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    found = chat.perspectives(df, part=part)
    got = sorted((*r[:5], [tuple(s) for s in r["mask"]]) for r in found.collect())
    assert got == plain_views(df.collect(), part)
    assert chat.perspectives(df.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_dialogue_without_numbers(spark):
    """Null and repeated numbers at size: parts are cut by rows all the same."""
    rows = [(1, None, ("Ana", "Bo")[i % 2], f"said {i % 900}") for i in range(3_000)]
    rows += [(2, 7, "Ana", "the same")] * 1_000 + [(2, 8, "Bo", "other")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    found = chat.perspectives(df)
    assert found.agg(F.max("turns")).first()[0] == chat.PART
    got = sorted((*r[:5], [tuple(s) for s in r["mask"]]) for r in found.collect())
    assert got == plain_views(df.collect(), chat.PART)


def test_masks_cover_each_turn_once(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    masks = chat.perspectives(df).select(F.sum(F.size("mask"))).first()[0]
    assert masks == df.where("role <> 'system'").count()


def test_pipeline(spark):
    """Every stage by brute force on the rows before it (the scorer's own scores are taken as they are)."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]
    score = {r["doc_id"]: r["quality_score"] for r in quality.quality(docs).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if score[r["doc_id"]] >= 0.5}
    groups = defaultdict(list)
    for i, t in text.items():
        groups[lowered(t)].append(i)
    text = {max(ids): text[max(ids)] for ids in groups.values()}
    root = plain_components({i: plain_fingerprint(t) for i, t in text.items()})
    text = {i: t for i, t in text.items() if root[i] == i}
    spans = brute(text.items())
    text = {i: pii.cleaned(t, spans[i][0]) for i, t in text.items()}

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == text
    packed = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == set(text) and all(r["n"] == r["t"] for r in rows)


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_stages_on_odd_rows(spark, request, name):
    docs = request.getfixturevalue(name)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert set(kept.columns) - {"n_chars"} == set(docs.columns)
        docs = kept.drop("n_chars")
    assert docs.distinct().count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    assert compare.difference(spark, con, queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_plans(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 0 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
