"""Null ids and nulls in every column: no crash, no row lost."""

import pytest

from parley.llm import exact, packing, pieces, pii, quality, shards, simhash, toxicity

ROWS = [(None, None, None), (None, "one text here", "x"), (None, "one text here", None), (1, None, None), (2, "one text here", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")


def test_rows_of_operators(spark, docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id bigint, toxic int")
    for found in (
        exact.exact_copies(docs),
        simhash.near_copies(docs),
        shards.shard_rows(docs, 40),
        pieces.encode_pieces(docs),
        pieces.decode_pieces(pieces.encode_pieces(docs)),
        pii.find_personal(docs),
        pii.sanitise(docs),
        quality.quality(docs),
        toxicity.toxicity(docs, labels),
    ):
        assert found.count() == len(ROWS)
    assert sum(r["length"] for r in packing.pack(docs).collect()) == 3 * 4 + 2


def test_groups_with_null_ids(docs):
    rows = exact.exact_copies(docs).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows} == {(None, 1, 2), (1, 1, 2), (None, 2, 3), (2, 2, 3)}
    assert sorted(r["doc_id"] for r in exact.drop_exact_copies(docs).collect()) == [1, 2]
    assert {r["component_id"] for r in simhash.near_copies(docs).collect()} == {1, 2}
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == [1, 2]
    alone = docs.where("doc_id is null and text is not null")
    assert exact.drop_exact_copies(alone).count() == 1 and simhash.drop_near_copies(alone).count() == 1
