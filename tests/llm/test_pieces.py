"""The transducer against the library (merge model), against all paths (unigram weights), and round trips."""

import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from parley.llm.pieces import MARK, Transducer, decode_pieces, encode_pieces, transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts(odd, small):
    rng = random.Random(6)
    made = ["".join(rng.choice(a) for _ in range(30)) for a in ("ab  é\n", "xyz.!#   ", "日本 Ω\t1", "aeth ", "<s>/▁ ") for _ in range(150)]
    return [r["text"] for df in (small, odd) for r in df.collect() if r["text"]] + made


def test_as_the_library(library, texts):
    machine = transducer(PATH)
    for t in texts:
        assert list(machine.encode(t)) == library.encode(t), t[:80]


def test_round_trip(texts):
    machine = transducer(PATH)
    for t in texts:
        assert machine.decode(machine.encode(t)) == t.replace(MARK, " ")


def tiny(pieces, kind):
    proto = ModelProto.FromString(open(PATH, "rb").read())
    kept = [p for p in proto.pieces if p.type != 1]
    del proto.pieces[:]
    proto.pieces.extend(kept)
    for piece, score in pieces.items():
        proto.pieces.add(piece=piece, score=score, type=1)
    proto.trainer_spec.model_type = kind
    return Transducer(proto.SerializeToString())


def test_shortest_path_of_unigram_weights():
    rng = random.Random(8)
    pool = ["".join(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)] + [MARK, MARK + "a", MARK + "ab"]
    for _ in range(20):
        machine = tiny({p: -rng.uniform(1, 9) for p in rng.sample(pool, 9)}, 1)
        for _ in range(20):
            word = MARK + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
            best = min(costs(machine, word))
            ids = machine.path(word)
            assert sum(arc_cost(machine, i) for i in ids) == pytest.approx(best)
            assert b"".join(machine.text[i] for i in ids).decode() == word


def arc_cost(machine, i):
    """A byte carries an equal part of its character's cost (the mark has three bytes, others here one)."""
    if i in machine.cost:
        return machine.cost[i]
    return machine.unknown_cost / (1 if machine.text[i][0] < 128 else 3)


def costs(machine, word):
    """Costs of all ways to part a word."""
    if not word:
        yield 0.0
        return
    for n in range(1, len(word) + 1):
        piece = machine.ids.get(word[:n])
        if piece is not None:
            yield from (machine.cost[piece] + c for c in costs(machine, word[n:]))
        elif n == 1:
            yield from (machine.unknown_cost + c for c in costs(machine, word[1:]))


def test_merge_path_is_the_only_one():
    """Merges made at random: the one finite path is what merging gives."""
    rng = random.Random(9)
    for _ in range(20):
        letters, pieces = list("abc"), {}
        known = list(letters)
        for rank in range(12):
            joined = rng.choice(known) + rng.choice(known)
            if len(joined) < 7 and joined not in known:
                known.append(joined)
                pieces[joined] = -float(rank)
        machine = tiny(pieces | {c: -100.0 - i for i, c in enumerate(letters)}, 2)
        for _ in range(40):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
            assert [machine.text[i].decode() for i in machine.path(word)] == machine.merged(word)


@pytest.mark.parametrize("name", ["odd", "small", "empty"])
def test_tables(request, library, name):
    docs = request.getfixturevalue(name).dropDuplicates(["doc_id"]).drop("ids")
    coded = encode_pieces(docs.withColumn("ids", F.lit("own")))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert coded.columns == ["doc_id", "ids"] and coded.count() == docs.count()
    assert all(r["ids"] == (library.encode(text[r["doc_id"]]) if text[r["doc_id"]] else []) for r in coded.collect())
    assert {r["doc_id"]: r["text"] for r in decode_pieces(coded).collect()} == {k: t or "" for k, t in text.items()}
    nothing = coded.withColumn("ids", F.lit(None).cast("array<int>"))
    assert all(r["text"] == "" for r in decode_pieces(nothing).collect())
