"""Token ids against the tokenizer on whole texts, and the packed sequences against the contract."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from parley.llm.packing import pack
from parley.llm.tokens import word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_encoder(whole, odd, small):
    texts = [r["text"] for df in (odd, small) for r in df.collect()]
    ids, ends = word_encoder(PATH).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == whole(text)
    assert word_encoder(PATH).encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("name", ["odd", "small"])
@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(request, whole, name, capacity):
    docs = request.getfixturevalue(name).dropDuplicates(["doc_id"])
    pieces, sequences = {}, {}
    for r in pack(docs, capacity=capacity).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in docs.collect():
        want = whole(r["text"]) + [1]
        got = sorted(pieces.pop(r["doc_id"]))
        assert [s for s, _, _ in got] == [sum(len(i) for _, i, _ in got[:k]) for k in range(len(got))]
        assert sum((i for _, i, _ in got), []) == want and {n for _, _, n in got} == {len(want)}
    assert not pieces
    for parts in sequences.values():
        ends = [0]
        for at, n in sorted(parts):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] == capacity or ends[-1] & (ends[-1] - 1) == 0
        assert len({n for _, n in parts}) == 1  # one class to a bin


def test_pack_edges(empty, odd):
    assert pack(empty).count() == 0
    assert pack(odd).columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    with pytest.raises(ValueError):
        pack(odd, capacity=1000)
