"""SentencePiece as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (space to the word mark, a mark put
before a text that is not empty), the piece lexicon (an automaton that gives every piece of an input with its
place, id and cost) with byte fallback (a character that is no piece gives its UTF-8 bytes' ids), and, for merge (BPE)
models, an acceptor of neighbouring pieces: a pair has cost 0 if merging its joined text gives the
pair back, else infinite. A text composed with them is a lattice; its tropical-semiring shortest
path is the encoding. Of a merge model's lattice exactly one path is finite; of a unigram model's
the cheapest one wins, ties to the piece that starts first.

No piece goes across a point where the word mark follows another character, or between two
characters that no piece holds side by side (compiling finds both), so a text is composed part by
part and a worker keeps the paths of frequent words and parts.
"""

from __future__ import annotations

import gc
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import slices

MARK = "▁"
#: Words and piece pairs that a Python worker keeps; each store starts afresh beyond that.
KEPT = 300_000
_LONG = 64
_SLICE = 2 << 20
_UNIGRAM, _MERGES = 1, 2
_NORMAL, _BYTE = 1, 6
_BITS = 24
# Fixed value of the library: an unknown character costs this much more than the dearest piece.
_UNKNOWN = 10.0


class Transducer:
    def __init__(self, model: bytes):
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto.FromString(model)
        rules, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if kind not in (_UNIGRAM, _MERGES) or not proto.trainer_spec.byte_fallback:
            raise ValueError("unigram or merge models with byte fallback are compiled")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the word mark must stand before words")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.merges = kind == _MERGES
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece goes across words")
        scores = {i: proto.pieces[i].score for i in self.ids.values()}
        self.rank = scores
        self.cost = {i: 0.0 if self.merges else -s for i, s in scores.items()}
        self.unknown_cost = 0.0 if self.merges else _UNKNOWN - min(scores.values(), default=0.0)
        self.text = [
            bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.encode() if p.type == _NORMAL else b""
            for p in proto.pieces
        ]
        self.byte_ids = {self.text[i][0]: i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.lexicon = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.lexicon.add_word(piece, (i, len(piece)))
        self.lexicon.make_automaton()
        #: Whether a line end is always a word of its own.
        self.lines = not any("\n" in piece for piece in self.ids if piece != "\n")
        #: Pairs of characters that some piece holds side by side.
        self.joined = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.size = {i: len(piece) for piece, i in self.ids.items()}
        self.symbol = {i: piece for piece, i in self.ids.items()}
        self.letters = {piece for piece in self.ids if len(piece) == 1}
        self.start = len(proto.pieces)  # stands before a part; characters that are no piece get numbers above it
        self.unknown: dict[str, int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    # -- machines ---------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The model's merges: the best-scored neighbours first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.rank.get(self.ids.get(parts[i] + parts[i + 1], -1))
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, left: int, right: int) -> bool:
        """The acceptor: whether merging the joined text of two pieces (or of one after the start) gives them back."""
        known = self.pairs.get(left << _BITS | right)
        if known is None:
            if len(self.pairs) >= 2 * KEPT:
                self.pairs.clear()
            both = ([] if left == self.start else [self.symbol[left]]) + [self.symbol[right]]
            whole = self.ids.get("".join(both)) if len(both) > 1 else None
            if whole is not None and self.neighbours(self.start, whole):
                known = False  # the two would be merged into that piece
            else:
                known = self.merged("".join(both)) == both
            self.pairs[left << _BITS | right] = known
        return known

    # -- composition and shortest path ------------------------------------------------------------

    def path(self, word: str) -> tuple[int, ...]:
        """Ids of the shortest path through one word's lattice, part by part."""
        cuts = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.joined]
        if not cuts and self.letters.issuperset(word):
            return self._shortest(word)  # kept as a word, if at all
        return sum((self._part(word[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)])), ())

    def _shortest(self, part: str) -> tuple[int, ...]:
        """The path through a part: its states in order, the best arc into each."""
        cost: list[float] = [0.0] + [math.inf] * len(part)
        last = [self.start] * (len(part) + 1)
        costs, merges, pairs = self.cost, self.merges, self.pairs
        for end, (piece, size) in self._arcs(part):
            at = end + 1
            start = at - size
            through = cost[start] + costs[piece]
            if through >= cost[at]:
                continue
            if merges:
                fits = pairs.get(last[start] << _BITS | piece)
                if fits is None:
                    fits = self.neighbours(last[start], piece)
                if not fits:
                    continue
            cost[at], last[at] = through, piece
        out: list[int] = []
        at = len(part)
        while at:
            piece = last[at]
            out += [piece] if piece < self.start else [self.byte_ids[b] for b in reversed(part[at - 1].encode())]
            at -= self.size[piece]
        return tuple(reversed(out))

    def _arcs(self, part: str) -> Iterator[tuple[int, tuple[int, int]]]:
        """(last place, (piece, length)) by place, long pieces first; a character that is no piece has an arc too."""
        if self.letters.issuperset(part):
            return self.lexicon.iter(part)
        found = list(self.lexicon.iter(part))
        for i, c in enumerate(part):
            if c not in self.letters:
                number = self.unknown.setdefault(c, self.start + 1 + len(self.unknown))
                self.cost[number], self.size[number], self.symbol[number] = self.unknown_cost, 1, c
                found.append((i, (number, 1)))
        return iter(sorted(found, key=lambda x: (x[0], -x[1][1])))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word behind its mark, the mark left out of ``word``."""
        ids = self.old_words.get(word) or self.path(MARK + word)
        if len(self.words) >= KEPT:  # words seen since the last change stay at hand
            self.words, self.old_words = {}, self.words
        if len(word) <= _LONG:
            self.words[word] = ids
        return ids

    def _part(self, part: str) -> tuple[int, ...]:
        if len(part) == 1 and part not in self.ids:
            return tuple(self.byte_ids[b] for b in part.encode())
        ids = self.parts.get(part)
        if ids is None:
            ids = self._shortest(part)
            if len(self.parts) >= KEPT // 2:
                self.parts.clear()
            if len(part) <= _LONG:
                self.parts[part] = ids
        return ids

    def encode(self, text: str) -> array:
        out = array("I")
        if not text:
            return out
        for i, line in enumerate(text.split("\n") if self.lines else (text,)):
            if i:
                out.extend(self._part("\n"))
            first, *marked = line.split(" ")
            marked = [first, *marked] if self.prefix and not i else marked
            if "" in marked or MARK in line:  # marks in a row make words of their own
                for word in _cut((self.prefix if not i else "") + line.replace(" ", MARK)):
                    out.extend(self.path(word))
                continue
            if first and (i or not self.prefix):
                out.extend(self._part(first) if first in self.parts else self.path(first))
            for word in marked:
                out.extend(self.words.get(word) or self._word(word))
        return out

    def decode(self, ids: array) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")
        return text.removeprefix(self.prefix).replace(MARK, " ")


def _cut(text: str) -> Iterator[str]:
    """Words: each starts where a mark follows another character."""
    run = ""
    first, *others = text.split(MARK)
    if first:
        yield first
    for word in others:
        run += MARK
        if word:
            yield run + word
            run = ""
    if run:
        yield run


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker."""
    with open(path, "rb") as file:
        return Transducer(file.read())


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None) -> DataFrame:
    """One row per input row: id, ids (array<int>). Null and empty texts have no ids; other columns are not read.

    ``model`` is a SentencePiece file that every executor has.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the stores hold many small tuples and no cycles: collecting would walk through them time and again
        gc.disable()
        try:
            yield from encoded(transducer(path), batches)
        finally:
            gc.enable()

    def encoded(machine: Transducer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, _SLICE):
                flat, ends = array("I"), array("i", [0])
                for value in part.column(1):
                    flat.extend(machine.encode(value.as_py() or ""))
                    ends.append(len(flat))
                ids = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, ids)], [id_col, "ids"]
                )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(
        run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    )


def decode_pieces(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, model: str | None = None) -> DataFrame:
    """One row per input row: id, text. Null ids give an empty text; ids of control pieces have no text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [machine.decode(v.values.to_numpy().tolist()) if v.is_valid else "" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("text", T.StringType())])
    return rows.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, schema)
