"""Token ids of whole Arrow columns, each distinct word encoded once."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parley.llm.shared import ragged_take, words_of

#: Distinct parts of words whose ids a Python worker keeps; the store starts afresh beyond that.
KEPT = 300_000
_JOINED = 20_000

# Fixed value: the splitting pattern of tokenizers whose words can be parted beforehand.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of ASCII (no apostrophe, which contractions need) and Latin-1 letters: composed already.
_PLAIN = r"^[!-&(-~À-ÖØ-öø-ÿ]*$"
_PARTS = r"([^a-z0-9ß-öø-ÿ]+|[0-9])"


class WordEncoder:
    """A ``tokenizers`` file whose pre-tokenizer never joins text across white space.

    Encoding word by word is then the same as encoding the whole text. If the file lower-cases
    and splits by ``PATTERN``, plain words are lower-cased and parted as the pattern does, many
    parts are encoded in one call, and the end-of-word mark in their tokens tells them apart.
    All other words go to the tokenizer one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text cannot hold a special token
        config = json.loads(self.tokenizer.to_str())
        suffix = config["model"].get("end_of_word_suffix")
        self.parts = bool(suffix) and PATTERN in json.dumps(config["pre_tokenizer"]).replace("\\\\", "\\") and (
            '"Lowercase"' in json.dumps(config["normalizer"])
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _learn(self, words: list[str], plain: np.ndarray) -> None:
        """Ids of new words or parts, added to the store."""
        ids, sizes = [self.flat], [self.size]
        simple = [w for w, p in zip(words, plain) if p]
        for start in range(0, len(simple), _JOINED):
            some = simple[start : start + _JOINED]
            found = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ids.append(found)
            sizes.append(np.diff(np.append(0, np.flatnonzero(self.ends[found]) + 1)))
        others = [w for w, p in zip(words, plain) if not p]
        for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        self.flat, self.size = np.concatenate(ids), np.concatenate(sizes)
        for w in simple + others:
            self.place[w] = len(self.place)

    def _places(self, words: pa.Array) -> np.ndarray:
        texts = words.to_pylist()
        plain = np.zeros(len(texts), bool)
        if self.parts and len(texts):
            plain = pc.match_substring_regex(words, r"^[!-&(-~ß-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        if len(self.place) + len(texts) > KEPT:
            self._forget()
        new = [i for i, t in enumerate(texts) if t not in self.place]
        if new:
            self._learn([texts[i] for i in new], plain[new])
        return np.fromiter((self.place[t] for t in texts), np.int64, len(texts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends (from 0)."""
        words, codes, ends = words_of(texts)
        ready = words
        if self.parts and len(words):
            parted = pc.replace_substring_regex(pc.utf8_lower(words), _PARTS, r" \1 ")
            ready = pc.if_else(pc.match_substring_regex(words, _PLAIN), parted, words)
        parts, part_codes, part_ends = words_of(ready)
        places = self._places(parts)[part_codes]
        # ids of the distinct words, then of every word
        size = self.size[places]
        word_ids = self.flat[ragged_take((np.cumsum(self.size) - self.size)[places], size)]
        word_end = np.append(0, np.cumsum(size))[part_ends]
        every = np.diff(word_end)[codes]
        text_ends = np.append(0, np.cumsum(every))[ends]
        return word_ids[ragged_take(word_end[:-1][codes], every)], text_ends


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
