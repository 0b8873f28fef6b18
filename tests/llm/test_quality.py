"""Votes, expectation-maximisation, features and scores by plain loops; few words."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from parley.llm import quality

FOLDER = "/root/testdata/sf0.001"
JUNK = ["!!!! #### $$$$ %%%%", "$$$", "BUY BUY BUY BUY", "asdf asdf asdf asdf", "| | |"]
FINE = ["Hello there", "OK thanks", "USA", "ha ha", "one two", "A", "Yes, it is.", "12 34", "No no no, wait"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


def plain_votes(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    mean = lambda values: sum(values) / max(n, 1)
    bare = lambda w: len(regex.sub(r"[^\pL\pN]+", "", w))
    length = mean(len(w) for w in words)
    echo = sum(a == b for a, b in zip(words, words[1:])) / max(n, 1)
    variety = len(set(words)) / max(n, 1) + 0.05 * math.log2(max(n, 128) / 128)
    measured = {
        "symbols": (1 - mean(bare(w) for w in words) / max(length, 1e-9), 0.06, 0.12),
        "shouting": (mean(w.isupper() and len(w) > 1 for w in words), 0.05, 0.25),
        "echoes": (echo, 0.04, 0.12),
        "variety": (-variety, -0.62, -0.45),
        "cells": (mean(bare(w) == 0 for w in words), 0.04, 0.1),
        "word_length": (abs(length - 6), 1.0, 2.0),
        "marks": (mean(bool(regex.search(r"[^\pL\pN\s]{2,}$", w)) for w in words), 0.02, 0.1),
    }
    out = []
    for name in quality.LABELLERS:
        value, fine, low = measured[name]
        if n >= 5:
            out.append(quality.LOW if value >= low else quality.FINE if value <= fine else quality.NOTHING)
        else:
            damped = value * n / (n + 8)
            weak = name in ("symbols", "shouting", "echoes", "cells") and damped >= low
            out.append(quality.LOW if weak else quality.NOTHING)
    return tuple(out), words


def plain_shape(word):
    for pattern, to in ((r"\p{Ll}+|\p{Lo}+", "a"), (r"\p{Lu}{2,}", "AA"), (r"\p{Lu}", "A"), (r"[0-9]+", "0")):
        word = regex.sub(pattern, to, word)
    for mark in "*%$#&!?.,-_=|":
        word = regex.sub(regex.escape(mark) + "{3,}", mark * 2, word)
    return word


def plain_features(text):
    found, words = plain_votes(text)
    bucket = lambda s: zlib.crc32(s.encode()) % quality.BUCKETS
    counts = Counter(bucket(plain_shape(w)) for w in words)
    counts.update(bucket("echo" if i and words[i - 1] == w else "new") for i, w in enumerate(words))
    counts.update(bucket("bare") for w in words if not regex.search(r"[\pL\pN]", w))
    few, voted = len(words) < 5, any(found)
    length = len(words) if few and voted else len(words) + 20
    out = [(b, math.sqrt(c / length)) for b, c in counts.items()]
    return out + ([(bucket("few"), 1.0)] if few and not voted else [])


def plain_em(counts):
    """P(low) and P(vote | class) by plain loops."""
    silent = (quality.NOTHING,) * len(quality.LABELLERS)
    fine = {v: 0.1 if quality.LOW in v else 0.95 for v in counts}
    for _ in range(200):
        total = [0.0, 0.0]
        votes = [[{1: 0.5, 2: 0.5}, {1: 0.5, 2: 0.5}] for _ in quality.LABELLERS]
        for v, n in counts.items():
            for c, p in enumerate((fine[v], 1 - fine[v])):
                if v == silent:
                    continue
                total[c] += p * n
                for i, x in enumerate(v):
                    if x:
                        votes[i][c][x] += p * n
        low = (total[1] + 0.5) / (sum(total) + 1)
        new = {}
        for v in counts:
            p = [math.log(1 - low), math.log(low)]
            for i, x in enumerate(v):
                for c in (0, 1):
                    p[c] += math.log(votes[i][c][x] / sum(votes[i][c].values())) if x else 0.0
            new[v] = 0.9 if v == silent else 1 / (1 + math.exp(min(700, p[1] - p[0])))
        done = max(abs(new[v] - fine[v]) for v in counts) < 1e-9
        fine = new
        if done:
            break
    return low, fine


def test_votes_and_features(docs):
    texts = [r["text"] for r in docs.collect()] + JUNK + FINE + ["", None, "  \n", "ÄÖ ÄÖ ÄÖ"]
    column = pa.array(texts, pa.string())
    got = quality.votes(column)
    assert [tuple(int(x) for x in row) for row in got] == [plain_votes(t)[0] for t in texts]
    rows, buckets, values = quality._features(column)
    for i, text in enumerate(texts):
        here = rows == i
        found = sorted(zip(buckets[here].tolist(), values[here].tolist()))
        want = sorted(plain_features(text))
        assert [b for b, _ in found] == [b for b, _ in want]
        assert np.allclose([x for _, x in found], [x for _, x in want])


def test_scores_of_the_query(docs):
    """Model, scorer and scores of the whole table as plain loops give them."""
    rows = docs.collect()
    counts = Counter(plain_votes(r["text"])[0] for r in rows)
    low, fine = plain_em(counts)
    model, scorer = quality.train(docs)
    assert model.low == pytest.approx(low, abs=1e-6)
    combos = np.array(list(counts))
    assert np.allclose(model.posterior(combos), [fine[v] for v in counts], atol=1e-5)
    scored = {r["doc_id"]: r["quality_score"] for r in quality.quality(docs).collect()}
    for r in rows:
        margin = scorer.bias + sum(scorer.weights[b] * x for b, x in plain_features(r["text"]))
        assert scored[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)


def test_few_words(spark):
    """Short junk goes, other short texts stay."""
    _, scorer = quality.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert (scorer.scores(pa.array(JUNK)) < 0.5).all()
    assert (scorer.scores(pa.array(FINE + [""])) >= 0.5).all()


def test_few_words_go_in_the_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    short = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(JUNK + FINE)], "doc_id bigint, text string")
    left = quality.keep_fine(docs.unionByName(short)).where(F.col("doc_id") < 0).collect()
    assert {r["text"] for r in left} == set(FINE)
