"""Periodic runs against a search of every period, on words, on texts and on the query's planted tails."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from parley.llm import queries
from parley.llm.periods import runs, squares, stretches, word_runs


def brute_runs(words, least):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            some = words[i : i + length]
            smaller = any(all(some[k] == some[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 2, 3, 4])) for _ in range(rng.randrange(60))]
    if words and rng.random() < 0.5:
        a, p = rng.randrange(len(words)), rng.randrange(1, len(words) + 1)
        words = [w if i < a else words[min(len(words) - 1, a + (i - a) % p)] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_by_brute_force(least):
    rng = random.Random(least)
    for _ in range(400):
        words = odd_words(rng)
        want = brute_runs(words, least)
        assert runs(words, least) == want
        # narrowing to stretches loses no run and no end of one
        got = []
        for start, stop in zip(*stretches(np.array(words, np.int64), np.array([0, len(words)]), least)):
            got += [(int(start) + s, n, q) for s, n, q in runs(words[start:stop], least)]
        assert sorted(got, key=lambda r: (r[0], r[2])) == want


def test_squares_have_primitive_roots():
    words = [0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1]
    want = {(i, q) for i in range(12) for q in range(1, 7) if i + 1 >= 2 * q and words[i - 2 * q + 1 : i - q + 1] == words[i - q + 1 : i + 1]}
    want -= {(i, 6) for i in range(12)}  # a root of six words here is three words twice
    assert set(squares(words)) == want


def test_stretches_end_with_their_text():
    """A repeat across two texts is none; the last words of one and the first of the next do not meet."""
    codes = np.array([7] * 9 + [7] * 9, np.int64)
    assert [len(x) for x in stretches(codes, np.array([0, 9, 18]))] == [0, 0]
    assert [x.tolist() for x in stretches(codes, np.array([0, 18]))] == [[0], [18]]


def expected(text, least=12):
    words = (text or "").encode().split()
    found = brute_runs(words, least)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(words), found, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_texts_by_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join("abcd"[w] for w in odd_words(rng)) for _ in range(200)]
    texts += [None, "", " \n ", "x " * 12, "x " * 11, "\x0bä b\x0c" * 6, "a\x1cb " * 12, "a b " * 12, "so it goes " * 2_000]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, runs string, id int")
    docs = docs.unionByName(docs.where("doc_id > 205"))
    rows = word_runs(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, found, left = expected(texts[r["doc_id"]]) if r["doc_id"] != 208 else (6000, [(0, 6000, 3)], "so it goes")
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (n, found, left)


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_edges(request, name):
    docs = request.getfixturevalue(name)
    rows = word_runs(docs).collect()
    assert len(rows) == docs.count()
    assert [tuple(r["runs"][0]) for r in rows if r["n_words"] == 30_000] == [(0, 30_000, 1)] * (name == "odd")


def planted(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(150, None), (151, " \t"), (None, "same " * 20), (152, "same " * 20), (152, "same " * 20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    want, with_runs = set(), 0
    for doc_id, text in rows:
        words = planted(doc_id, text) if doc_id is not None else text.encode().split()
        found = brute_runs(words, 12)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        sha = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), left)]
        want.add((doc_id, len(found), s, n, q, 1000 * n // q if found else None, *sha))
        with_runs += bool(found)
    assert got == want and with_runs > 5
