"""Base patterns against the plain patterns, disclosure shares against brute force, cleaned texts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from parley.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_base_spans_by_plain_patterns(small):
    rng = random.Random(3)
    texts = [r["text"] for r in small.collect()]
    for alphabet in ("a@.-1 ", "12.", "0123456789 -", "+1 ().-x", "é@a.b+12 ,\n"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "x a@b.c@d.e.f y", "1.2.3.4.5.6.7.8", "0001.2.3.255"]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_no_quadratic_patterns():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        pii.base_spans(t)


def brute(docs, prior=pii.PRIOR, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """Spans per (id, text), by counting every pair of an entity and a word over whole documents."""
    term = re.compile(r"[^\W_]+")
    rows, counts = [], Counter()
    for key, text in docs:
        text = text or ""
        spans = plain_spans(text)
        counts.update({m.group().lower() for m in term.finditer(text)})
        taken = [s for some in spans.values() for s in some]
        words = [m.span() for m in term.finditer(text) if not any(m.start() < e and s < m.end() for s, e in taken)]
        held = set()
        for kind, some in spans.items():
            for s, e in some:
                held.add(kind + ":" + (text[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])))
        rows.append((key, spans, held, [(text[s:e].lower(), s, e) for s, e in words]))
    of_entity, joint = Counter(), Counter()
    for _, _, held, words in rows:
        of_entity.update(held)
        joint.update({(e, t) for e in held for t, _, _ in words})
    total, out = len(rows), defaultdict(list)
    for key, spans, held, words in rows:
        extra = []
        for t, a, b in words:
            best = 0.0
            for e in held:
                if of_entity[e] < total:
                    p = of_entity[e] / total
                    given = (joint[e, t] + prior * p) / (counts[t] + prior)
                    best = max(best, math.log2(given / p) / math.log2(1 / p))
            if best >= generalise:
                extra.append(("removed" if best >= remove else "generalised", a, b))
        out[key].append([(k, s, e) for k in pii.KINDS for s, e in spans[k]] + sorted(extra))
    return out


@pytest.fixture(scope="module")
def telling(spark):
    """Names that stand by one address only, common words beside it, a hot address, copies."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = []
    for i in range(60):
        some = " ".join(rng.choice(words) for _ in range(20))
        if i % 6 == 0:
            some += " Writer Smithson mails smith@example.com about gardens " + rng.choice(words)
        if i % 3 == 0:
            some += " call +1 555 123 4567 or 10.0.0.1 office "
        if i % 5 == 0:
            some += " Smithson "
        rows.append((i, some, "x", i))
    rows += [(100, rows[0][1], "x", 1)] * 2 + [(101, None, "x", 1), (None, "", "x", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, row int")


@pytest.mark.parametrize("prior,generalise,remove", [(0.5, 0.75, 0.95), (0.5, 0.3, 0.6), (2.0, 0.5, 0.7), (0.0, 0.9, 1.0)])
def test_disclosure_by_brute_force(telling, prior, generalise, remove):
    want = brute([(r["doc_id"], r["text"]) for r in telling.collect()], prior, generalise, remove)
    got = defaultdict(list)
    for r in pii.find_personal(telling, prior=prior, generalise=generalise, remove=remove).collect():
        got[r["doc_id"]].append([tuple(s) for s in r["spans"]])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {k for spans in want.values() for s in spans for k, _, _ in s} - set(pii.KINDS)


def test_sanitise(telling):
    found = pii.sanitise(telling)
    assert found.columns == telling.columns and found.count() == telling.count()
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    before = {r["doc_id"]: r["text"] for r in telling.collect()}
    assert "smith@example.com" not in texts[0] and "[EMAIL]" in texts[0] and "[IP]" in texts[0]
    assert all(texts[i] == t for i, t in before.items() if t is None or "@" not in t and "+" not in t)


def test_query_by_brute_force(spark, small):
    """The registered query on the given documents, whole texts, with production parameters."""
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()])
    rows = queries.op5_pii_disclosure(spark, SMALL).collect()
    assert len(rows) == len(want)
    for r in rows:
        (spans,) = want[r["doc_id"]]
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        base = [x for x in spans if x[0] in pii.KINDS]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert sum("generalised" in r["spans"] or "removed" in r["spans"] for r in rows) > 3


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_edges(request, name):
    docs = request.getfixturevalue(name).withColumn("digest", F.lit(1))
    assert pii.find_personal(docs).count() == docs.count()
    assert sorted(map(str, pii.sanitise(docs).collect())) == sorted(map(str, docs.collect()))


def test_cleaned_merges_spans():
    assert pii.cleaned("call +1 2345 6789 x", [("phone", 5, 17), ("card", 8, 17)]) == "call [PHONE] x"
    assert pii.cleaned("Anna met bob", [("generalised", 0, 4), ("removed", 9, 12)]) == "[name] met "


def test_telling_words_go_wherever_they_stand(spark):
    """A name far from the address in the same text goes too; in a text without the address it stays."""
    far = " ".join(["filler common words stay"] * 10)
    rows = [(i, f"Zebulon heads this. {far} write Zebulon at zeb@example.com soon. {far} Yours Zebulon") for i in range(3)]
    rows += [(i, f"{far} write at other@example.com soon") for i in range(3, 20)] + [(20, "Zebulon alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, generalise=0.7, remove=0.7).collect()}
    assert all("Zebulon" not in texts[i] for i in range(3)) and texts[20] == "Zebulon alone"


def test_names_far_from_an_address(spark):
    """A name that always stands far before an address tells it, and so do the words of a single letter."""
    far = " ".join(["filler common words stay"] * 40)
    rows = [(i, f"Xu 4417 {far} x@y.org") for i in range(10)] + [(i, f"{far} nothing here") for i in range(10, 100)]
    rows.append((100, f"Mortimer {far} lone@y.org"))
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_personal(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all({("removed", 0, 2), ("removed", 3, 7)} <= set(spans[i]) for i in range(10))
    assert ("generalised", 0, 8) in spans[100] and len(spans[100]) == 2 and not spans[50]


def test_copies_of_one_text(spark):
    """A third of all rows share a text with an address: every copy is sanitised alike, none is lost."""
    rows = [(i, f"Quill wrote from q@z.com to all {i % 7}", "s") for i in range(0, 90)]
    rows += [(None, "Quill wrote from q@z.com to all 3", None)] * 60 + [(1_000 + i, f"plain words {i}", "s") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = pii.sanitise(docs)
    assert found.count() == len(rows)
    want = brute([(i, t) for i, t, _ in rows])
    assert {r["text"] for r in found.where("doc_id is null").collect()} == {pii.cleaned(rows[90][1], want[None][0])}
