import re
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as X

CASES = [
    "a b  c",
    "ﬁne ofﬁce",
    "étude É",
    "👍 ok 👍",
    "<b>bold</b> text <br/>",
    "no No NO way, yes yes",
    "été ÉTÉ été déjà déjà",
    "wait… what",
    "tabs\tand\nlines\x1c end 　",
    "a_b a_b a_b a_b-c",
    "!!! ???",
    "",
    "Ⅷ ① ½ ㎏ ﷺ",
    "x x x x.x x x",
    "İstanbul Straße",
]


def one(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", build(F.col("t"))).orderBy("i").collect()]


def python_clean(text, aggressive):
    text = unicodedata.normalize("NFKC", text)
    if aggressive:
        text = re.sub(r"<[^>]+>", " ", text)
        text = "".join(c if re.match(r"[\w\s.,!?;:'\"()-]", c) else " " for c in text)
        words = re.split(r"(\W+)", text)
        kept, i = [], 0
        while i < len(words):
            run = i
            while (
                run + 2 < len(words)
                and re.fullmatch(r"\s+", words[run + 1])
                and words[run + 2].lower() == words[i].lower()
                and words[i]
            ):
                run += 2
            end = run if (run - i) // 2 >= 2 else i
            kept.append(words[i])
            if end + 1 < len(words):
                kept.append(words[end + 1])
            i = end + 2
        text = "".join(kept)
    return " ".join(text.split())


def test_normalizers(spark):
    assert one(spark, CASES, X.normalize_basic) == [python_clean(c, False) for c in CASES]
    assert one(spark, CASES, X.normalize_aggressive) == [python_clean(c, True) for c in CASES]


def test_arrays_are_normalized_like_texts(spark):
    df = spark.createDataFrame([(CASES,)], "a array<string>")
    got = df.select(X.normalize_aggressive_each(F.col("a"))).first()[0]
    assert got == [python_clean(c, True) for c in CASES]


def test_texts_kept_from_python_are_stable_under_nfkc():
    inside = re.compile(X.NEEDS_NFKC)
    kept = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not inside.match(chr(c))]
    assert len(kept) > 20_000
    assert all(unicodedata.combining(c) == 0 for c in kept)
    assert unicodedata.normalize("NFKC", "".join(kept)) == "".join(kept)
    assert unicodedata.normalize("NFKC", "".join(reversed(kept))) == "".join(reversed(kept))


def test_strip_removes_every_kind_of_space(spark):
    assert one(spark, ["\t  a b  \n\x1f", "\n"], X.strip) == ["a b", ""]


def test_slugs(spark):
    names = ["  Iron Man ", "Zoë--Łukasz  9", "!!!", "a__b_"]
    assert one(spark, names, X.slug) == ["iron_man", "zo_ukasz_9", "character", "a_b"]
    letters = one(spark, names, lambda c: X.slug(c, "letters"))
    assert letters == ["iron_man", "zoë_łukasz_9", "character", "a_b"]
    assert one(spark, names, lambda c: X.slug(c, "alphanumeric"))[2] == ""


def test_stop_cut(spark):
    texts = ["hello</s> you <|user|>", "<|user|>x", "plain", "a\nUser: b</s>"]
    cut = lambda c: X.cut_at_stop(c, ["</s>", "<|user|>", "\nUser:", ""])
    assert one(spark, texts, cut) == ["hello", "", "plain", "a"]
    assert one(spark, texts, lambda c: X.cut_at_stop(c, [])) == texts


def test_attachment(spark):
    body = "é" * 40_000  # 80,000 bytes, cut at an even byte
    odd = "x" + body  # cut inside a character
    df = spark.createDataFrame([("n.txt", bytearray(b.encode()), "hi \n") for b in (body, odd)], "n string, b binary, m string")
    block = X.attachment_block(F.col("n"), F.col("b"))
    got = [r[0] for r in df.select(X.attach(F.col("m"), block)).collect()]
    assert got[0] == "hi\n\n[Attachment: n.txt]\n" + "é" * 32_000
    assert got[1] == "hi\n\n[Attachment: n.txt]\nx" + "é" * 31_999 + "�"
    lone = df.select(X.attach(F.lit("  "), block)).first()[0]
    assert lone.startswith("[Attachment: n.txt]\n")


def test_salvaged_json(spark):
    schema = T.StructType([T.StructField("name", T.StringType())])
    replies = ['```json\n{"name": "Arin"}\n```', 'Sure! {"name": "B", "x": {"y": 1}} done', "none", '{"name": ', "[1]", "}{"]
    got = one(spark, replies, lambda c: X.parse_salvaged(c, schema)["name"])
    assert got == ["Arin", "B", None, None, None, None]
