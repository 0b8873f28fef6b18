"""Personal data: base patterns, and words of the text that disclose them.

Base entities (email, ip, card, phone) are found by patterns. For the other words of a text that
holds an entity the corpus says how much they tell about it: the pointwise mutual information of
word and entity, counted over whole documents, against the entity's own information
IC(entity) = -log2 p(entity). The share PMI / IC is 1 when whoever sees the word knows the entity.
The chance of the entity given the word is smoothed towards p(entity) by ``PRIOR`` documents, so a
word that was seen once with it tells less than one that was seen often and always with it. Words
at or above one threshold are generalised, at or above a second one removed, wherever they stand
in the text. A document without an entity never changes.

What a word tells depends on the set of documents that hold the entity, not on the entity, so
entities of one set are one class. A word in more documents than a class allows at the lower
threshold (an exact bound, met only if all of the class's documents held it) is never paired with it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import salt_of, settled, slices, spread_join

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("generalised", "removed")
#: Documents without the entity that a word is taken to have been seen in besides those counted.
PRIOR = 0.5
GENERALISE, REMOVE = 0.75, 0.95
_COUNTED = 200_000
#: Bytes of text whose words are held at once.
_SLICE = 1 << 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, in one run over the at signs (no start is tried twice)."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind in code points, end exclusive. A match that fails its check is dropped."""
    found = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m.group()))
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m.group())) <= 15:
            found["phone"].append(m.span())
    return found


def free_words(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The words outside every span."""
    taken = sorted(s for kind in spans.values() for s in kind)
    words, at, reach = [], 0, 0
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if m.start() >= reach:
            words.append(m.span())
    return words


def entity_name(kind: str, value: str) -> str:
    """Numbers are the same however they are spaced, addresses however they are cased."""
    return f"{kind}:{''.join(_DIGIT.findall(value)) if kind in ('card', 'phone') else value.lower()}"


def may_hold(text: Column) -> Column:
    """False only for texts in which no base pattern can match."""
    return (
        text.contains("@")
        | text.contains("+")
        | text.rlike(r"[0-9]\.[0-9]")
        | text.rlike(r"[0-9]([ -]?[0-9]){15}")
    )


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)
_WORDS = T.ArrayType(
    T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)


class _Lists:
    """Lists of a string, and two numbers if there are three fields, kept by column while they are gathered."""

    def __init__(self, fields: int) -> None:
        self.values: list[list] = [[] for _ in range(fields)]
        self.ends = [0]

    def add(self, rows: list[tuple]) -> None:
        for column, values in zip(self.values, zip(*rows)):
            column.extend(values)
        self.ends.append(len(self.values[0]))

    def array(self, names: list[str] | None) -> pa.ListArray:
        columns = [pa.array(c, pa.int32() if i else pa.string()) for i, c in enumerate(self.values)]
        flat = pa.StructArray.from_arrays(columns, names) if names else columns[0]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), flat)


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, digest, spans, entities, words) for every row; only texts that may hold an entity go to Python.

    ``words`` are all (term, start, end) outside the spans of a text that holds an entity.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.when(may_hold(F.col("text")), F.col("text")).alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("digest", T.BinaryType()),
            T.StructField("spans", _SPANS),
            T.StructField("entities", T.ArrayType(T.StringType())),
            T.StructField("words", _WORDS),
        ]
    )
    rows = rows.select("row", "id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        spans, entities, words = _Lists(3), _Lists(1), _Lists(3)
        for value in part.column(2):
            text = value.as_py()
            some = base_spans(text) if text else {}
            places = [(k, s, e) for k in KINDS for s, e in some.get(k, ())]
            spans.add(places)
            entities.add(sorted({(entity_name(k, text[s:e]),) for k, s, e in places}))
            words.add([(text[s:e].lower(), s, e) for s, e in free_words(text, some)] if places else [])
        columns = [
            part.column(0),
            part.column(1),
            part.column(3),
            spans.array(["kind", "start", "end"]),
            entities.array(None),
            words.array(["term", "start", "end"]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, _SLICE):
                yield found(part)

    return rows.mapInArrow(run, schema)


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, rows): in how many rows each word stands. Every task adds up what it can before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "rows"]
            )
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if text:
                    counts.update({t.lower() for t in set(_TERM.findall(text))})
                    if len(counts) > _COUNTED:
                        yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "term string, rows bigint").groupBy("term").agg(F.sum("rows").alias("rows"))


def entity_classes(held: DataFrame) -> DataFrame:
    """(row, class, class_rows): the classes of entities of every row; a class is one set of rows."""
    pairs = held.select("row", F.explode("entities").alias("entity"))
    stats = pairs.groupBy("entity").agg(
        F.count("*").alias("class_rows"),
        F.struct(F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b")).alias("class"),
    )
    return spread_join(pairs, stats, ["entity"], F.col("row")).select("row", "class", "class_rows").distinct()


def _limit(total: int, prior: float, share: float) -> Column:
    """In how many rows a word may stand to tell ``share`` of a class, if all rows of the class held it."""
    chance = F.col("class_rows") / F.lit(float(total))
    return (F.col("class_rows") + prior * chance) * F.pow(chance, F.lit(share - 1.0)) - prior


def disclosures(held: DataFrame, terms: DataFrame, total: int, generalise: float, prior: float = PRIOR) -> DataFrame:
    """(row, term, share): the words of every row that tell at least ``generalise`` of one of its entities."""
    # an entity that is everywhere has no information to disclose
    classes = settled(
        entity_classes(held).where(F.col("class_rows") < total).withColumn("most", _limit(total, prior, generalise) + 1e-6),
        "classes",
    )
    most = classes.agg(F.max("most")).first()[0] or 0.0
    words = held.select("row", F.explode(F.array_distinct(F.col("words.term"))).alias("term"))
    counted = spread_join(words, terms.where(F.col("rows") <= most), ["term"], F.col("row"))
    pairs = settled(
        counted.join(classes, "row").where(F.col("rows") <= F.col("most")).select("row", "class", "class_rows", "term", "rows"),
        "pairs",
    )
    joint = pairs.groupBy("class", "class_rows", "term", "rows").agg(F.count("*").alias("n"))
    chance = F.col("class_rows") / F.lit(float(total))
    given = (F.col("n") + prior * chance) / (F.col("rows") + prior)
    share = F.log2(given / chance) / -F.log2(chance)
    telling = joint.select("class", "term", share.alias("share")).where(F.col("share") >= generalise)
    told = spread_join(pairs.select("row", "class", "term"), telling, ["class", "term"], F.col("row"))
    return told.groupBy("row", "term").agg(F.max("share").alias("share"))


def find_personal(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    prior: float = PRIOR,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """One row per input row: id, digest (SHA-256 of a text that may hold an entity, else null), spans.

    ``spans`` are (kind, start, end) by kind (email, ip, card, phone, generalised, removed), then
    start, in code points, end exclusive. A null text is empty. Words are runs of letters and digits
    outside the base spans. Repeated rows count as documents of their own; other columns are not read.
    """
    mentions = settled(_mentions(docs, id_col, text_col), "mentions")
    held = mentions.where(F.size("entities") > 0).select("row", "entities", "words")
    telling = disclosures(held, term_counts(docs, text_col), docs.count(), generalise, prior)
    kind = F.when(F.col("share") >= remove, F.lit("removed")).otherwise(F.lit("generalised")).alias("kind")
    extra = (
        held.select("row", F.inline("words"))
        .join(telling, ["row", "term"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct(kind, "start", "end"))).alias("extra"))
    )
    none = F.array().cast(_SPANS)
    return mentions.join(extra, "row", "left").select(
        F.col("id").alias(id_col), "digest", F.concat("spans", F.coalesce("extra", none)).alias("spans")
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def cleaned(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text without its spans: base kinds by a label, generalised words by their class."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start < at:  # inside or across one that is out already
            at = max(at, end)
            continue
        out.append(text[at:start])
        if kind in KINDS:
            out.append(f"[{kind.upper()}]")
        elif kind == "generalised":
            out.append("[name]" if text[start].isupper() else "[word]")
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows with all their columns, entities and telling words taken out of the text.

    Rows in which no pattern can match are passed on where they are; only the others are joined
    with their spans. Equal texts have equal spans, so these go by digest, dealt out by the other
    columns where many rows share a text.
    """
    found = (
        find_personal(docs, id_col, text_col, **how)
        .where(F.size("spans") > 0)
        .select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans"))
        .dropDuplicates(["__digest"])
    )
    held = F.coalesce(may_hold(F.col(text_col)), F.lit(False))
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, at, 4 * _SLICE)):
            texts = [
                t.as_py() if not s.is_valid else cleaned(t.as_py(), [(x["kind"], x["start"], x["end"]) for x in s.as_py()])
                for t, s in zip(part.column(at), part.column(len(names)))
            ]
            columns = [part.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = [f.name for f in schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != text_col]
    others = [F.col(f"`{c}`") for c in plain]
    keyed = (
        docs.where(held)
        .withColumn("__digest", F.unhex(F.sha2(F.col(text_col), 256)))
        .withColumn("__salt", salt_of(F.struct(*others)) if others else F.lit(0))
    )
    # spans meet the digests and salts that occur, then go with them to the rows
    pairs = keyed.select("__digest", "__salt").distinct().join(found, "__digest")
    marked = keyed.join(pairs, ["__digest", "__salt"], "left").select(*[F.col(f"`{c}`") for c in names], "__spans")
    return docs.where(~held).unionByName(marked.mapInArrow(run, schema))
