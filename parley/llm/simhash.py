"""Near duplicates by SimHash, found with a hierarchical index over fingerprints in Gray order.

A node of the index is a masked bit pattern that its members share. Two fingerprints with at most
``d`` differing bits agree in one of ``d + 1`` blocks of the bits, so they meet in one of the
``d + 1`` upper nodes (block mask, pattern) of either. A node of more than ``NODE`` members is
divided in the same way by its other bits, so nodes stay small however many fingerprints share a
block. Inside a node the members, sorted by Gray rank, are grouped by sixteens into lower nodes;
a query goes down with the differences counted so far, and a lower node whose pattern brings them
above ``d`` is pruned with everything under it.

Copies of a fingerprint are one member. A node reports its components, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.components import components
from parley.llm.shared import ROW_KEY, any_row, repeats, settled, spread_min, with_row_key

SHINGLE = 3
BITS = 2
HASH_SEED = 42
NODE = 2_048
FAN = 16
_WORDS = 1 << 16
_ALL = (1 << 64) - 1


# -- fingerprints ---------------------------------------------------------------------------------


def _votes(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit set, and how many shingles there are."""
    votes, total = np.zeros(64, np.int64), 0
    for start in range(0, max(1, len(words) - shingle + 1), _WORDS):  # a long text in windows of words
        part = words[start : start + _WORDS + shingle - 1]
        joined = [b" ".join(s) for s in zip(*(part[i:] for i in range(shingle)))] or [b" ".join(part)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in joined), "<u8", len(joined))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
        total += len(joined)
    return votes, total


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    votes, total = _votes(words, shingle)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, code): A-Z lower-cased, words between ASCII white space, joined by spaces; null is empty."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)),
                np.uint64,
                batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "code"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("code", T.LongType())])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


# -- upper nodes ----------------------------------------------------------------------------------


def _blocks(mask: int, bits: int) -> list[int]:
    """Masks that fix one further block each of the bits outside ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(np.array(free), bits + 1)
    return [mask | sum(1 << int(i) for i in part) for part in parts if len(part)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _with_nodes(members: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Members (code, mask) once for every child node of their mask."""
    under = F.create_map(
        *[x for m, below in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)) for b in below]))]
    )
    return members.select("code", F.explode(under[F.col("mask")]).alias("mask")).withColumn(
        "pattern", F.col("code").bitwiseAND(F.col("mask"))
    )


def _gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray order, shifted so that signed numbers sort like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _nodes(codes: DataFrame, bits: int, node: int) -> DataFrame:
    """(code, mask, pattern) of every node with two to ``node`` members."""
    whole, masks = codes.select("code", F.lit(0).cast("bigint").alias("mask")), [0]
    found = None
    while masks:
        below = {m: _blocks(m, bits) for m in masks}
        keyed = _with_nodes(whole, below)
        counts = settled(keyed.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        # every bit fixed: a single code, never two
        fit = keyed.join(counts.where(F.col("n") <= node).drop("n"), ["mask", "pattern"])
        found = fit if found is None else found.unionByName(fit)
        large = counts.where(F.col("n") > node)
        if not any_row(large):
            break
        whole = settled(keyed.join(large.drop("n"), ["mask", "pattern"]).select("code", "mask"), "large")
        masks = sorted({b for under in below.values() for b in under if b != _ALL})
    return found


# -- inside a node --------------------------------------------------------------------------------


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Masks and patterns per level, the codes themselves first, the top last."""
    levels = [(np.full(len(codes), _ALL, np.uint64), codes)]
    while len(levels[-1][0]) > FAN:
        masks, patterns = levels[-1]
        starts = np.arange(0, len(masks), FAN)
        first = np.repeat(patterns[starts], np.diff(np.append(starts, len(masks))))
        shared = np.bitwise_and.reduceat(masks, starts) & ~np.bitwise_or.reduceat(patterns ^ first, starts)
        levels.append((shared, patterns[starts] & shared))
    return levels


def links_in_node(codes: np.ndarray, bits: int = BITS, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (query, other) with at most ``bits`` differing bits, codes in Gray order, by descent."""
    levels = _levels(codes)
    for start in range(0, len(codes), chunk):
        queries = np.arange(start, min(start + chunk, len(codes)))
        top = len(levels[-1][0])
        query, at = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        apart = np.zeros(len(query), np.uint8)
        above = np.zeros(len(query), np.uint64)
        for depth in range(len(levels) - 1, -1, -1):
            masks, patterns = levels[depth]
            # only the bits that the nodes above have not compared yet are added
            apart = apart + np.bitwise_count((codes[query] ^ patterns[at]) & masks[at] & ~above)
            near = apart <= bits
            query, at, apart = query[near], at[near], apart[near]
            if depth:
                above = np.repeat(masks[at], FAN)
                query, apart = np.repeat(query, FAN), np.repeat(apart, FAN)
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                there = at < len(levels[depth - 1][0])
                query, at, apart, above = query[there], at[there], apart[there], above[there]
        yield query, at


def _labels(codes: np.ndarray, bits: int) -> np.ndarray:
    """Smallest place reachable from each code inside the node."""
    label = np.arange(len(codes))
    for a, b in links_in_node(codes, bits):
        while (label[a] != label[b]).any():
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            while (label[label] != label).any():
                label = label[label]
    return label


def _node_links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # members of the last node seen, which may go on in the next batch
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            part = part if left is None else np.concatenate([left, part])
            ends = np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(1)) + 1
            last = int(ends[-1]) if len(ends) else 0
            yield _linked(part[:last], ends[:-1], bits)
            left = part[last:]
        if left is not None:
            yield _linked(left, np.empty(0, np.int64), bits)

    return run


def _linked(part: np.ndarray, cuts: np.ndarray, bits: int) -> pa.RecordBatch:
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for node in np.split(part[:, 2], cuts):
        label = _labels(np.ascontiguousarray(node).view(np.uint64), bits)
        moved = np.flatnonzero(label != np.arange(len(label)))
        a.append(node[moved])
        b.append(node[label[moved]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def code_links(codes: DataFrame, bits: int = BITS, node: int = NODE) -> DataFrame:
    """(a, b): links that connect all distinct ``code`` values at most ``bits`` bits apart, node by node."""
    members = (
        _nodes(codes, bits, node)
        .repartition("mask", "pattern")
        .sortWithinPartitions("mask", "pattern", _gray_rank(F.col("code")))
        .select("mask", "pattern", "code")
    )
    return members.mapInArrow(_node_links(bits), "a bigint, b bigint")


# -- operator -------------------------------------------------------------------------------------


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = SHINGLE,
    bits: int = BITS,
    node: int = NODE,
) -> DataFrame:
    """One row per input row: id, code (signed 64-bit fingerprint), component_id (smallest id reachable).

    Null and wordless texts have fingerprint 0 and link like any other. Null ids are never the
    smallest unless all are null. Repeated rows repeat in the result; other columns are not read.
    """
    rows = settled(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    codes = settled(rows.groupBy("code").agg(F.min("id").alias("first")), "codes")
    linked = components(code_links(codes, bits, node))
    member = codes.join(linked.withColumnRenamed("node", "code"), "code", "left").withColumn(
        "root", F.coalesce("root", "code")
    )
    named = spread_min(member, ["root"], "first", "component_id", F.col("code")).select("code", "component_id")
    return rows.join(named, "code").select(F.col("id").alias(id_col), "code", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The row with the smallest id of every component, with all its columns.

    Where ids repeat or lack, rows are told apart by a key of their own.
    """
    if repeats(docs, id_col):
        keyed = with_row_key(docs, F.col(id_col).isNull(), F.col(id_col))
        found = near_copies(keyed, ROW_KEY, text_col, **how).where(F.col(ROW_KEY) == F.col("component_id"))
        stay = found.select(F.col(f"{ROW_KEY}.row").alias("__stays"))
        return keyed.join(stay, F.col(f"{ROW_KEY}.row") == F.col("__stays"), "left_semi").drop(ROW_KEY)
    stay = (
        near_copies(docs, id_col, text_col, **how)
        .where(F.col(id_col).eqNullSafe(F.col("component_id")))
        .select(F.col(id_col).alias("__stays"))
    )
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col("__stays")), "left_semi")


def hex_code(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))
