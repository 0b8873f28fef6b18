"""Near duplicates of embeddings: int8 tile products with rigorous error bounds.

A unit vector ``u`` is written as ``s * c + e``: a step ``s``, whole numbers ``c`` from -127 to 127 and
a rest whose length ``r`` is measured. For two vectors the cosine then differs from
``s1 * s2 * (c1 . c2)`` by at most ``r1 + r2 + r1 * r2``. The whole-number products of a tile (one block
of rows against another of the same label) are one matrix product, exact because no partial sum
leaves the 24 bits of a single-precision fraction. A pair whose upper bound is below the threshold
is no link, one whose lower bound reaches it is one; only the pairs in between are computed from
the given vectors in double precision.

Equal vectors are one member with a count. A tile reports, per member, how many vectors it links to
and the smallest member of its part, never its pairs, so what leaves a tile is bounded by its rows
however dense the links are. Blocks hold a bounded number of members: a label with a third of all
rows is many tiles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.components import components
from parley.llm.shared import settled, spread_join, spread_min
from parley.plans.sizes import checked_broadcast

COSINE = 0.93
#: Most members of a block, and most numbers in it.
BLOCK, NUMBERS = 4_096, 1 << 22
#: Sums of so many products of two numbers up to 127 are exact in single precision.
_EXACT = (1 << 24) // (127 * 127)
#: Covers the rounding of double precision in the bounds themselves.
_SLACK = 1e-9
_CHUNK = 512


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square leaves the range of doubles. Cosines stay as they are."""
    _, power = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors, -power[:, None])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, step and length of the rest per row."""
    step = np.abs(unit).max(1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    rest = np.linalg.norm(unit - codes * step[:, None], axis=1)
    return codes, step, rest


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    total = np.zeros((len(left), len(right)))
    for start in range(0, left.shape[1], _EXACT):
        part = slice(start, start + _EXACT)
        total += left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T
    return total


def tile_links(
    left: np.ndarray, right: np.ndarray, least: float, same: bool, counts: dict[str, int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the pairs with cosine ``least`` or more; with ``same`` each pair once."""
    left, right = scaled(left), scaled(right)
    left_size, right_size = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    c1, s1, r1 = quantised(left / left_size[:, None])
    c2, s2, r2 = quantised(right / right_size[:, None])
    for start in range(0, len(left), _CHUNK):
        rows = slice(start, start + _CHUNK)
        about = products(c1[rows], c2) * s1[rows, None] * s2
        bound = r1[rows, None] + r2 + r1[rows, None] * r2 + _SLACK
        a, b = np.nonzero(about + bound >= least)
        sure = about[a, b] - bound[a, b] >= least
        a += start
        if same:
            once = a < b
            a, b, sure = a[once], b[once], sure[once]
        doubt = np.flatnonzero(~sure)
        for some in np.array_split(doubt, len(doubt) // 65_536 + 1):
            x, y = a[some], b[some]
            sure[some] = np.einsum("ij,ij->i", left[x], right[y]) / (left_size[x] * right_size[y]) >= least
        if counts is not None:
            counts["decided"] = counts.get("decided", 0) + len(a) - len(doubt)
            counts["computed"] = counts.get("computed", 0) + len(doubt)
        yield a[sure], b[sure]


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), -1)


def _tile(least: float):
    names = ["member", "root", "links"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        same = key[2].as_py() == key[3].as_py()
        side = rows.column("block").to_numpy() == key[2].as_py()
        member, copies = rows.column("member").to_numpy(), rows.column("copies").to_numpy()
        vectors = _matrix(rows.column("vector"))
        one = np.flatnonzero(side)
        two = one if same else np.flatnonzero(~side)
        links, label = np.zeros(len(member), np.int64), np.arange(len(member))
        # members in rising order, so that the smallest place is the smallest member
        order = np.argsort(member, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        pairs = tile_links(vectors[one], vectors[two], least, same) if len(one) and len(two) else ()
        for a, b in pairs:
            a, b = one[a], two[b]
            links += np.bincount(a, copies[b], len(links)).astype(np.int64)
            links += np.bincount(b, copies[a], len(links)).astype(np.int64)
            a, b = place[a], place[b]
            while (label[a] != label[b]).any():
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
        some = np.flatnonzero(links)
        columns = [member[some], member[order[label[place[some]]]], links[some]]
        return pa.table([pa.array(c) for c in columns], names)

    return run


def _read(rows: DataFrame) -> DataFrame:
    """(row, id, label, size, digest, vector): the digest is null where a vector takes no part."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            rows.schema["id"],
            rows.schema["label"],
            T.StructField("size", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
            rows.schema["vector"],
        ]
    )

    def digest(vector: pa.ListScalar) -> tuple[int, bytes] | tuple[None, None]:
        if not vector.is_valid or not len(vector.values) or vector.values.null_count:
            return None, None
        numbers = vector.values.to_numpy().astype(np.float64) + 0.0  # one zero
        if not np.isfinite(numbers).all() or not numbers.any():
            return None, None
        return len(numbers), hashlib.sha256(numbers.tobytes()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                digest(v) if known.is_valid else (None, None) for v, known in zip(batch.column(3), batch.column(2))
            ]
            columns = [
                *batch.columns[:3],
                pa.array([n for n, _ in found], pa.int32()),
                pa.array([d for _, d in found], pa.binary()),
                batch.column(3),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector").mapInArrow(run, schema)


def linked_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    least: float = COSINE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id (smallest id reachable).

    Vectors link if their labels are equal, their lengths too, and their cosine in double precision
    is at least ``least`` (above 0). Vectors that are null, empty, all zero or hold a null or
    non-finite component, and rows without a label, link with nothing and are components of their
    own. Equal vectors link with each other; repeated rows and ids count as vectors of their own. A
    null id is never the smallest unless all are null. Other columns are not read.
    """
    read = settled(
        _read(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))),
        "vectors",
    )
    sound = read.where("digest is not null")
    key = ["label", "size", "digest"]
    members = settled(
        sound.groupBy(*key, "vector")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .withColumn("member", F.monotonically_increasing_id()),
        "members",
    )
    rows_of = F.least(F.lit(block), F.greatest(F.lit(64), (F.lit(NUMBERS) / F.col("size")).cast("int")))
    blocks = members.groupBy("label", "size").agg(F.count("*").alias("n"))
    blocks = blocks.select("label", "size", F.ceil(F.col("n") / rows_of).cast("int").alias("blocks"))
    dealt = (
        members.join(checked_broadcast(blocks), ["label", "size"])
        .withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "label",
            "size",
            F.least("block", "other").alias("one"),
            F.greatest("block", "other").alias("two"),
            "block",
            "member",
            "copies",
            "vector",
        )
    )
    found = settled(
        dealt.groupBy("label", "size", "one", "two").applyInArrow(_tile(least), "member bigint, root bigint, links bigint"),
        "tiles",
    )
    linked = found.groupBy("member").agg(F.sum("links").alias("links"))
    roots = components(found.where("member > root").select(F.col("member").alias("a"), F.col("root").alias("b")))
    known = (
        members.select(*key, "member", "first", "copies")
        .join(linked, "member", "left")
        .join(roots.withColumnRenamed("node", "member"), "member", "left")
        .select(
            *key,
            "first",
            F.coalesce("root", "member").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    known = spread_min(known, ["root"], "first", "component_id", F.col("digest"))
    table = known.select(*key, "n_links", "component_id")
    linked_rows = spread_join(sound.select("row", "id", *key), table, key, F.col("row"))
    alone = read.where("digest is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked_rows.select("id", "n_links", "component_id").unionByName(alone).withColumnRenamed("id", id_col)
