"""Approximate nearest neighbours with learned partitions.

A bounded sample gives an exact neighbour graph; the graph is cut into parts of about equal size
with few edges between them; a small network learns which parts hold a vector's neighbours. Every
row is then put into its most probable part, a query goes to its several most probable parts, and
what is there is ranked by the exact distance. How many parts are asked is chosen on vectors of
the sample that the network was not fitted on.

A large table takes more parts than the sample can teach. Then the parts are themselves divided by
the same method, each on a bounded sample of its own rows, in a task of its own: a query asks some
parts of each part that it is sent to. Parts are divided into blocks of rows and of queries, so a
part that holds a third of all rows is many small tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import repeats, settled

#: Most vectors that graph, parts and network are fitted on.
SAMPLE = 8_192
NEIGHBOURS = 10
#: Recall on the sample's held-out vectors that the number of parts asked must reach.
RECALL = 0.97
ROWS, QUERIES = 8_192, 4_096
#: Sampled vectors for each part that is learned.
PER_PART = 64
_HIDDEN = 64
_DRAWS = 1 << 30


# -- fitting on the sample ------------------------------------------------------------------------


def nearest(base: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places in ``base`` of the k nearest to each query, ``own`` (a place per query) left out."""
    out = np.empty((len(queries), k), np.int64)
    square = (base**2).sum(1)
    for start in range(0, len(queries), 512):
        part = queries[start : start + 512]
        far = square - 2 * part @ base.T
        if own is not None:
            far[np.arange(len(part)), own[start : start + 512]] = np.inf
        out[start : start + 512] = np.argpartition(far, k - 1, 1)[:, :k]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20, slack: float = 1.1) -> np.ndarray:
    """A part per vertex: halves along main directions, then moves along edges that keep parts in size."""
    n = len(vectors)
    part = np.zeros(n, np.int64)
    pieces = [(np.arange(n), 0, parts)]
    while pieces:
        members, first, count = pieces.pop()
        if count == 1:
            part[members] = first
            continue
        centred = vectors[members] - vectors[members].mean(0)
        way = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = members[np.argsort(centred @ way, kind="stable")]
        cut, left = len(order) * (count // 2) // count, count // 2
        pieces += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    most, least = math.ceil(slack * n / parts), math.floor(n / parts / slack)
    size = np.bincount(part, minlength=parts)
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        near = np.bincount(starts * parts + part[ends], minlength=n * parts).reshape(n, parts)
        gain = near - near[np.arange(n), part][:, None]
        best = gain.argmax(1)
        wins = gain[np.arange(n), best]
        moved = 0
        for v in np.argsort(-wins, kind="stable"):
            if wins[v] <= 0:
                break
            a, b = part[v], best[v]
            if size[b] < most and size[a] > least:
                part[v] = b
                size[a] -= 1
                size[b] += 1
                moved += 1
        if moved < n // 1000 + 1:
            break
    return part


@dataclass(frozen=True)
class Router:
    """One hidden layer; gives a probability per part."""

    centre: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    asked: int = 1

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.centre) / self.scale
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(vectors), 1, kind="stable")


def fit_router(vectors: np.ndarray, target: np.ndarray, epochs: int = 60, seed: int = 3) -> Router:
    """Cross-entropy against the shares of parts among a vector's neighbours, with Adam."""
    rng = np.random.default_rng(seed)
    n, d = vectors.shape
    centre, scale = vectors.mean(0), float(vectors.std()) or 1.0
    weights = [
        rng.normal(0, math.sqrt(2 / d), (d, _HIDDEN)),
        np.zeros(_HIDDEN),
        rng.normal(0, math.sqrt(1 / _HIDDEN), (_HIDDEN, target.shape[1])),
        np.zeros(target.shape[1]),
    ]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    data, step = (vectors - centre) / scale, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 128)):
            x = data[rows]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            logits = hidden @ weights[2] + weights[3]
            p = np.exp(logits - logits.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (err @ weights[2].T) * (hidden > 0)
            grads = [x.T @ back, back.sum(0), hidden.T @ err, err.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-5 * weights[i]
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                ahead = mean[i] / (1 - 0.9**step)
                weights[i] = weights[i] - 0.003 * ahead / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Router(centre, scale, *weights)


def learn(vectors: np.ndarray, parts: int, recall: float = RECALL) -> Router:
    """Graph, parts, network, and how many parts to ask for the wanted recall."""
    n = len(vectors)
    k = min(NEIGHBOURS, n - 1)
    if parts <= 1 or k < 1:
        d = vectors.shape[1] if n else 0
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = nearest(vectors, vectors, k, np.arange(n))
    part = balanced_parts(vectors, graph, parts)
    shares = np.zeros((n, parts))
    np.add.at(shares, (np.repeat(np.arange(n), k), part[graph].ravel()), 1.0)
    shares[np.arange(n), part] += 1.0
    shares /= shares.sum(1, keepdims=True)
    held = np.arange(n) % 8 == 0
    router = fit_router(vectors[~held], shares[~held])
    # where the held-out vectors' neighbours come in the order in which their parts would be asked
    home = router.logits(vectors).argmax(1)
    order = router.order(vectors[held])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(order), 0), 1)
    when = np.sort(np.take_along_axis(place, home[graph[held]], 1).ravel())
    asked = int(when[min(len(when) - 1, math.ceil(recall * len(when)) - 1)]) + 1
    return Router(router.centre, router.scale, router.w1, router.b1, router.w2, router.b2, asked)


# -- index and search -----------------------------------------------------------------------------


def usable(vector: Column, size: int) -> Column:
    """Right length, every component a finite number, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _chosen(
    router: Router, vectors: np.ndarray, asked: int, sizes: dict[int, int] | None, least: int, first: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) pairs: the parts asked for each row; further ones until they hold ``least`` rows."""
    order = router.order(vectors)
    take = np.broadcast_to(np.arange(order.shape[1]) < asked, order.shape)
    if sizes is not None:
        filled = np.array([sizes.get(first + p, 0) for p in range(order.shape[1])])[order]
        take = take | (np.cumsum(filled, 1) - filled < least)
    at, which = np.nonzero(take)
    return at, first + order[at, which]


def _routed(rows: DataFrame, router: Router, asked: int, sizes: dict[int, int] | None = None, least: int = 0) -> DataFrame:
    """Rows with ``part``, once for each part asked; further parts until they hold ``least`` rows."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, part = _chosen(router, _matrix(batch.column(1)), asked, sizes, least)
            picked = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(part.astype(np.int32))], schema.names)

    return rows.mapInArrow(run, schema)


def _inner_routers(index: DataFrame, sizes: dict[int, int], inner: int, sample: int, recall: float) -> dict[int, Router]:
    """A router inside every part, fitted on at most ``sample`` of its rows by a task of its own.

    What comes back is one small network per part, in single precision; parts are at most ``sample // PER_PART``.
    """
    draw = F.pmod(F.xxhash64(F.lit("inner"), "id"), F.lit(_DRAWS))
    # a little fewer than may be, so that chance seldom gives more
    shares = [x for p, n in sizes.items() for x in (F.lit(p), F.lit(int(min(1.0, 0.9 * sample / n) * _DRAWS)))]
    if not shares:
        return {}
    drawn = index.withColumn("draw", draw).where(F.col("draw") < F.create_map(*shares)[F.col("part")])

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("draw", "ascending"), ("id", "ascending")]).slice(0, sample)
        vectors = _matrix(rows.column("vector").combine_chunks())
        router = learn(vectors, max(1, min(inner, len(vectors) // PER_PART)), recall)
        small = {f.name: getattr(router, f.name) for f in fields(router)}
        small = {n: v.astype(np.float32) if isinstance(v, np.ndarray) else v for n, v in small.items()}
        return pa.table([rows.column("part").slice(0, 1), pa.array([pickle.dumps(small)], pa.binary())], ["part", "router"])

    fitted = drawn.groupBy("part").applyInArrow(fit, "part int, router binary").collect()
    return {r["part"]: Router(**pickle.loads(r["router"])) for r in fitted}


def _deeper(
    rows: DataFrame, routers: dict[int, Router], inner: int, sizes: dict[int, int] | None = None, least: int = 0
) -> DataFrame:
    """Rows with the parts of their part: the most probable one, or, given ``sizes``, all that are asked."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, vectors = batch.column("part").to_numpy(), _matrix(batch.column("vector"))
            at, leaves = [], []
            for p in np.unique(parts).tolist():
                here = np.flatnonzero(parts == p)
                if p in routers:
                    asked = 1 if sizes is None else routers[p].asked
                    a, leaf = _chosen(routers[p], vectors[here], asked, sizes, least, p * inner)
                    here = here[a]
                else:  # no row of the part was drawn: it stays whole
                    leaf = np.full(len(here), p * inner)
                at.append(here)
                leaves.append(leaf)
            picked = batch.take(pa.array(np.concatenate(at)))
            leaf = pa.array(np.concatenate(leaves).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*picked.columns[:-1], leaf], schema.names)

    return rows.mapInArrow(run, schema)


def _part_sizes(rows: DataFrame) -> dict[int, int]:
    """Rows of every part, one number for each."""
    return {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}


def best_in_tile(ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple:
    """(query, id, distance) of the k nearest rows per query, exact; ties to the smaller id."""
    found = []
    square = (base**2).sum(1)
    for start in range(0, len(queries), 256):
        q, qid = queries[start : start + 256], query_ids[start : start + 256]
        about = square + (q**2).sum(1)[:, None] - 2 * q @ base.T
        about[qid[:, None] == ids[None, :]] = np.inf
        limit = np.partition(about, min(k, len(ids)) - 1, 1)[:, min(k, len(ids)) - 1]
        # the product rounds; whatever may still be among the nearest is measured exactly
        limit = limit + 1e-9 * ((q**2).sum(1) + square.max())
        a, b = np.nonzero((about <= limit[:, None]) & np.isfinite(about))
        exact = np.sqrt(((q[a] - base[b]) ** 2).sum(1))
        order = np.lexsort((ids[b], exact, a))
        a, b, exact = a[order], b[order], exact[order]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        found.append((qid[a[keep]], ids[b[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not left.num_rows or not right.num_rows:
            columns = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            read = lambda t: (t.column("id").to_numpy(), _matrix(t.column("vector").combine_chunks()))
            columns = best_in_tile(*read(left), *read(right), k)
        return pa.table([pa.array(c) for c in columns], names)

    return run


def nearest_rows(
    rows: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = NEIGHBOURS,
    sample: int = SAMPLE,
    parts: int | None = None,
    recall: float = RECALL,
    tile_rows: int = ROWS,
    tile_queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row that ``queries`` picks.

    The score is the Euclidean distance of the given vectors in double precision; ties go to the
    smaller id. Vectors that are null, all zero or hold a null or non-finite component take no
    part, nor do those of another length than the smallest id's, nor rows without an id. A row is
    no candidate for its own id. Of rows that repeat an id, one counts. Ids are integers.

    ``parts`` grow with the root of the table. The sample teaches ``sample // PER_PART`` of them;
    more are learned in two levels, up to the square of that number.
    """
    some = rows.where(F.col(id_col).isNotNull() & (F.size(F.col(vector_col)) > 0))
    size = some.agg(F.min_by(F.size(F.col(vector_col)), F.col(id_col))).first()[0] or 0
    vector = F.col(vector_col).cast("array<double>")
    usable_rows = some.where(usable(F.col(vector_col), size)).select(
        F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"), queries.alias("asks")
    )
    if repeats(usable_rows.select("id"), "id"):
        usable_rows = usable_rows.dropDuplicates(["id"])
    total = usable_rows.count()
    most = max(1, sample // PER_PART)
    if parts is None:
        parts = max(1, min(total // 256, int(math.sqrt(total) / 4)))
    inner = 1 if parts <= most else min(most, math.ceil(math.sqrt(parts)))
    outer = min(most, math.ceil(parts / inner))
    if inner > 1:  # each level may lose a share
        recall = math.sqrt(recall)
    picked = usable_rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    fitted = usable_rows.join(F.broadcast(picked), "id").select("id", "vector").toArrow().sort_by("id")
    router = learn(_matrix(fitted.column("vector").combine_chunks()), outer, recall)

    index = settled(_routed(usable_rows.select("id", "vector"), router, 1), "index")
    sizes = _part_sizes(index)
    asking = usable_rows.where("asks").select("id", "vector")
    routed = settled(_routed(asking, router, router.asked, sizes, k + 1), "queries")
    if inner > 1:
        routers = _inner_routers(index, sizes, inner, sample, recall)
        index = settled(_deeper(index, routers, inner), "index")
        routed = settled(_deeper(routed, routers, inner, _part_sizes(index), k + 1), "queries")

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def blocks(of: DataFrame, rows: int, name: str) -> DataFrame:
        return of.groupBy("part").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    # one row per part, and parts are at most the square of ``sample // PER_PART``
    both = blocks(index, tile_rows, "blocks").join(blocks(routed, tile_queries, "query_blocks"), "part")
    both = F.broadcast(settled(both, "parts"))
    key = ["part", "block", "query_block"]
    left = (
        index.join(both, "part")
        .withColumn("block", block("blocks"))
        .withColumn("query_block", every("query_blocks"))
        .select("id", "vector", *key)
    )
    right = (
        routed.join(both, "part")
        .withColumn("query_block", block("query_blocks"))
        .withColumn("block", every("blocks"))
        .select("id", "vector", *key)
    )
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(k), "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
