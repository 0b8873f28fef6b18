"""Long-term memory: candidates, capacity and nearest-neighbour lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import fixed
from parley.functions.cues import memory_candidate
from parley.functions.vectors import embed
from parley.plans.cells import cells_for
from parley.plans.folds import last_rows
from parley.plans.once import once
from parley.plans.ranks import newest_rows, rank_by_ordinal, running_rows
from parley.plans.sizes import checked_broadcast
from parley.session import cut_lineage

TILE = 8_192
QUERIES = 8_192
#: A tile is no wider than the window of a small store, but for this.
NARROW = 1_024
#: Groups of columns whose least values bound the nearest, and rows measured at a time.
GROUPS, MEASURED = 128, 8_192
#: Decimals of a squared distance that count; equal ones go by age, not by rounding.
SAME = 9
SEQ_BLOCK = 65_536
#: Memories that tiles are gathered around, at most: their vectors come to the driver.
PIVOTS = 256
#: More than the rounding of a distance taken from products, as a share of the lengths.
_ROUNDING = 1e-6


def remember(turns: DataFrame, mem_id: Column, seq: Column, user_id: str = "user_id") -> DataFrame:
    """Memory rows of the turns worth keeping: who said it, when, and with which score."""
    found = once(turns, "__m", memory_candidate(F.col("user"))).where(F.col("__m").isNotNull())
    meta = F.create_map(
        F.lit("character"), F.col("character_id"), F.lit("score"), F.col("__m.score").cast("string")
    )
    return found.select(
        mem_id.alias("mem_id"),
        F.col(user_id).alias("user_id"),
        seq.alias("seq"),
        F.col("__m.text").alias("text"),
        F.col("__m.score").alias("score"),
        meta.alias("meta"),
    )


def keep_capacity(memory: DataFrame, rows: int = fixed.MEMORY_CAPACITY, by: str = "seq") -> DataFrame:
    """The newest ``rows`` memories of all users together; older ones are dropped."""
    return newest_rows(memory, by, rows)


def rebuild_vectors(memory: DataFrame, text: str = "text", into: str = "vec") -> DataFrame:
    return embed(memory.drop(into), text, into)


def _positions(queries: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories with their number in insertion order; queries with the memories before them.

    Both come from one running count over the merged sequence, cut into cells of it.
    """
    kept = ["query_id", "user_id", "vec"]
    asked = queries.select(
        *kept, "seq", F.lit(0).alias("stored"), F.lit(None).cast(memory.schema["mem_id"].dataType).alias("mem_id")
    )
    stored = memory.select(
        F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"),
        "user_id", "vec", "seq", F.lit(1).alias("stored"), "mem_id",
    )
    merged = asked.unionByName(stored)
    merged = cells_for(merged, "seq", SEQ_BLOCK).add(merged, "seq", "__cell")
    counts = merged.groupBy("__cell").agg(F.sum("stored").alias("__rows"))
    # a query at the number of a memory does not see it
    window = Window.partitionBy("__cell").orderBy("seq", "stored").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        merged.withColumn("__inside", F.coalesce(F.sum("stored").over(window), F.lit(0)))
        .join(checked_broadcast(running_rows(counts, (), "__cell")), "__cell")
        .withColumn("pos", F.col("__before") + F.col("__inside"))
        .select(*kept, "mem_id", "stored", "pos")
    )
    # read three times: for the queries, the memories and the size of the query sets
    placed = cut_lineage(placed)
    return (
        placed.where(F.col("stored") == 0).select(*kept, F.col("pos").alias("hi")),
        placed.where(F.col("stored") == 1).select("mem_id", "user_id", "vec", "pos"),
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = np.asarray(rows.flatten(), dtype=np.float64)
    return flat.reshape(len(rows), -1)


def _at_most(rough: np.ndarray, count: int) -> np.ndarray:
    """Per row a number that at least ``count`` of its values do not exceed: of wide rows by the least of groups."""
    exact = lambda rows: np.partition(rows, count - 1, axis=1)[:, count - 1]
    width = rough.shape[1] // GROUPS
    if width < 2 or count > GROUPS // 4:
        return exact(rough)
    least = np.fmin.reduce(rough[:, : width * GROUPS].reshape(len(rough), width, GROUPS), axis=1)
    bound = exact(least)
    rest = ~np.isfinite(bound)
    if rest.any():
        bound[rest] = exact(rough[rest])
    return bound


def _search(left: pa.Table, right: pa.Table, fetch: int, own_first: bool) -> pa.Table:
    """Nearest memories of one tile for one set of queries: at most ``fetch`` per query."""
    q, m = _matrix(left["vec"]), _matrix(right["mem_vec"])
    pos = right["pos"].to_numpy()
    lo, hi = left["lo"].to_numpy(), left["hi"].to_numpy()
    m_users, q_users = right["mem_user"].to_numpy(), left["user_id"].to_numpy()
    m_norm = (m * m).sum(axis=1)
    span = (pos.min(), pos.max()) if len(m) else (0, 0)
    everything = not own_first and bool(((lo <= span[0]) & (hi > span[1])).all())
    rows, hits, dists = [], [], []
    for start in range(0, len(q), 256):
        part = q[start : start + 256]
        # |q - m|^2 without the |q|^2 that is the same for all memories
        rough = part @ m.T
        rough *= -2.0
        rough += m_norm
        ask = np.arange(start, start + len(part))
        if not everything:
            open_ = (pos >= lo[ask, None]) & (pos < hi[ask, None])
            if own_first:
                open_ &= m_users == q_users[ask, None]
            rough[~open_] = np.inf
        # the product rounds; whatever may be among the nearest is measured again
        near = rough <= (_at_most(rough, min(fetch, len(m))) + 10.0 ** (1 - SAME))[:, None]
        i, index = np.nonzero(near if everything else near & open_)
        gap = np.empty(len(i))
        for at in range(0, len(i), MEASURED):
            some = slice(at, at + MEASURED)
            gap[some] = ((m[index[some]] - part[i[some]]) ** 2).sum(axis=1)
        order = np.lexsort((pos[index], np.round(gap, SAME), i))
        i, index, gap = i[order], index[order], gap[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < fetch
        rows.append(ask[i[best]])
        hits.append(index[best])
        dists.append(gap[best])
    if not rows:
        rows, hits, dists = [np.array([], dtype=int)] * 2 + [np.array([], dtype=float)]
    at, hit = np.concatenate(rows), np.concatenate(hits)
    return pa.table(
        {
            "query_id": left["query_id"].take(pa.array(at)),
            "user_id": left["user_id"].take(pa.array(at)),
            "mem_id": right["mem_id"].take(pa.array(hit)),
            "mem_user": right["mem_user"].take(pa.array(hit)),
            "pos": right["pos"].take(pa.array(hit)),
            "distance": np.sqrt(np.concatenate(dists)),
        }
    )


def _pivots(stored: DataFrame, total: int) -> np.ndarray:
    """Memories that others gather around, one per tile and at most ``PIVOTS``.

    Of four times as many, chosen by hash, the next pivot is always the one farthest from all
    pivots before it, so that no heap of memories is left without one.
    """
    count = min(PIVOTS, -(-total // TILE))
    chosen = stored.select("mem_vec", F.xxhash64("mem_id").alias("h")).orderBy("h", "mem_vec").limit(4 * count)
    rows = np.array([r["mem_vec"] for r in chosen.collect()], dtype=np.float64)
    taken, gap = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(taken) < count and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[taken[-1]]) ** 2).sum(axis=1))
    return rows[taken]


def _centred(rows: DataFrame, vec: str, pivots: np.ndarray, every: bool) -> DataFrame:
    """Add ``gaps``, no more than the distances to all pivots, or ``cell`` and ``gap``, no less than that to the nearest."""
    sizes = (pivots * pivots).sum(axis=1)
    largest = float(np.sqrt(sizes.max(initial=0.0)))
    added = "gaps array<double>" if every else "cell bigint, gap double"
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(pa.chunked_array([batch.column(vec)]))
            own = (v * v).sum(axis=1)
            gaps = np.sqrt(np.maximum(own[:, None] + sizes - 2.0 * (v @ pivots.T), 0.0))
            slack = _ROUNDING * (np.sqrt(own) + largest)
            if every:
                low = np.maximum(gaps - slack[:, None], 0.0)
                offsets = pa.array(np.arange(len(v) + 1) * len(pivots), pa.int32())
                more = [pa.ListArray.from_arrays(offsets, pa.array(low.ravel()))]
            else:
                cell = gaps.argmin(axis=1)
                more = [pa.array(cell.astype(np.int64)), pa.array(gaps[np.arange(len(v)), cell] + slack)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return rows.mapInArrow(run, schema)


def _tiled(stored: DataFrame, cell: str) -> DataFrame:
    """Add ``tile``: at most ``TILE`` memories of one cell that follow each other in it."""
    placed = rank_by_ordinal(stored, "pos", [cell], "__rank", SEQ_BLOCK)
    # two tiles of one number are searched as one
    return placed.withColumn("tile", F.xxhash64(cell, F.floor((F.col("__rank") - 1) / TILE))).drop("__rank")


def _spans(tiles: DataFrame, cell: str = "mem_user") -> DataFrame:
    """One row per cell and tile: the numbers it spans, and how far its memories are from the pivot."""
    radius = [F.max("gap").alias("radius")] if "gap" in tiles.columns else []
    return cut_lineage(tiles.groupBy(cell, "tile").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), *radius))


def _reached(met: DataFrame) -> DataFrame:
    """Tiles that hold numbers of the query's range."""
    return met.where((F.col("first") < F.col("hi")) & (F.col("last") >= F.col("lo")))


def _open_tiles(asked: DataFrame, tiles: DataFrame) -> DataFrame:
    """(query_id, tile, gap, bound): nothing of a tile is nearer to the query than ``bound``. No vectors."""
    spans = checked_broadcast(_spans(tiles, "cell"))
    met = asked.select("query_id", "lo", "hi", F.posexplode("gaps").alias("at", "gap"))
    met = _reached(met.join(spans, F.col("at") == F.col("cell")))
    return met.select("query_id", "tile", "gap", F.greatest(F.col("gap") - F.col("radius"), F.lit(0.0)).alias("bound"))


def _may_be_nearer(open_: DataFrame, closest: DataFrame, near: DataFrame, fetch: int) -> DataFrame:
    """(query_id, tile): tiles not searched yet that may change the first ``fetch`` rows of a query."""
    held = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    limit = held.where(F.col("n") >= fetch).select("query_id", (F.col("far") * F.col("far") + 2 * 10.0**-SAME).alias("limit"))
    others = open_.join(closest.withColumnRenamed("tile", "__done"), "query_id").where(F.col("tile") != F.col("__done"))
    nearer = F.col("limit").isNull() | (F.col("bound") * F.col("bound") <= F.col("limit"))
    return others.join(limit, "query_id", "left").where(nearer).select("query_id", "tile").distinct()


def _matched(reach: DataFrame, tiles: DataFrame, fetch: int, own_first: bool, queries: int | None = None) -> DataFrame:
    """The best rows of every query in every tile that it reaches, ``queries`` at a time."""
    sets = reach.groupBy("tile").agg(F.ceil(F.count("*") / (queries or QUERIES)).alias("sets"))
    sets = checked_broadcast(sets)
    reach = reach.join(sets, "tile").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("sets"))).drop("sets")
    dealt = tiles.select("mem_id", "mem_user", "mem_vec", "pos", "tile").join(sets, "tile")
    dealt = dealt.withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sets") - 1))
    ).drop("sets")
    schema = reach.select("query_id", "user_id").schema
    for name in ("mem_id", "mem_user"):
        schema = schema.add(name, tiles.schema[name].dataType)
    schema = schema.add("pos", T.LongType()).add("distance", T.DoubleType())

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, fetch, own_first)

    return (
        reach.groupBy("tile", "part")
        .cogroup(dealt.groupBy("tile", "part"))
        .applyInArrow(search, schema)
    )


def nearest(
    queries: DataFrame,
    memory: DataFrame,
    fetch: int = fixed.RETRIEVE_K * fixed.OVERFETCH,
    *,
    capacity: int | None = None,
    earlier_only: bool = False,
    own_first: bool = False,
) -> DataFrame:
    """Exact L2 neighbours: query_id, user_id, mem_id, mem_user, distance, ``rank``.

    ``queries`` are (query_id, user_id, vec) and, for ``earlier_only``, ``seq``; ``memory`` is
    (mem_id, user_id, seq, vec). A query searches all memories, with ``capacity`` that many of the
    newest, with ``earlier_only`` those there were at its own ``seq``. Equal distances
    (``SAME`` decimals of the square) go to the older memory.

    Memories are cut into tiles and queries into sets; a tile meets a set in one task that returns
    ``fetch`` rows per query, and the rows of all tiles are merged. So no task holds more than a
    tile and a set, and no pair of rows is ever written out. With ``own_first`` a tile holds one
    user's memories and meets only that user's queries; users that are null find nothing. With a
    capacity below all memories and ``earlier_only``, tiles go by insertion number, and a query
    meets those of its window. Else tiles are made of memories near one of at most ``PIVOTS``
    memories; a query first searches the tile it is closest to, and then only those that by the
    triangle inequality may hold something at least as near as the last row found.
    """
    total = memory.count()
    if earlier_only:
        asked, stored = _positions(queries, memory)
    else:
        stored = rank_by_ordinal(memory, "seq", (), "__rank", SEQ_BLOCK).select(
            "mem_id", "user_id", "vec", (F.col("__rank") - 1).alias("pos")
        )
        asked = queries.select("query_id", "user_id", "vec", F.lit(total).cast("bigint").alias("hi"))
    # names of their own: queries and memories may come from one table
    stored = stored.select("mem_id", F.col("user_id").alias("mem_user"), F.col("vec").alias("mem_vec"), "pos")
    lowest = F.lit(0).cast("bigint") if capacity is None else F.greatest(F.col("hi") - capacity, F.lit(0))
    asked = asked.withColumn("lo", lowest).where(F.col("hi") > 0)
    windowed = earlier_only and capacity is not None and capacity < total
    if total <= TILE or (windowed and not own_first):
        # a store smaller than a tile: a query would meet many memories outside its window
        wide = min(TILE, max(NARROW, capacity)) if windowed else TILE
        first, last = F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide)
        reach = asked.withColumn("tile", F.explode(F.sequence(first, last)))
        numbered = stored.withColumn("tile", F.floor(F.col("pos") / wide))
        near = _matched(reach, numbered, fetch, own_first, min(wide, QUERIES))
    elif own_first:
        tiles = cut_lineage(_tiled(stored, "mem_user"))
        reach = _reached(asked.join(checked_broadcast(_spans(tiles)), F.col("user_id") == F.col("mem_user")))
        near = _matched(reach.drop("mem_user", "first", "last"), tiles, fetch, True)
    else:
        if capacity is not None and capacity < total:
            stored = stored.where(F.col("pos") >= total - capacity)
        pivots = _pivots(stored, total if capacity is None else min(total, capacity))
        tiles = cut_lineage(_tiled(_centred(stored, "mem_vec", pivots, False), "cell"))
        asked = cut_lineage(_centred(asked, "vec", pivots, True))
        open_ = _open_tiles(asked, tiles)
        closest = cut_lineage(open_.groupBy("query_id").agg(F.min_by("tile", F.struct("gap", "tile")).alias("tile")))
        asked = asked.drop("gaps")
        near = cut_lineage(_matched(asked.join(closest, "query_id"), tiles, fetch, False))
        rest = cut_lineage(_may_be_nearer(open_, closest, near, fetch))
        near = near.unionByName(_matched(asked.join(rest, "query_id"), tiles, fetch, False))
    merged = Window.partitionBy("query_id").orderBy(F.round(F.col("distance") * F.col("distance"), SAME), "pos")
    return near.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= fetch).drop("pos")


def retrieve(
    queries: DataFrame,
    memory: DataFrame,
    k: int = fixed.RETRIEVE_K,
    *,
    capacity: int | None = None,
    earlier_only: bool = False,
    own_first: bool = False,
) -> DataFrame:
    """The asking user's memories among the nearest ``3 k``, at most ``k``, in ``rank`` order.

    Other users' memories take places in the first step, so fewer than ``k`` may come back;
    ``own_first`` searches the user's memories alone.
    """
    near = nearest(
        queries, memory, k * fixed.OVERFETCH,
        capacity=capacity, earlier_only=earlier_only, own_first=own_first,
    )
    mine = near.where(F.col("mem_user") == F.col("user_id"))
    window = Window.partitionBy("query_id").orderBy("rank")
    return mine.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).drop("rank")


def recalled_texts(hits: DataFrame, memory: DataFrame) -> DataFrame:
    """(query_id, memories): texts of the hits as one array in ``place`` order."""
    texts = hits.join(memory.select("mem_id", "text"), "mem_id")
    ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
    return texts.groupBy("query_id").agg(
        F.transform(ordered, lambda r: r["text"]).alias("memories")
    )


def top_memories(memory: DataFrame, session: str, score: str, created: str, n: int = fixed.TOP_MEMORIES) -> DataFrame:
    """Best scored memories of every session, newer first among equals."""
    return last_rows(memory, [session], [F.desc(score), F.desc(created)], n)


def recent_memories(memory: DataFrame, session: str, created: str, n: int = fixed.TOP_MEMORIES) -> DataFrame:
    """Newest memories of every session."""
    return last_rows(memory, [session], [F.desc(created)], n)
