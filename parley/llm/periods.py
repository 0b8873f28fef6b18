"""Periodic runs of words, found with a suffix automaton under link-cut access.

Words are appended one by one to a suffix automaton. In the tree of its suffix links every node is
coloured with the place where its strings ended last; a link-cut forest keeps each stretch of one
colour on a path to the root as one splay tree. An appended word recolours the whole path of the
new prefix. Each stretch that it meets holds the strings of some lengths (low, high], all of which
ended before at the stretch's colour ``j`` and end now at ``i``; if the distance ``i - j`` is one
of these lengths, a square with that primitive root ends at ``i``. Squares of one root length that
end at neighbouring places are one run, whose ends are therefore the maximal ones.

A run of at least ``least`` words, twice its period or more, repeats some ``least / 2`` words in a
row at the distance of its period. Words that no such repeat covers are in no run, so they never
reach the automaton: what is left are separate stretches of a text, each found in whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import slices, words_of

#: Fewest words of a run.
LEAST = 12
#: Rounds in which stretches are narrowed by repeats inside themselves.
_ROUNDS = 3
#: Bytes of text whose words are numbered at once.
_SLICE = 4 << 20


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(end, root length) of every square with a primitive root, by place of its last word."""
    step: list[dict[int, int]] = [{}, {}]  # node 0 is none, node 1 the empty string
    link, size = [0, 0], [0, 0]
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def node(length: int, steps: dict[int, int], suffix: int) -> int:
        step.append(steps)
        link.append(suffix)
        size.append(length)
        left.append(0)
        right.append(0)
        up.append(suffix)
        colour.append(-1)
        return len(step) - 1

    def raise_over(x: int, p: int) -> None:
        """One rotation. The colour of a stretch is that of its top, so it moves along."""
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g
        colour[x] = colour[p]

    def splay(x: int) -> None:
        while (p := up[x]) and (left[p] == x or right[p] == x):
            if (g := up[p]) and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    raise_over(p, g)
                    raise_over(x, p)
                else:
                    raise_over(x, p)
                    raise_over(x, g)
            else:
                raise_over(x, p)

    last = 1
    for i, word in enumerate(words):
        new = node(i + 1, {}, 0)
        p = last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        last = new
        if not p:
            suffix = 1
        else:
            suffix = step[p][word]
            if size[p] + 1 != size[suffix]:
                whole = suffix
                suffix = node(size[p] + 1, step[whole].copy(), link[whole])
                while p and step[p].get(word) == whole:
                    step[p][word] = suffix
                    p = link[p]
                link[whole] = suffix
                # the shorter strings split off stand right above, in the same stretch of colour
                splay(whole)
                above = left[suffix] = left[whole]
                if above:
                    up[above] = suffix
                left[whole], up[suffix] = suffix, whole
        link[new] = up[new] = suffix
        below, at = new, suffix
        while at:
            splay(at)
            far, high, before = i - colour[at], size[at], up[at]
            if size[before] < far <= high:
                yield i, far
            if right[at]:
                colour[right[at]] = colour[at]
            right[at] = below
            below, at = at, before
        colour[below] = i


def runs(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found, going = [], {}  # root length -> first and last end of the squares of a run

    def close(far: int, first: int, end: int) -> None:
        start = first - 2 * far + 1
        if end - start + 1 >= least:
            found.append((start, end - start + 1, far))

    for i, far in squares(words):
        span = going.get(far)
        if span and span[1] == i - 1:
            span[1] = i
        else:
            if span:
                close(far, *span)
            going[far] = [i, i]
    for far, span in going.items():
        close(far, *span)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold runs, none across the ends of a text.

    A word in a run lies in a block of ``least // 2`` words that stands again in the same run, at most
    half the run away. Blocks are compared by a hash; one that collides only keeps a word too many.
    """
    wide = max(1, least // 2)
    starts, stops = ends[:-1], ends[1:]
    for _ in range(_ROUNDS):
        whole = stops - starts >= least
        starts, stops = starts[whole], stops[whole]
        if not len(starts):
            break
        sizes = stops - starts
        blocks = sizes - wide + 1
        own = np.repeat(np.arange(len(starts), dtype=np.uint64), blocks)
        first = np.cumsum(blocks) - blocks
        place = np.repeat(starts - first, blocks) + np.arange(int(blocks.sum()))
        key = own * np.uint64(0x9E3779B97F4A7C15)
        for k in range(wide):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[place + k].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        one, two = order[again], order[again + 1]
        near = place[two] - place[one] <= np.repeat(sizes // 2, blocks)[one]
        # how many marked blocks begin or end at each word; a stretch is where some block is open
        marked = np.unique(np.concatenate([one[near], two[near]]))
        if not len(marked):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, group = place[marked], own[marked]
        cut = np.flatnonzero((at[1:] > at[:-1] + wide) | (group[1:] != group[:-1])) + 1
        starts = at[np.append(0, cut)]
        stops = at[np.append(cut, len(at)) - 1] + wide
    whole = stops - starts >= least
    return starts[whole], stops[whole]


_RUN = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
)


def _found(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    words, codes, ends = words_of(batch.column(1))
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    keep = filled[codes] if len(codes) else np.empty(0, bool)
    if not keep.all():
        ends = np.append(0, np.cumsum(keep))[ends]
        codes = codes[keep]
    per_row: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
    stay = np.ones(len(codes), bool)
    starts, stops = stretches(codes, ends, least)
    for row, start, stop in zip(np.searchsorted(ends, starts, "right") - 1, starts, stops):
        for s, length, period in runs(codes[start:stop].tolist(), least):
            per_row[row].append((int(start - ends[row]) + s, length, period))
            stay[start + s + period : start + s + length] = False
    kept = np.append(0, np.cumsum(stay))[ends]
    words = words.take(pa.array(codes[stay]))
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words)
    texts = pc.binary_join(lists, pa.scalar(" "))
    flat = np.array([r for some in per_row for r in some], np.int64).reshape(-1, 3)
    offsets = np.append(0, np.cumsum([len(some) for some in per_row]))
    found = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()),
        pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]),
    )
    columns = [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), found, texts]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period), collapsed.

    Words are what stands between ASCII white space. A run is a stretch of at least ``least`` words
    and twice its smallest period that no neighbouring word goes on; runs come by start, then
    period. ``collapsed`` is the text with one round of every run left: words after a run's first
    period go, the others are joined by one space. A null or blank text has no words, no runs and
    an empty collapsed text. Repeated rows repeat in the result; other columns are not read.

    A row is worked on alone, so nothing is shuffled; memory follows the longest text.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", _RUN),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, _SLICE):
                yield _found(part, least)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")
