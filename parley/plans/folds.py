"""Ordered folds inside groups that may be of any size.

A fold ("last known value", "row before", "running number", "last n items") is a window over
(group, order). That is one task per group, fine for ordinary conversations and fatal for one
that holds a third of the table. So the order column, a dense message number, is also cut into
blocks of ``BLOCK`` numbers:

* no group holds a block's worth of rows: plain windows, one shuffle and one sort shared by all
  folds. One ``max`` over one column tells when the numbers are dense; only if they are large are
  the rows of every group counted;
* some group does: windows run inside (group, block), so no task holds more than a block, and
  what a block needs from earlier ones comes from one small row per block, folded by group and
  joined back. Sparse numbers (milliseconds) are cut at quantiles of the long groups' rows, so
  blocks hold about that many rows however unevenly the numbers lie.

Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from parley.functions.arrays import tail
from parley.plans.cells import SPARSE, Cells, quantile_cells
from parley.plans.sizes import checked_broadcast
from parley.session import cut_lineage

BLOCK = 20_000
_BLOCK = "__block"


@dataclass(frozen=True)
class Order:
    """Group keys, order column (unique inside a group), size of a block if needed, most rows of a group.

    Blocks are ``block`` numbers wide, or cut by ``cuts``.
    """

    keys: tuple[str, ...]
    by: str
    block: int | None = None
    longest: int | None = None
    cuts: Cells | None = None

    def within(self, *more: str) -> "Order":
        """The same order inside smaller groups."""
        return replace(self, keys=self.keys + more)

    def backward(self, by: str) -> "Order":
        """The reverse order, ``by`` being the negated order column."""
        return replace(self, by=by, cuts=self.cuts and self.cuts.backward())

    def cells(self, df: DataFrame) -> DataFrame:
        if self.block is None:
            return df
        return (self.cuts or Cells(self.block)).add(df, self.by, _BLOCK)

    @property
    def cell_keys(self) -> list[str]:
        return [*self.keys, *([_BLOCK] if self.block is not None else [])]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.cell_keys).orderBy(self.by)

    def blocks_of_group(self) -> WindowSpec:
        earlier = Window.partitionBy(*self.keys).orderBy(_BLOCK)
        return earlier.rowsBetween(Window.unboundedPreceding, -1)


def measure(df: DataFrame, keys: Sequence[str], by: str, block: int = BLOCK) -> Order:
    """Decide between plain windows and blocks, and how blocks are cut; a few values come back."""
    largest = df.agg(F.max(by)).first()[0] or 0
    if largest < block:
        return Order(tuple(keys), by, None, largest)
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(by) - F.min(by) + 1).alias("span"))
    long = F.col("n") >= block
    rows, total, wide = groups.agg(
        F.max("n"), F.sum(F.when(long, F.col("n"))), F.max(F.when(long, F.col("span") / F.col("n")))
    ).first()
    if rows < block:
        return Order(tuple(keys), by, None, rows)
    if wide <= SPARSE:
        return Order(tuple(keys), by, block, rows)
    # short groups take no part: their rows may lie elsewhere
    hot = groups.where(long).select(*[F.col(k).alias(f"__long{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__long{i}")) for i, k in enumerate(keys)])
    cuts = quantile_cells(df.select(*keys, by).join(checked_broadcast(hot), same, "left_semi"), by, block, total)
    return Order(tuple(keys), by, block, rows, cuts)


def settle(df: DataFrame, order: Order) -> DataFrame:
    """Cut lineage before a blocked fold reads its input twice; plain folds need no cut."""
    if order.block is None:
        return df
    return cut_lineage(df)


def _join_back(df: DataFrame, per_block: DataFrame, order: Order) -> DataFrame:
    return df.join(per_block, order.cell_keys, "left")


def carry(
    df: DataFrame, order: Order, values: Mapping[str, Column], *, before: bool = False
) -> DataFrame:
    """Add, per name, the last non-null value up to this row, or strictly before it."""
    frame = order.window().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    if order.block is None:
        return df.withColumns({n: F.last(v, ignorenulls=True).over(frame) for n, v in values.items()})
    cells = order.cells(df.withColumns({f"__cue_{n}": v for n, v in values.items()}))
    cue = lambda n: F.col(f"__cue_{n}")
    per_block = cells.groupBy(*order.cell_keys).agg(
        *[F.max_by(cue(n), F.when(cue(n).isNotNull(), F.col(order.by))).alias(f"__own_{n}") for n in values]
    )
    earlier = per_block.select(
        *order.cell_keys,
        *[
            F.last(f"__own_{n}", ignorenulls=True).over(order.blocks_of_group()).alias(f"__old_{n}")
            for n in values
        ],
    )
    inside = cells.withColumns(
        {f"__new_{n}": F.last(cue(n), ignorenulls=True).over(frame) for n in values}
    )
    joined = _join_back(inside, earlier, order)
    return joined.withColumns(
        {n: F.coalesce(F.col(f"__new_{n}"), F.col(f"__old_{n}")) for n in values}
    ).drop(_BLOCK, *[f"__{part}_{n}" for n in values for part in ("cue", "old", "new")])


def number(df: DataFrame, order: Order, name: str) -> DataFrame:
    """Add the row number inside the group, from 1."""
    if order.block is None:
        return df.withColumn(name, F.row_number().over(order.window()))
    cells = order.cells(df)
    counts = cells.groupBy(*order.cell_keys).agg(F.count("*").alias("__rows"))
    before = counts.select(
        *order.cell_keys, F.sum("__rows").over(order.blocks_of_group()).alias("__before")
    )
    inside = cells.withColumn(name, F.row_number().over(order.window()))
    return (
        _join_back(inside, before, order)
        .withColumn(name, (F.coalesce(F.col("__before"), F.lit(0)) + F.col(name)).cast("int"))
        .drop(_BLOCK, "__before")
    )


def total_before(df: DataFrame, order: Order, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the group's rows strictly before this one; 0 at its start."""
    frame = order.window().rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(frame), F.lit(0))
    if order.block is None:
        return df.withColumn(name, inside)
    cells = order.cells(df)
    sums = cells.groupBy(*order.cell_keys).agg(F.sum(value).alias("__sum"))
    before = sums.select(*order.cell_keys, F.sum("__sum").over(order.blocks_of_group()).alias("__old"))
    return (
        _join_back(cells.withColumn(name, inside), before, order)
        .withColumn(name, F.coalesce(F.col("__old"), F.lit(0)) + F.col(name))
        .drop(_BLOCK, "__old")
    )


def items_before(df: DataFrame, order: Order, item: Column, n: int, name: str) -> DataFrame:
    """Add an array of the last ``n`` items of the group before this row, oldest first."""
    frame = order.window().rowsBetween(-n, -1)
    if order.block is None:
        return df.withColumn(name, F.collect_list(item).over(frame))
    cells = order.cells(df.withColumn("__item", item))
    from_end = Window.partitionBy(*order.cell_keys).orderBy(F.desc(order.by))
    ends = (
        cells.select(*order.cell_keys, order.by, "__item")
        .withColumn("__rn", F.row_number().over(from_end))
        .where(F.col("__rn") <= n)
        .groupBy(*order.cell_keys)
        .agg(F.array_sort(F.collect_list(F.struct(order.by, "__item"))).alias("__ends"))
    )
    # n earlier blocks are enough: a block in the list holds at least one item
    last_blocks = Window.partitionBy(*order.keys).orderBy(_BLOCK).rowsBetween(-n, -1)
    earlier = ends.select(
        *order.cell_keys,
        F.transform(
            tail(F.flatten(F.collect_list("__ends").over(last_blocks)), n), lambda e: e["__item"]
        ).alias("__old"),
    )
    inside = cells.withColumn("__new", F.collect_list("__item").over(frame))
    joined = _join_back(inside, earlier, order)
    every = F.when(F.col("__old").isNull(), F.col("__new")).otherwise(F.concat("__old", "__new"))
    return joined.withColumn(name, tail(every, n)).drop(_BLOCK, "__item", "__old", "__new")


def last_rows(df: DataFrame, keys: Sequence[str], by: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group in the given order, numbered.

    The filter on ``row_number`` lets Spark keep only ``n`` rows per group and task before the
    shuffle, so a hot group never reaches its task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
