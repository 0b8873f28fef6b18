"""Exact ranks over whole tables and over sources of any size, without a one-task window.

Seeded order: the key is an md5 text, uniform by construction. A histogram over its leading hex
digits tells where every rank falls; only the rows of one histogram cell meet in one task, and
a question such as "the first n" becomes a comparison with one cutoff key, so the wide rows do
not move at all.

Natural order: an integer (row ordinal, id, milliseconds) is cut into cells of about equal numbers
of rows; ranks inside a cell plus the number of rows in earlier cells give the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import fixed
from parley.plans.cells import cells_for
from parley.plans.sizes import checked_broadcast
from parley.session import cut_lineage

DIGITS = 3
BLOCK = 65_536
_SUPER = 4_096


def seeded_key(*ids: Column, seed: int = fixed.SEED) -> Column:
    """Order key that depends on the seed and the row's own key only, never on partitioning."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *ids).cast("binary"))


def digits_for(rows: int, cell: int = BLOCK) -> int:
    """Leading digits after which about ``cell`` keys of ``rows`` are left."""
    digits = 1
    while rows > cell * 16**digits:
        digits += 1
    return digits


def rows_before(cells: DataFrame, groups: Sequence[str], cell: str) -> DataFrame:
    """(groups, cell, __before, __rows): rows in earlier cells of the group, exclusive."""
    earlier = Window.partitionBy(*groups, F.lit(0)).orderBy(cell)
    return cells.withColumn(
        "__before",
        F.coalesce(
            F.sum("__rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )


def histogram(df: DataFrame, key: str, groups: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """Rows per group and leading digits, with the rows before: at most 16^digits per group."""
    cells = (
        df.select(*groups, F.substring(key, 1, digits).alias("__cell"))
        .groupBy(*groups, "__cell")
        .agg(F.count("*").alias("__rows"))
    )
    return rows_before(cells, groups, "__cell")


def rank_by_key(
    df: DataFrame, key: str, groups: Sequence[str] = (), name: str = "rank", digits: int | None = None
) -> DataFrame:
    """Add the exact rank (from 1) in key order, inside the group if one is given.

    Unless ``digits`` says how finely, the rows are counted so that a cell stays small at any size.
    """
    if digits is None:
        digits = max(DIGITS, digits_for(df.count()))
    cells = histogram(df, key, groups, digits).drop("__rows")
    window = Window.partitionBy(*groups, "__cell").orderBy(key)
    return (
        df.withColumn("__cell", F.substring(key, 1, digits))
        .join(cells, [*groups, "__cell"])
        .withColumn(name, F.col("__before") + F.row_number().over(window))
        .drop("__cell", "__before")
    )


def cutoff_keys(
    df: DataFrame, key: str, n: Column, groups: Sequence[str] = (), digits: int = DIGITS
) -> DataFrame:
    """One row per group: ``__cutoff``, the key of rank ``n`` (null where the group is smaller).

    ``n`` may use ``__total``, the rows of the group. The keys are computed once, and only those
    of one histogram cell per group are sorted.
    """
    df = cut_lineage(df.select(*groups, key))
    digits = max(digits, digits_for(df.count()))
    whole = Window.partitionBy(*groups, F.lit(0))
    cells = (
        histogram(df, key, groups, digits)
        .withColumn("__total", F.sum("__rows").over(whole))
        .withColumn("__n", n.cast("bigint"))
    )
    edge = cells.where(
        (F.col("__n") > F.col("__before")) & (F.col("__n") <= F.col("__before") + F.col("__rows"))
    ).select(*groups, "__cell", (F.col("__n") - F.col("__before")).alias("__nth"))
    inside = Window.partitionBy(*groups, "__cell").orderBy(key)
    return (
        df.select(*groups, F.col(key), F.substring(key, 1, digits).alias("__cell"))
        .join(edge, [*groups, "__cell"])
        .withColumn("__rn", F.row_number().over(inside))
        .where(F.col("__rn") == F.col("__nth"))
        .select(*groups, F.col(key).alias("__cutoff"))
    )


def _found(row: DataFrame):
    """The single value of a table of at most one row."""
    first = row.first()
    return None if first is None else first[0]


def first_by_key(df: DataFrame, key: str, n: int, groups: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """The ``n`` rows with the smallest keys, of the table or of every group; all when fewer."""
    cut = cutoff_keys(df, key, F.lit(n), groups, digits)
    if groups:
        # one row per group: broadcast when few, so that a hot group is not moved
        marked = df.join(checked_broadcast(cut), list(groups), "left")
        inside = F.col("__cutoff").isNull() | (F.col(key) <= F.col("__cutoff"))
        return marked.where(inside).drop("__cutoff")
    last = _found(cut)
    return df if last is None else df.where(F.col(key) <= last)


def mark_first_share(
    df: DataFrame, key: str, fraction: float, name: str, digits: int = DIGITS
) -> DataFrame:
    """Add a flag for exactly ``ceil(rows * fraction)`` rows with the smallest keys.

    One key comes back to the driver; marking the wide rows is then a comparison with it.
    """
    last = _found(cutoff_keys(df, key, F.ceil(F.col("__total") * F.lit(fraction)), (), digits))
    return df.withColumn(name, F.lit(False) if last is None else F.col(key) <= last)


def key_range(df: DataFrame, key: str, first: int, last: int, digits: int = DIGITS) -> DataFrame:
    """Rows ranked ``first`` to ``last`` in key order."""
    upto = first_by_key(df, key, last, digits=digits)
    if first <= 1:
        return upto
    before = _found(cutoff_keys(df, key, F.lit(first - 1), (), digits))
    return df.limit(0) if before is None else upto.where(F.col(key) > before)


def running_rows(cells: DataFrame, groups: Sequence[str], cell: str) -> DataFrame:
    """Rows before every integer cell, in two levels so that no task sees all cells.

    Both levels read the counts, one small row per cell.
    """
    upper = cells.withColumn("__super", F.floor(F.col(cell) / _SUPER))
    low = Window.partitionBy(*groups, "__super").orderBy(cell)
    supers = rows_before(
        upper.groupBy(*groups, "__super").agg(F.sum("__rows").alias("__rows")), groups, "__super"
    ).select(*groups, "__super", F.col("__before").alias("__base"))
    return (
        upper.withColumn(
            "__in",
            F.coalesce(F.sum("__rows").over(low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .join(supers, [*groups, "__super"])
        .select(*groups, cell, (F.col("__base") + F.col("__in")).alias("__before"))
    )


def rank_by_ordinal(
    df: DataFrame, by: str, groups: Sequence[str] = (), name: str = "rank", block: int = BLOCK
) -> DataFrame:
    """Add the exact rank (from 1) in the order of an integer column, unique inside the group."""
    cut = cells_for(df, by, block).add(df, by, "__cell")
    counts = cut.groupBy(*groups, "__cell").agg(F.count("*").alias("__rows"))
    window = Window.partitionBy(*groups, "__cell").orderBy(by)
    return (
        cut.join(running_rows(counts, groups, "__cell"), [*groups, "__cell"])
        .withColumn(name, F.col("__before") + F.row_number().over(window))
        .drop("__cell", "__before")
    )


def newest_rows(df: DataFrame, by: str, n: int, block: int = BLOCK) -> DataFrame:
    """The ``n`` rows with the largest order numbers.

    Rows per cell tell in which cell the n-th newest row lies; only the order numbers of that
    cell are sorted, and the wide rows are just compared with the one number found.
    """
    numbers = cut_lineage(df.select(by))
    cut = cells_for(numbers, by, block).add(numbers, by, "__cell")
    counts = cut.groupBy(-F.col("__cell")).agg(F.count("*").alias("__rows")).toDF("__cell", "__rows")
    edge = (
        running_rows(counts, (), "__cell")
        .join(counts, "__cell")
        .where((F.col("__before") < n) & (F.col("__before") + F.col("__rows") >= n))
        .select((-F.col("__cell")).alias("__cell"), (F.lit(n) - F.col("__before")).alias("__nth"))
    )
    window = Window.partitionBy("__cell").orderBy(F.desc(by))
    cutoff = (
        cut.join(edge, "__cell")
        .withColumn("__rn", F.row_number().over(window))
        .where(F.col("__rn") == F.col("__nth"))
        .select(F.col(by).alias("__cutoff"))
    )
    oldest = _found(cutoff)
    return df if oldest is None else df.where(F.col(by) >= oldest)


def number_rows(df: DataFrame, by: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the exact global rank (from 1) for any sort order."""
    return number_sorted(df.orderBy(*by), name)


def number_sorted(df: DataFrame, name: str = "rank") -> DataFrame:
    """Add the place (from 1) of every row of a sorted table.

    A range-partitioned sort numbers rows per partition; the offset of a partition is the number
    of rows before it, a table of one row per partition. The sort is written to the checkpoint
    folder first, so both readers see the same partitions even if an executor is lost.
    """
    numbered = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id())).withColumn(
        "__part", F.shiftright("__id", 33)
    )
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__rows"))
    offsets = rows_before(sizes, (), "__part").drop("__rows")
    low = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(offsets, "__part")
        .withColumn(name, F.col("__before") + low + 1)
        .drop("__id", "__part", "__before")
    )
