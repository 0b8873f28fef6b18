"""Cells of about equal numbers of rows over an order column.

Equal widths do for dense numbers. Milliseconds do not come evenly: all rows of a year may lie in
one hour of it. So sparse numbers are cut at sampled quantiles, and between two quantiles by
interpolation, which gives any number of cells from a bounded list of edges. Cells only decide
which rows meet in one task; they never change a result.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantiles that are fetched, at any size of the table, and how fine the sketch behind them is.
QUANTILES, ACCURACY = 256, 20_000
#: Numbers are dense while there are at most so many per row.
SPARSE = 4
_AT = "__stretch"


def _array(numbers: Iterable[float]) -> Column:
    """A constant array from one literal; the optimizer folds it once."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


@dataclass(frozen=True)
class Cells:
    """``edges`` (number, rows before it) that cut the order column; none: cells of ``rows`` numbers."""

    rows: int
    edges: tuple[tuple[float, int], ...] = ()
    sign: int = 1

    def backward(self) -> "Cells":
        """The same cells for the negated column."""
        return replace(self, sign=-self.sign)

    def add(self, df: DataFrame, by: str, name: str) -> DataFrame:
        """Add the number of the cell; it never falls where the order column rises."""
        if not self.edges:
            return df.withColumn(name, F.floor(F.col(by) / self.rows))
        numbers, before = zip(*self.edges)
        value = (F.col(by) * self.sign).cast("double")
        stretches = Bucketizer(
            splits=[-float("inf"), *numbers[1:-1], float("inf")],
            inputCol="__value",
            outputCol=_AT,
            handleInvalid="keep",
        )
        at = F.col(_AT).cast("int")
        low, high = (F.get(_array(numbers), i) for i in (at, at + 1))
        first, last = (F.get(_array(before), i) for i in (at, at + 1))
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__value") - low) / (high - low)))
        cell = F.floor((first + inside * (last - first)) / self.rows)
        placed = stretches.transform(df.withColumn("__value", value))
        return placed.withColumn(name, cell * self.sign).drop("__value", _AT)


def quantile_cells(df: DataFrame, by: str, rows: int, total: int) -> Cells:
    """Cells of about ``rows`` of the ``total`` rows, from one pass over the column."""
    steps = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = df.agg(F.percentile_approx(F.col(by).cast("bigint"), steps, ACCURACY)).first()[0]
    return Cells(rows, _edges(found or (), total))


def _edges(quantiles: Iterable[int], total: int) -> tuple[tuple[float, int], ...]:
    """Rising edges; fewer than three cut nothing."""
    before = {float(number): total * i // QUANTILES for i, number in enumerate(quantiles)}
    return tuple(before.items()) if len(before) > 2 else ()


def cells_for(df: DataFrame, by: str, rows: int) -> Cells:
    """Equal widths for dense numbers or few rows, otherwise quantiles. A few values come back."""
    total, first, last = df.agg(F.count(by), F.min(by), F.max(by)).first()
    if not total or last - first < max(rows, SPARSE * total):
        return Cells(rows)
    return quantile_cells(df, by, rows, total)
