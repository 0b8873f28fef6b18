"""Costly columns that later filters and projections must not compute again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated exactly once per row.

    A plain projection may be merged into every expression and filter that uses it. A generator
    of one row is not merged, stays inside the row (no shuffle) and is compiled like any other.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))
