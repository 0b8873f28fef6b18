"""Small helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tail(items: Column, n: int) -> Column:
    """Last ``n`` elements (``slice`` with a negative start is empty on shorter arrays)."""
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def first_present(*columns: Column) -> Column:
    """First non-null value, which may be empty, else the empty string."""
    return F.coalesce(*columns, F.lit(""))
