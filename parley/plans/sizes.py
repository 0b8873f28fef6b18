"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 200_000
BYTES = 64 << 20


def _bytes(field: T.StructField) -> Column:
    """About the bytes of one value."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 16
    return F.lit(16)


def fits(small: DataFrame, rows: int = ROWS, size: int = BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and about ``size`` bytes; no more than the bound is read."""
    width = sum((_bytes(f) for f in small.schema.fields), F.lit(0)).cast("bigint")
    counted = small.select(width.alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0)))
    found = counted.first()
    return found[0] <= rows and found[1] <= size


def checked_broadcast(small: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """A lookup table, with a broadcast hint only if it is known to be small in rows and bytes.

    Nothing is kept in memory for it. Past the bound it comes back without a hint and the join is
    a sort-merge join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(small) if fits(small, rows, size) else small
