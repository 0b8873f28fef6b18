"""Text -> unit vector columns. Any function DataFrame -> DataFrame can replace the built-in one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed
from parley.functions.text import WORD


def word_places(text: Column, dim: int) -> Column:
    """A place for every word: leading md5 digits modulo the size of the vector."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{WORD}]+"), F.lit(0))
    return F.transform(
        words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("int") % dim)
    )


def embed(df: DataFrame, text: str = "text", into: str = "vec", dim: int = fixed.MEMORY_DIM) -> DataFrame:
    """Add a unit-length word-count vector of ``dim`` floats; a text without words gets zeros."""

    @F.pandas_udf("array<float>")
    def unit_counts(places: pd.Series) -> pd.Series:
        def one(hit: np.ndarray) -> np.ndarray:
            counts = np.bincount(np.asarray(hit, np.int64), minlength=dim).astype(np.float64)
            return (counts / (np.sqrt((counts * counts).sum()) or 1.0)).astype(np.float32)

        return places.map(one)

    return df.withColumn(into, unit_counts(word_places(F.col(text), dim)))
