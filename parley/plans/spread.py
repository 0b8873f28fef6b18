"""Dealing out rows of a source that comes in too few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer file splits than there are cores, dealt out to all of them.

    Meant for heavy per-row text work right after a read. Large tables have more splits than
    cores and are left alone, so nothing is shuffled there; planning the scan tells which.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
