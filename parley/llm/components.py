"""Connected components of a link table of any size, by alternating large and small stars.

Every round is joins and groupings; the rows are written to the shared folder between rounds, and
only a count and a checksum come to the driver. A node with very many links is dealt out by salt:
its smallest neighbour is found per salt, then over the salts, and goes back to each salt.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import settled, spread_min


def _large_star(links: DataFrame, salts: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = spread_min(both, ["a"], "b", "m", F.col("b"), salts)
    return least.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(links: DataFrame, salts: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest one. Links have a > b."""
    least = spread_min(links, ["a"], "b", "m", F.col("b"), salts)
    return least.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is the component's smallest node.

    Loops, repeated and reversed links do no harm; no link gives no row. Nodes may not be null.
    """
    now = settled(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(),
        "links",
    )
    seen = _state(now)
    while seen[0]:
        # a node with all the links then meets as many rows per salt as it has salts
        salts = max(8, min(4_096, math.isqrt(seen[0])))
        now = settled(_small_star(_large_star(now, salts).distinct(), salts).distinct(), "links")
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
