"""Connected components by alternating large-star and small-star steps.

Each step links every node's neighbours to the smallest node near it; groups are
reduced by min and joined back, so no neighbour list is gathered. The edges are written
to the shared folder after each round, and the rounds end when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over edges (u, v), for every node that has one."""
    current = save(edges.where("u != v").select("u", "v").distinct(), name)
    seen = None
    for _ in range(MAX_ROUNDS):
        current = save(small_star(large_star(current)), name)
        # done when every node hangs on a root that hangs on nothing
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
