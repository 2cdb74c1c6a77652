"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour (or itself)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``least``, the smallest node of its component, for every node of ``links`` (``a``, ``b``) but the smallest.

    Each round is written to the shared folder and ends the lineage. A hub's links are joined to one row with its
    smallest neighbour, never gathered. It stops when a round changes nothing.
    """
    state = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        state = written(_small_star(_large_star(state)).where("a != b").distinct(), "links")
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("least"))
        mark = seen
    raise RuntimeError("the components did not settle")
