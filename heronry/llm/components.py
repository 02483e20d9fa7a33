"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import materialise


def _larger_to_least(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_to_least(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them; links point from larger to smaller."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node and least, the smallest node that each linked node reaches.

    links: two columns a and b of one orderable type; order, repeats and self-links don't matter, rows with a
    null are ignored, nodes without a link don't appear. Rounds, about the logarithm of the longest chain, end
    when no link moves; each is cut by a written table, and neighbourhoods are never gathered, only their least.
    """
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        links = materialise(_smaller_to_least(_larger_to_least(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("least"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
