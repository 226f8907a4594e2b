"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wareseek.storage import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour instead."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    smaller = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), the root being the least node it reaches.

    Links may be repeated and go either way; a link of a node to itself adds nothing. Each round is
    written to the shared folder, and rounds go on until nothing changes: about as many as the
    logarithm of the longest path. No links give no rows.
    """
    links = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = materialise(links.distinct(), "links")
    state = None
    while True:
        links = materialise(_small_star(_large_star(links)), "links")
        seen = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = tuple(seen)
