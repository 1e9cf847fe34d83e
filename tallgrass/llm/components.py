"""Connected components of large edge lists, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, *done: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges`` (a, b), as a written table.

    Each round hangs nodes below the smallest neighbour and is written to the
    shared folder.  Minima are partly aggregated before they are shuffled and
    join back from a written table, so that a join on a hub can be split.
    Scratch tables ``done``, which only ``edges`` was to read, are deleted.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "edges", *done)
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")), "large-star")
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        edges = staged(large, "large-edges", edges, low)
        low = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        pairs = edges.join(low, "a")
        small = pairs.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small, "small-edges", edges, low)
        if open_nodes(edges).isEmpty():
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
    return staged(found, "components", edges)


def open_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that hang below more than one other, or below one and above another: none are left when all hang from their component's smallest."""
    roles = edges.select(F.col("a").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("x").agg(F.sum("below").alias("n"), F.max("above").alias("above")).where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("above") > 0)))
