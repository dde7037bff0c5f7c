"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import stage

ROUNDS = 40


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to its smallest neighbour."""
    both = _both_ways(links)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = low.select("a", F.col("m").alias("b"))
    return moved.union(kept).where("a <> b").distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Each node is the child of one node at most, and no parent is a child."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return seen.where("c > 1 OR (c > 0 AND p > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id of `links` (a, b): the smallest reachable id.

    Nothing is collected: each round writes the contracted links to the shared
    folder. The number of rounds grows with the logarithm of the longest chain.
    """
    current = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(ROUNDS):
        if _is_forest_of_stars(current):
            break
        current = stage(_small_star(_large_star(current)), "links")
    else:
        raise RuntimeError(f"links not contracted after {ROUNDS} rounds")
    return current.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        current.select("b", "b").distinct()
    )
