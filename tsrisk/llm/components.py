"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsrisk.session import stage, unstage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least_neighbour(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours to its least neighbour."""
    both = _both(edges)
    joined = both.join(_least_neighbour(both), "u").filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours to its least neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the edges `u, v`; the root is the component's least node.

    Least neighbours are partial aggregates and the joins can be split where a
    node has very many edges, so a star of any size is spread over the tasks.
    Each round is written to the shared folder, which cuts the lineage.
    Self-loops and repeated edges are dropped; without edges the result is empty.
    """
    down = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage(down.distinct(), "cc")
    before = _state(now)
    while before[0]:
        large = stage(_large_star(now), "cc-large")
        following = stage(_small_star(large), "cc-small")
        after = _state(following)
        unstage(now, large)
        now = following
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
