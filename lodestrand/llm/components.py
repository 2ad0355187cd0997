"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, join_split, stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest one; ``total`` edges, with a hub's dealt to many tasks."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return join_split(both, _least(both), "u", 2 * total, hot_rows=hot_rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these. Edges point down: u > v."""
    least = _least(edges)
    tied = join_split(edges, least, "u", total, hot_rows=hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node it is connected to.

    Each round is two joins on the node, with the least neighbour found by map-side
    minima; a hub's edges are not one task (``join_split``). The rounds needed grow with
    the logarithm of the longest path. Each round's edges are stored, so a lost executor
    costs one round's tasks.

    Edges from a node to itself keep that node in the result. Null ends are ignored.
    """
    proper = stored(edges.where("u IS NOT NULL AND v IS NOT NULL"), "edges")
    alone = proper.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    down = stored(proper.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = (down.count(), None)
    while True:
        total = state[0]  # a large star has no more edges than it is given
        turned = _large_star(down, total, hot_rows)
        turned = stored(turned, "edges") if total > hot_rows else turned
        down = stored(_small_star(turned, total, hot_rows), "edges")
        seen = tuple(down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    roots = down.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).union(alone).groupBy("node").agg(F.min("root").alias("root"))
