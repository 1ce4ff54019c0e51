"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerscope.llm.common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


EDGES = 100_000  # of a task, at least: a few edges are not dealt to many tasks and files


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least one around it."""
    around = _both_ways(edges).toDF("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = around.filter(F.col("v") > F.col("u")).join(least, "u").coalesce(tasks)
    return larger.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select("v", "m")
    return moved.union(least.select("u", "m")).toDF("a", "b").coalesce(tasks).distinct().coalesce(tasks)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    Large-star and small-star steps alternate until the edges stop changing. A step groups by
    node with a partial minimum and joins it back, so a hub's edges may be split over tasks.
    The edges are written after each round, so lineage stays short, by a task for each EDGES of
    them: at a fixed number of shuffle partitions few edges would otherwise be many small files in
    every exchange. Edges with a null end and
    loops are left out; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = materialise(pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        tasks = 1 + mark[0] // EDGES
        now = materialise(_small_star(_large_star(now, tasks), tasks))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    return now.union(roots).toDF("node", "component")
