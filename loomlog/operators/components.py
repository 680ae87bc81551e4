"""Connected components by alternating large-star and small-star steps over tables of edges.

No step makes more edges than it gets, so their number at the beginning tells how many tasks each step needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import checkpointed, tasks_for


def _with_least(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges with m, the least v of their u.

    In one task without a shuffle; over several, stored sums are on one side, so that Spark can split a hub's rows in the join.
    """
    if tasks == 1:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = checkpointed(edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), tasks)
    return edges.join(least, F.col("u") == F.col("c"))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    return checkpointed(_with_least(both, tasks).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """The smaller neighbours of a node, and the node itself, move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, tasks).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return checkpointed(moved.select("e.*").filter("u <> v").distinct(), tasks)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("downs"), F.lit(0).alias("ups")), F.struct(F.col("v").alias("node"), F.lit(0).alias("downs"), F.lit(1).alias("ups")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("downs").alias("d"), F.max("ups").alias("u")).filter("d > 1 OR d > 0 AND u > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node but the least of each component.

    edges: u, v (long); loops and repeats may occur.  Each step is cut off by a checkpoint; the
    number of rounds grows with the logarithm of the largest component.
    """
    edges = checkpointed(edges.filter("u <> v"))
    tasks = tasks_for(edges.count())
    now = _small_star(edges.coalesce(tasks), tasks)
    while not _are_stars(now):
        now = _small_star(_large_star(now, tasks), tasks)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
