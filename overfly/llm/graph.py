"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, looked_up, reclaim


def _minima(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    low = _minima(both).select("u", F.least("u", "m").alias("m"))
    return looked_up(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these (edges point to the smaller node)."""
    low = _minima(e)
    return looked_up(e, low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (u, v); root is the component's least node.

    Minima come from partial aggregates and travel back by joins that Spark can
    split, so a hub with a third of all edges is no single task's work. Each step
    ends in a reliable checkpoint, after which the files of the step before can go;
    rounds grow with the logarithm of the size. The given edges get one too. So a step
    reads its edges twice, in as many tasks as there are shuffle partitions, and the driver,
    which keeps a record of every task, has no more of them than that.
    """
    e = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most):
        e = checkpointed(small_star(checkpointed(large_star(e))))
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        reclaim(e.sparkSession)
    raise RuntimeError(f"components did not settle in {most} rounds")
