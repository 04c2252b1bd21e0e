"""Deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_hash(d: DataFrame, n: int, key: Column, order: str = "seq") -> DataFrame:
    """n rows of least key hash, in their own order (a bounded sort: TakeOrdered)."""
    return d.orderBy(key, order).limit(n).orderBy(order)


def even(d: DataFrame, k: int, key: str = "flight", order: str = "seq") -> DataFrame:
    """k evenly spaced rows of each group, ends included, positions rounded half-even and unique."""
    w = Window.partitionBy(key)
    x = d.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(k - 1, 1))), 0).cast("long")))
    return x.filter((F.col("_n") <= k) | F.array_contains(spots, F.col("_r").cast("long"))).drop("_r", "_n")


def quota(d: DataFrame, total: int, hashed: Column, key: str = "flight", tie: str = "seq") -> DataFrame:
    """About total / groups rows of each group (rounded up) by least hash, ``total`` rows at most over all."""
    groups = d.select(key).distinct().agg(F.count(F.lit(1)).alias("_g"))
    x = d.withColumn("_h", hashed).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h", tie)))
    x = x.join(F.broadcast(groups), F.lit(True)).filter(F.col("_r") <= F.ceil(F.lit(float(total)) / F.col("_g")))
    return x.orderBy("_r", key).limit(total).drop("_h", "_r", "_g")


def head(d: DataFrame, n: int, key: str = "flight", order: str = "seq") -> DataFrame:
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= n).drop("_r")
