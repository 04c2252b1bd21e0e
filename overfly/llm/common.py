"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators import store
from ..operators.store import checkpointed, removed, shared_folder

__all__ = ["checkpointed", "extended", "give_back", "looked_up", "map_arrow", "reclaim", "removed", "shared_folder", "ship", "table", "with_rank"]

#: A word of the contracts: bytes outside blank and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch between JVM and Python.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints of steps that nothing refers to any more.

    Its cleaner goes by the driver's garbage collection, which on a large heap may not
    happen for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def looked_up(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``side`` has for each long ``key``.

    A side that was just aggregated by the key is partitioned by it already, and a join
    that uses this cannot be split where a key is hot. The join therefore runs on
    another value of the key, so that both sides are dealt out for it and adaptive
    execution can split the hot partitions of ``rows`` and repeat the one row.
    """
    side = side.withColumn("_ov_key", F.col(key).bitwiseXOR(F.lit(1).cast("long"))).drop(key)
    return rows.join(side, F.col(key).bitwiseXOR(F.lit(1).cast("long")) == F.col("_ov_key"), how).drop("_ov_key")


def with_rank(df: DataFrame, group: list[Column], order: list[Column], rank: str = "rank", counts: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 in ``order``, without a window over a whole group.

    Rows are range-partitioned on (group, order), so a hot group spreads over many
    tasks; each row's place inside its partition comes from one local sort, and the
    partitions' counts (at most partitions + groups rows) are prefix-summed. The
    checkpoint pins the partitioning that both steps refer to. Rows that tie on
    (group, order) get different numbers in an unspecified order, so ``order``
    should be total up to identical rows.

    ``counts`` names an optional column with the size of the row's group.
    """
    gs = [f"_ov_g{i}" for i in range(len(group))]
    d = df.select("*", *[g.alias(n) for g, n in zip(group, gs)])
    keys = [*[F.col(n) for n in gs], *order]
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_ov_id", F.monotonically_increasing_id())
    d = checkpointed(d).withColumn("_ov_part", F.shiftright("_ov_id", 33))
    per = d.groupBy("_ov_part", *gs).agg(F.count(F.lit(1)).alias("_ov_n"), F.min("_ov_id").alias("_ov_first"))
    w = Window.partitionBy(*gs) if gs else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_ov_n").over(w.orderBy("_ov_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("_ov_part").alias("_ov_p"), *[F.col(n).alias(f"_ov_h{n}") for n in gs], "_ov_first", before.alias("_ov_before"), *([F.sum("_ov_n").over(w).alias(counts)] if counts else []))
    on = F.col("_ov_part") == F.col("_ov_p")
    for n in gs:
        on = on & F.col(n).eqNullSafe(F.col(f"_ov_h{n}"))
    return d.join(per, on).withColumn(rank, F.col("_ov_before") + F.col("_ov_id") - F.col("_ov_first")).drop(
        "_ov_id", "_ov_part", "_ov_p", "_ov_first", "_ov_before", *gs, *[f"_ov_h{n}" for n in gs]
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once per Spark context), and let batches of texts be small.

    Arrow batches are bounded in bytes by ``BATCH_BYTES``, unless the session has set
    another bound than Spark's own: JVM and worker each hold several batches at a time.
    """
    if spark.conf.get(BATCH_KEY).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    store.ship(spark)


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, which give back what memory they can after each partition (workers are used again)."""
    ship(df.sparkSession)

    def run(batches):
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, where the allocators allow it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with more columns, as a new object (``StructType.add`` would change the frame's own)."""
    more = df.sparkSession.createDataFrame([], ", ".join(f"`{k}` {v}" for k, v in columns.items())).schema
    return StructType([*df.schema.fields, *more.fields])
