"""Cutting lineage through the folder that driver and executors share, and ranks that need it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a temporary folder under a local master and an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="overfly-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_overfly_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="overfly-code-")) / "overfly_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._overfly_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` through a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str, running: dict[str, Column] | None = None) -> DataFrame:
    """Number the rows of each group from 0 in ``order`` (and sum columns up to each row), however large a group is.

    Rows are range-partitioned on (group, order), so a hot group spreads over many
    tasks. Places and sums inside a partition come from one sorted pass per partition and
    group; the partitions' totals, at most partitions + groups rows, are prefix-summed and
    joined back. The checkpoint pins the partitioning that both steps refer to.
    ``running`` names inclusive running sums to add.
    """
    running = running or {}
    keys = [*[F.col(g) for g in group], *order]
    d = df.withColumns({f"_v{i}": c for i, c in enumerate(running.values())}) if running else df
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    d = checkpointed(d)
    if running:
        # A window by partition and group needs no more than the one partition's rows.
        inside = Window.partitionBy("_part", *group).orderBy("_at")
        d = d.withColumns({f"_s{i}": F.sum(f"_v{i}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for i in range(len(running))})
    # A group's rows follow one another in a partition: a row's place is how far it is from the first.
    per = d.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(running))])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_n", *[f"_t{i}" for i in range(len(running))])]
    per = per.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", *earlier)
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = d.join(per, on).withColumns({rank: F.col("_at") - F.col("_first") + F.col("_b_n"), **{name: F.col(f"_s{i}") + F.col(f"_b_t{i}") for i, name in enumerate(running)}})
    return out.select(*df.columns, rank, *running)


def with_neighbours(df: DataFrame, group: list[str], order: list[str], columns: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """Add structs of ``columns`` of the row before and the row after in each group's ``order`` (null at the ends), however large a group is.

    Rows are range-partitioned on (group, order) and look at their partition's own rows;
    the partitions exchange the first and the last row of each group, partitions + groups
    rows at most. Rows that tie in ``order`` follow one another in an unspecified order.
    """
    keys = [*group, *order]
    row = F.struct(*columns)
    d = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    d = checkpointed(d)
    inside = Window.partitionBy("_part", *group).orderBy("_at")
    d = d.withColumns({"_b": F.lag(row).over(inside), "_a": F.lead(row).over(inside)})
    edges = d.groupBy("_part", *group).agg(F.min_by(row, "_at").alias("_first"), F.max_by(row, "_at").alias("_last"))
    parts = Window.partitionBy(*group).orderBy("_part")
    edges = edges.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.lag("_last").over(parts).alias("_eb"), F.lead("_first").over(parts).alias("_ea"))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return d.join(edges, on).select(*df.columns, F.coalesce("_b", "_eb").alias(before), F.coalesce("_a", "_ea").alias(after))
