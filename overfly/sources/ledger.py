"""A resumable sink that does not read all it has written: rows in buckets by key, batches in a commit log.

A batch deals its rows into buckets by the hash of their key, meets only the buckets that it
touches (a partition filter), drops keys that stand there, writes under its own name and
then adds one commit file. Readers see committed batches only: a run that dies between data
and commit leaves files that nobody reads, and its repetition writes each key once. One
writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.store import checkpointed, removed


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that are committed, the earliest first."""
    fs, at = _fs(spark, f"{path}/_commits")
    if not fs.exists(at):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at)]
    return [name for _, name in sorted(found) if not name.startswith((".", "_"))]


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches, with ``_batch`` and ``_bucket``, which reach the scan as partition filters."""
    names = commits(spark, path)
    full = StructType([*schema.fields, StructField("_batch", StringType()), StructField("_bucket", IntegerType())])
    if not names:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*[f"{path}/data/_batch={n}" for n in names])


def write_batch(rows: DataFrame, path: str, keys: list[str], buckets: int) -> tuple[str, int]:
    """Write a batch's new rows without committing them: (its name, how many)."""
    spark = rows.sparkSession
    d = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # Of several rows of a key, the one of least hash: the same in every run.
    first = F.min_by(F.struct(*d.columns), F.struct(F.xxhash64(*rows.columns), F.to_json(F.struct(*rows.columns))))
    d = checkpointed(d.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first.alias("_row")).select("_row.*"))
    touched = [r[0] for r in d.select("_bucket").distinct().collect()]
    old = committed(spark, path, rows.schema).filter(F.col("_bucket").isin(touched)).select(F.col("_bucket").alias("_b"), *[F.col(k).alias(f"_done{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_done{i}")) for i, k in enumerate(keys)], F.col("_bucket") == F.col("_b"))
    new = checkpointed(d.join(old, on, "left_anti"))
    name = uuid.uuid4().hex
    n = new.count()
    if n:
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/_batch={name}")
    return name, n


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Make a written batch visible: one file, created whole."""
    fs, at = _fs(spark, f"{path}/_commits/{name}")
    fs.create(at, False).close()


def append(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> int:
    """Add the rows whose key no committed batch has (nulls equal); returns how many. Every call must use the same ``buckets``.

    What an earlier run wrote and did not commit is deleted first.
    """
    spark = rows.sparkSession
    fs, data = _fs(spark, f"{path}/data")
    if fs.exists(data):
        known = set(commits(spark, path))
        for s in fs.listStatus(data):
            name = s.getPath().getName().removeprefix("_batch=")
            if name not in known:
                removed(spark, s.getPath().toString())
    name, n = write_batch(rows, path, keys, buckets)
    if n:
        commit(spark, path, name)
    return n
