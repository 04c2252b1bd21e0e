"""Incremental accuracy over arriving result files (an addition of this engine, not an operator of the batch inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accuracy as A


def accuracy_stream(spark: SparkSession, path: str, schema: str, checkpoint: str, name: str, t: int = 25):
    """Start a query over Parquet files of ``path``: rows and hits by method, complete after each trigger.

    availableNow reads what is there in bounded batches and ends; the checkpoint makes
    a rerun go on with new files only. Repeated deliveries of a row are dropped by key.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    return _summary(rows.dropDuplicates(["method", "flight", "filename"]), t).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _summary(rows: DataFrame, t: int) -> DataFrame:
    return A.scored(rows).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(A.within(t)).alias("hits"))


def accuracy_batch(rows: DataFrame, t: int = 25) -> DataFrame:
    return _summary(rows, t)
