"""The best and worst rows of each group of a stream, kept in a bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.store import ship

ROW = "side string, inliers long, seq long, filename string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Extremes(StatefulProcessor):
    """Keeps ``k`` rows of most and ``k`` of least inliers a group (ties to the smaller seq): 2k rows of state, whatever arrives.

    A row that comes again changes nothing: while it is kept it is known by its seq, and
    once it has been pushed out, k better ones stand before it for good.
    """

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["side", "inliers", "seq", "filename"]
        old = pd.DataFrame([tuple(r) for r in self.kept.get()], columns=names)
        new = pd.concat([old[names[1:]], *[r[names[1:]] for r in rows]]).drop_duplicates("seq")
        best = new.sort_values(["inliers", "seq"], ascending=[False, True]).head(self.k).assign(side="best")
        worst = new.sort_values(["inliers", "seq"]).head(self.k).assign(side="worst")
        both = pd.concat([best, worst])[names].astype({"inliers": "int64", "seq": "int64"})
        self.kept.put([tuple(r) for r in both.itertuples(index=False)])
        both["place"] = both.groupby("side").cumcount().astype("int32") + 1
        yield both.assign(**dict(zip(("method", "flight"), key)))[["method", "flight", *names, "place"]]

    def close(self) -> None:
        pass


def extremes_stream(spark: SparkSession, path: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], k: int = 3, files: int = 1):
    """Start a query over Parquet files of ``path`` (method, flight, filename, seq, inliers); ends when all are read.

    ``each`` gets, per batch, the rows method, flight, side, inliers, seq, filename, place of
    the groups that the batch touched: the later batch's rows of a group replace the
    earlier's. The checkpoint makes a rerun go on where it stopped.
    """
    ship(spark)
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        kept = rows.groupBy("method", "flight").transformWithStateInPandas(Extremes(k), f"method string, flight string, {ROW}, place int", "Update", "None")
        return kept.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, old)
