"""Deterministic spatial bands: train | buffer | val | test along the wider axis of a flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ranked


def with_band(frames: DataFrame, test: float = 0.25, val: float = 0.10, buffer: float = 0.05, key: str = "flight", tie: str = "filename") -> DataFrame:
    """Add ``band`` to every frame.

    Frames of a flight are ordered by the axis with the wider spread (latitude on a
    tie, ``tie`` among equal values); sizes are rounded half-even. The test band is the
    top and does not depend on the other fractions; train never goes below none.
    Flights are ordered by ranges of rows, so a long one is spread over many tasks; their
    sizes, a row for each, are broadcast, so no task gets a whole flight to look its size up.
    """
    per = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), ((F.max("lat") - F.min("lat")) >= (F.max("lon") - F.min("lon"))).alias("_by_lat"),
    )
    size = lambda f: F.bround(F.col("_n") * F.lit(float(f)), 0).cast("long")
    per = per.select("*", size(test).alias("_nt"), size(val).alias("_nv"), size(buffer).alias("_nb"))
    axis = F.when(F.col("_by_lat"), F.col("lat")).otherwise(F.col("lon"))
    d = ranked(frames.join(F.broadcast(per), key).withColumn("_axis", axis), [key], [F.col("_axis"), F.col(tie)], "_r")
    top = F.col("_n") - F.col("_r")
    band = F.when(top <= F.col("_nt"), "test").when(top <= F.col("_nt") + F.col("_nv"), "val").when(F.col("_r") < F.col("_n") - F.col("_nt") - F.col("_nv") - F.col("_nb"), "train").otherwise("buffer")
    return d.withColumn("band", band).drop("_n", "_by_lat", "_nt", "_nv", "_nb", "_r", "_axis")
