"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langcrf import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int | None = None) -> DataFrame:
    """The documents of at most ``most`` labelled rows that aren't held out (crc32 of the id modulo 5 not 0), with their label.

    Rows are drawn by a hash of the id; null ids and labels are left out, an id that
    is labelled twice takes the larger label, and of an id that ``docs`` has several
    times the text of least hash is learned from, so there are at most ``most`` rows.
    ``most_bytes`` bounds the texts together: rows are taken in the order of the draw
    while they fit, whatever the size of each. The sample is broadcast: ``most`` ids
    bound it.
    """
    draw = F.xxhash64("doc_id", F.lit(5))
    d = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    d = d.orderBy(draw, "doc_id").limit(most)
    d = d.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(label).cast("int").alias("_y"))
    same = lambda d: docs.join(F.broadcast(d), F.col("doc_id") == F.col("_label_id"))
    if most_bytes is not None:
        sizes = same(d).groupBy("doc_id").agg(F.min_by(F.octet_length("text"), F.xxhash64("text")).alias("size")).orderBy(draw, "doc_id").collect()
        room, fits = most_bytes, []
        for r in sizes:
            if (r["size"] or 0) <= room:
                room -= r["size"] or 0
                fits.append((r["doc_id"],))
        d = d.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "_fits long")), F.col("_label_id") == F.col("_fits"), "left_semi")
    rest = [c for c in docs.columns if c.lower() != "doc_id"]
    d = same(d).groupBy("doc_id", "_y").agg(F.min_by(F.struct(*rest), F.xxhash64("text")).alias("_row"))
    return d.select("doc_id", "_row.*", "_y")
