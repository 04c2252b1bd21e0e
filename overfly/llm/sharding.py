"""Sharding along a Hilbert curve over quantised metadata.

Native: DataFrame functions only. Each dimension is cut into equi-depth bins, the
bins' coordinates become a Hilbert index, rows are numbered along the curve, and
the numbering is cut into equal runs. Neighbours on the curve are neighbours in
every dimension, so a shard covers a small box of (source, language, size) and a
reader with min/max statistics can skip shards on any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import looked_up, with_rank


def hilbert_index(coords: list[int], bits: int) -> int:
    """The index of a cell on the Hilbert curve of ``len(coords)`` dimensions (Skilling's transposition)."""
    x, n = list(coords), len(coords)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return reduce(lambda out, b: reduce(lambda o, v: o << 1 | v >> b & 1, x, out), range(bits - 1, -1, -1), 0)


def curve(bins: list[Column], bits: int) -> Column:
    """Hilbert index of integer bin columns, looked up in a table of 2**(bits*dims) cells made here by rule."""
    if bits * len(bins) > 16:
        raise ValueError("bits * dimensions must be 16 or less")
    cells = range(1 << bits * len(bins))
    last = (1 << bits) - 1
    table = ",".join(str(hilbert_index([c >> bits * (len(bins) - 1 - i) & last for i in range(len(bins))], bits)) for c in cells)
    cell = reduce(lambda a, b: a * (1 << bits) + b, bins)
    return F.element_at(F.split(F.lit(table), ",").cast("array<int>"), (cell + 1).cast("int"))


def with_place(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: the place of a string among the table's distinct values by code point, as a double; null comes first.

    The values are numbered without a window over all of them, and the join back is one
    that adaptive execution can split where a value is hot.
    """
    values = with_rank(df.select(F.col(value).alias("_ov_v")).distinct(), [], [F.col("_ov_v").asc_nulls_first()], "_ov_place")
    return df.join(values, F.col(value).eqNullSafe(F.col("_ov_v"))).drop("_ov_v").withColumn(out, F.col("_ov_place").cast("double")).drop("_ov_place")


def hilbert_shards(df: DataFrame, dims: list[Column], size: Column, tie: list[Column], shards: int = 16, bits: int = 4, law: str = "rows") -> DataFrame:
    """Add ``curve``, ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    dims: numeric columns without nulls, quantised into 2**bits equi-depth bins.
    tie: orders rows inside a cell; identical rows may swap places.
    law: ``rows`` cuts runs whose counts differ by one at most; ``bytes`` cuts where
    the running sum of ``size`` passes each shard's share, so sizes differ by one
    row's size at most. Nulls, empty and very long texts need no special
    case: only their numbers are used. Repeated rows are rows of their own. Other
    columns pass through; ones named curve, shard or slot, in any case, are replaced.
    An empty table gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    n = 1 << bits
    dims = list(dims)
    df = df.select("*", *[c.alias(f"_ov_d{i}") for i, c in enumerate(dims)], size.alias("_ov_size"), *[c.alias(f"_ov_t{i}") for i, c in enumerate(tie)])
    df, dims, tie = df.drop("curve", "shard", "slot"), [F.col(f"_ov_d{i}") for i in range(len(dims))], [F.col(f"_ov_t{i}") for i in range(len(tie))]
    cuts = df.agg(*[F.percentile_approx(d, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(5000)).alias(f"d{i}") for i, d in enumerate(dims)]).first()
    bins = [reduce(lambda a, b: a + b, [(d > F.lit(float(c))).cast("int") for c in (cuts[i] or [0.0])]) for i, d in enumerate(dims)]
    d = df.withColumn("curve", curve(bins, bits))
    d = with_rank(d, [], [F.col("curve"), *tie], "_ov_rank", "_ov_total")
    if law == "rows":
        # Shard s takes ranks from ceil(s*N/S) on: counts differ by one at most.
        d = d.withColumn("shard", F.floor(F.col("_ov_rank") * shards / F.col("_ov_total")).cast("int"))
        d = d.withColumn("slot", F.col("_ov_rank") - F.ceil(F.col("shard") * F.col("_ov_total") / shards))
        return d.drop(*[c for c in d.columns if c.startswith("_ov_")])
    d = _by_bytes(d, shards)
    return d.drop(*[c for c in d.columns if c.startswith("_ov_")])


def _by_bytes(d: DataFrame, shards: int, block: int = 256) -> DataFrame:
    """Cut at running byte sums: block sums of the numbered rows are prefix-summed, then rows inside each block."""
    d = d.withColumn("_ov_block", F.floor(F.col("_ov_rank") / block))
    sums = d.groupBy("_ov_block").agg(F.sum("_ov_size").alias("_b")).withColumn("_super", F.floor(F.col("_ov_block") / 4096))
    supers = sums.groupBy("_super").agg(F.sum("_b").alias("_s"))
    w0 = Window.partitionBy(F.lit(0)).orderBy("_super")
    supers = supers.select("_super", F.coalesce(F.sum("_s").over(w0.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sb"), F.sum("_s").over(Window.partitionBy(F.lit(0))).alias("_ov_all"))
    w1 = Window.partitionBy("_super").orderBy("_ov_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_bb", F.coalesce(F.sum("_b").over(w1), F.lit(0))).join(supers, "_super")
    d = d.join(sums.select("_ov_block", (F.col("_bb") + F.col("_sb")).alias("_ov_before"), "_ov_all"), "_ov_block")
    w2 = Window.partitionBy("_ov_block").orderBy("_ov_rank").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_ov_before") + F.coalesce(F.sum("_ov_size").over(w2), F.lit(0))
    d = d.withColumn("shard", F.least(F.floor(at * shards / F.greatest(F.col("_ov_all"), F.lit(1))), F.lit(shards - 1)).cast("int"))
    firsts = d.groupBy("shard").agg(F.min("_ov_rank").alias("_ov_f"))
    return d.join(firsts, "shard").withColumn("slot", F.col("_ov_rank") - F.col("_ov_f"))


def shard_documents(docs: DataFrame, shards: int = 16, law: str = "rows") -> DataFrame:
    """Documents' shards by (source, lang, bytes): doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no ``key`` law).

    size is the text's UTF-8 bytes plus 1 (null text: 1); the checksum of a null
    text is that of the empty one. Equal texts follow one another on the curve, whatever
    their sources: a shard's end splits a group of copies only where it falls into it.
    Null sources and languages sort first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        "source", "lang", F.xxhash64(text).alias("_text"),
    )
    # Copies of a text go by the least source and language among them, so they share a cell; inside it equal texts stand together.
    same = d.groupBy("_text").agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    d = looked_up(d.drop("source", "lang"), same, "_text")
    d = with_place(with_place(d, "source", "_source"), "lang", "_lang")
    out = hilbert_shards(
        d, [F.col("_source"), F.col("_lang"), F.col("size").cast("double")], F.col("size"),
        [F.col("_text"), F.col("text_crc32"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("size")], shards, law=law,
    )
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
