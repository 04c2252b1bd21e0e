"""Mixing sources to target weights by systematic sampling.

Native: DataFrame functions only. Inside a source every document is expected the
same number of copies (target / size of the source), so the prefix sum of expected
copies is that rate times the document's rank. One random offset per source is
added and a document comes out once for each integer crossed. Documents are ranked
by size, so the crossings spread evenly over sizes and a source's words come near
its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, with_rank

#: Contract values: weights of the sources in order, share of all words, most copies.
WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size) to each source's target.

    Sources in code point order, null last, take the weights in turn. A level is
    raised until the targets, level times weight but ``most`` times the source's
    size at most, sum to ``percent`` of all sizes: the fixed point of resharing the
    excess by weight. Sources sort by the level at which they stop; the level is
    the first that its own source does not stop. One row per source is held in one
    task (sources, not documents). Sums stay integral, so the result has one rounding.
    """
    if percent > 100 * most:
        raise ValueError("the targets' sum exceeds what the sources can give")
    byte_order = F.encode("source", "UTF-8").asc_nulls_last()
    one = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(one.orderBy(byte_order)) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    d = sizes.select("source", "source_size", w.alias("weight"))
    stop = one.orderBy((F.col("source_size") / F.col("weight")), byte_order)
    d = d.withColumn("_before", F.coalesce(F.sum("source_size").over(stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_open", F.sum("weight").over(stop.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_all", F.sum("source_size").over(one))
    left = (F.lit(percent) * F.col("_all") - F.lit(100 * most) * F.col("_before")).cast("double")
    d = d.withColumn("_level", left / (F.lit(100) * F.col("_open")).cast("double"))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    d = d.withColumn("_own", F.when(F.col("_level") <= full / F.col("weight"), F.col("_level")))
    d = d.withColumn("_at", F.coalesce(F.first("_own", ignorenulls=True).over(stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    return d.select("source", "source_size", "weight", F.least(full, F.col("_at") * F.col("weight")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number of [0, 1) per source: 16 bits of a digest, so sums with whole numbers stay exact."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit("")))), 1, 4), 16, 10).cast("double") / F.lit(65536.0)


def mix(df: DataFrame, seed: int = 10, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST, tie: tuple[str, ...] = ()) -> DataFrame:
    """Add source_size, target and copies to rows that have doc_id, source and size.

    copies is 0 to ``most``; nulls in source form a source of their own (last in
    order), null ids are ranked like others, repeated rows each have their own
    rank, rows of size 0 may be copied but add no words, an empty table gives no
    rows. Other columns pass through. The same rows give the same copies in every
    run; ``tie`` names columns that order rows of equal size and id.
    """
    total = targets(df.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
    total = total.select(F.col("source").alias("_source"), "source_size", "target")
    d = with_rank(df, [F.col("source")], [F.col("size"), F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), *[F.col(c) for c in tie]], "_rank")
    d = d.join(total, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    crossed = F.floor(rate * (F.col("_rank") + 1) + u) - F.floor(rate * F.col("_rank") + u)
    return d.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).drop("_rank")


def mix_documents(docs: DataFrame, seed: int = 10) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of whole documents; size counts words."""
    return _mixed(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _mixed(docs: DataFrame, seed: int) -> DataFrame:
    d = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("_th"))
    return mix(d, seed, tie=("_th",))


def take(docs: DataFrame, seed: int = 10) -> DataFrame:
    """The mix itself: each document's row as often as it is copied, with its columns as they are.

    Only ids, sizes and text hashes are ranked; the copies are joined back to the rows.
    Rows of equal id and text (or several without an id and of one text) cannot be told
    apart by that; a table that has such rows is ranked with its rows whole.
    """
    names = docs.columns
    d = _mixed(docs, seed).select("doc_id", "_th", "copies")
    twice = docs.select("doc_id", F.xxhash64("text").alias("_th")).groupBy("doc_id", "_th").count().filter("count > 1")
    if twice.take(1):
        d = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(*names).alias("_th"), F.struct(*names).alias("_row"))
        d = mix(d, seed, tie=("_th",)).filter("copies > 0").withColumn("_i", F.explode(F.expr("sequence(1L, copies)")))
        return d.select("_row.*")
    d = d.filter("copies > 0").select(F.col("doc_id").alias("_ov_id"), F.col("_th").alias("_ov_th"), F.col("copies").alias("_ov_copies"))
    # Missing ids join as one more value; plain equality, so that texts need no sort.
    null = F.lit(-1).cast("long")
    same = (F.coalesce(F.col("doc_id").cast("long"), null) == F.coalesce(F.col("_ov_id").cast("long"), null)) & (F.col("doc_id").isNull() == F.col("_ov_id").isNull()) & (F.xxhash64("text") == F.col("_ov_th"))
    return docs.join(d.hint("shuffle_hash"), same).withColumn("_ov_i", F.explode(F.expr("sequence(1L, _ov_copies)"))).select(*names)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () AS total FROM o
), v AS (
  SELECT *, CAST(150 * total - 200 * before AS DOUBLE) / CAST(100 * open_w AS DOUBLE) AS level FROM l
), t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(level, before) FROM v WHERE level <= CAST(2 * source_size AS DOUBLE) / weight)) AS target FROM v
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1 AS k,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5('10/' || coalesce(d.source, '')), 1, 4)) AS INTEGER) / 65536.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, least(CAST(floor(rate * (k + 1) + u) - floor(rate * k + u) AS BIGINT), 2) AS copies FROM r
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
