"""Role views: how the generic tables stand in for the domain's tables.

Each view is a DataFrame function and, for the oracle, a DuckDB expression. Only
integer arithmetic and one division make the values, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(i: Column) -> tuple[Column, Column]:
    return (F.lit(30.0) + (i * 7919 % 100003) / F.lit(100003.0) * 0.04, F.lit(115.0) + (i * 104729 % 100003) / F.lit(100003.0) * 0.06)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    flight = F.lpad((F.col("user_id") % 9 + 1).cast("string"), 2, "0")
    lat, lon = _place(F.col("event_id"))
    return e.select(
        flight.alias("flight"), F.concat(flight, F.lit("_"), F.lpad(F.col("event_id").cast("string"), 7, "0"), F.lit(".JPG")).alias("filename"),
        F.col("event_id").alias("seq"), lat.alias("lat"), lon.alias("lon"), (300 + F.col("user_id") % 300).cast("double").alias("height"),
        (F.col("event_id") * 37 % 360 - 180).cast("double").alias("phi1"), F.col("value"),
    )


def match_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames(spark, sf_dir).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(METHODS - 1))))
    d = d.filter((F.col("seq") + F.col("m")) % 50 != 0)
    inl = (F.col("seq") * 31 + F.col("m") * 17) % 60
    gate = inl >= 7
    raw = F.col("value") * (1 + F.lit(0.1) * F.col("m"))
    return d.select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("method"), "flight", "filename", "seq", "lat", "lon", "height", inl.alias("inliers"),
        (inl + F.col("seq") % 40).alias("good"), raw.alias("raw_err_m"), F.when(gate, raw).alias("offset_m"), (F.col("seq") % 97 == 0).alias("skipped"),
        (F.col("seq") % 331 != 0).alias("gt_in_patch"), (50 + F.col("seq") % 700).cast("double").alias("t_match_ms"),
        F.when(gate, F.col("lat") + ((F.col("seq") * 13 + F.col("m")) % 41 - 20) / F.lit(100000.0)).alias("pred_lat"),
        F.when(gate, F.col("lon") + ((F.col("seq") * 17 + F.col("m")) % 37 - 18) / F.lit(100000.0)).alias("pred_lon"),
        (F.lit(0.8) + F.col("seq") % 41 / F.lit(100.0)).alias("h_scale"),
    )


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = _place(F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), lat.alias("lat"), lon.alias("lon"), F.col("embedding").alias("emb"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery(spark, sf_dir).filter("tile_id % 10 = 0").select(F.col("tile_id").alias("query_id"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.col("emb").alias("qemb"), F.col("label").alias("qlabel"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        k.cast("long").alias("map_id"), F.lit(30.035).alias("lt_lat"), (F.lit(115.0) + k / F.lit(100.0)).alias("lt_lon"), F.lit(30.005).alias("rb_lat"),
        (F.lit(115.0) + (k + 1) / F.lit(100.0)).alias("rb_lon"), F.lit(1000.0).alias("w"), F.lit(3000.0).alias("h"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<think>plan\nit</think> Dark green fields, "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("flight"), F.col("source").alias("file"), F.col("doc_id").alias("id"), t.alias("caption"))


def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("pair"), (c("l_orderkey") * 7 % 1024).cast("double").alias("x0"), (c("l_partkey") * 11 % 680).cast("double").alias("y0"),
        ((c("l_orderkey") * 7 + c("l_linenumber")) % 1024).cast("double").alias("x1"), ((c("l_partkey") * 11 + c("l_linenumber") * 3) % 680).cast("double").alias("y1"),
        c("l_discount").alias("conf"), c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"),
    )


PLACE = "30.0::DOUBLE + ({i}*7919 % 100003)/100003.0::DOUBLE*0.04::DOUBLE AS lat, 115.0::DOUBLE + ({i}*104729 % 100003)/100003.0::DOUBLE*0.06::DOUBLE AS lon"

SQL = {
    "frames": f"""SELECT flight, flight || '_' || lpad(CAST(event_id AS VARCHAR), 7, '0') || '.JPG' AS filename, event_id AS seq, lat, lon, height, phi1, value FROM (
      SELECT *, lpad(CAST(user_id % 9 + 1 AS VARCHAR), 2, '0') AS flight, {PLACE.format(i='event_id')}, CAST(300 + user_id % 300 AS DOUBLE) AS height, CAST(event_id*37 % 360 - 180 AS DOUBLE) AS phi1 FROM events)""",
    "match_results": """SELECT 'm' || CAST(m AS VARCHAR) AS method, flight, filename, seq, lat, lon, height, inliers, inliers + seq % 40 AS good, raw AS raw_err_m,
      CASE WHEN inliers >= 7 THEN raw END AS offset_m, seq % 97 = 0 AS skipped, seq % 331 <> 0 AS gt_in_patch, CAST(50 + seq % 700 AS DOUBLE) AS t_match_ms,
      CASE WHEN inliers >= 7 THEN lat + ((seq*13 + m) % 41 - 20)/100000.0::DOUBLE END AS pred_lat, CASE WHEN inliers >= 7 THEN lon + ((seq*17 + m) % 37 - 18)/100000.0::DOUBLE END AS pred_lon,
      0.8::DOUBLE + (seq % 41)/100.0::DOUBLE AS h_scale
      FROM (SELECT f.*, m, (seq*31 + m*17) % 60 AS inliers, value*(1 + 0.1::DOUBLE*m) AS raw FROM frames f, range(3) r(m) WHERE (seq + m) % 50 <> 0)""",
    "gallery": f"SELECT vec_id AS tile_id, {PLACE.format(i='vec_id')}, embedding AS emb, label FROM embeddings",
    "queries": "SELECT tile_id AS query_id, lat AS qlat, lon AS qlon, emb AS qemb, label AS qlabel FROM gallery WHERE tile_id % 10 = 0",
    "maps": "SELECT CAST(r_regionkey AS BIGINT) AS map_id, 30.035::DOUBLE AS lt_lat, 115.0::DOUBLE + r_regionkey/100.0::DOUBLE AS lt_lon, 30.005::DOUBLE AS rb_lat, 115.0::DOUBLE + (r_regionkey + 1)/100.0::DOUBLE AS rb_lon, 1000.0::DOUBLE AS w, 3000.0::DOUBLE AS h, 3000.0::DOUBLE/(30.035::DOUBLE - 30.005::DOUBLE) AS pplat, 1000.0::DOUBLE/((115.0::DOUBLE + (r_regionkey + 1)/100.0::DOUBLE) - (115.0::DOUBLE + r_regionkey/100.0::DOUBLE)) AS pplon FROM region",
    "captions": "SELECT lang AS flight, source AS file, doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '<think>plan' || chr(10) || 'it</think> Dark green fields, ' || text ELSE text END AS caption FROM documents",
    "correspondences": "SELECT l_suppkey AS pair, CAST(l_orderkey*7 % 1024 AS DOUBLE) AS x0, CAST(l_partkey*11 % 680 AS DOUBLE) AS y0, CAST((l_orderkey*7 + l_linenumber) % 1024 AS DOUBLE) AS x1, CAST((l_partkey*11 + l_linenumber*3) % 680 AS DOUBLE) AS y1, l_discount AS conf, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3 FROM lineitem",
    "scored": "SELECT * FROM match_results WHERE NOT coalesce(skipped, false)",
    "sims": "SELECT query_id, qlat, qlon, tile_id, lat, lon, round(list_inner_product(qemb::DOUBLE[], emb::DOUBLE[]), 6) AS sim, qlabel, label FROM queries, gallery WHERE query_id <> tile_id",
    "banded": """SELECT *, CASE WHEN n - r <= nt THEN 'test' WHEN n - r <= nt + nv THEN 'val' WHEN r < n - nt - nv - nb THEN 'train' ELSE 'buffer' END AS band FROM (
      SELECT f.*, s.n, nt, nv, nb, row_number() OVER (PARTITION BY f.flight ORDER BY CASE WHEN s.by_lat THEN lat ELSE lon END, filename) - 1 AS r FROM frames f JOIN (
        SELECT flight, count(*) AS n, max(lat) - min(lat) >= max(lon) - min(lon) AS by_lat, CAST(round_even(count(*)*0.25::DOUBLE, 0) AS BIGINT) AS nt, CAST(round_even(count(*)*0.1::DOUBLE, 0) AS BIGINT) AS nv, CAST(round_even(count(*)*0.05::DOUBLE, 0) AS BIGINT) AS nb FROM frames GROUP BY flight) s USING (flight))""",
}
NEEDS = {"match_results": ["frames"], "queries": ["gallery"], "scored": ["match_results"], "sims": ["queries", "gallery"], "banded": ["frames"]}


def sql(body: str, *views: str) -> str:
    """DuckDB SQL of ``body`` with the views that it names, and theirs, in front."""
    order: list[str] = []

    def add(v: str) -> None:
        for x in NEEDS.get(v, []):
            add(x)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    body = body.strip()
    head = ", ".join(f"{v} AS MATERIALIZED ({SQL[v]})" for v in order)
    if not head:
        return body
    again = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else ""
    body = ", " + body[5 + len(again) :] if body.upper().startswith("WITH ") else " " + body
    return f"WITH {again}{head}{body}"
