"""Similarity search, ranks, recall and fusion queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import geo
from ..functions import vectors as V
from ..operators import fit, hamming, knn, recall, spatial
from ..registry import query
from .geometry import hav
from .views import frames, gallery, queries, sql

RADII = (1000, 3000)


def _truth(spark, d):
    """query_id, gt_id, floor_m: each query's ground-truth tile is the nearest centre but its own, however far."""
    g = gallery(spark, d).select("tile_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    q = queries(spark, d).select("query_id", "qlat", "qlon")
    near = spatial.nearest(q, g, "query_id", ("qlat", "qlon"), ("tlat", "tlon"), "tile_id", other=F.col("query_id") != F.col("tile_id"))
    return near.select("query_id", F.col("tile_id").alias("gt_id"), F.col("dist_m").alias("floor_m"))


GT = f"gt AS (SELECT query_id, gt_id, floor_m FROM (SELECT query_id, tile_id AS gt_id, {hav('qlat', 'qlon', 'lat', 'lon')} AS floor_m, row_number() OVER (PARTITION BY query_id ORDER BY {hav('qlat', 'qlon', 'lat', 'lon')}, tile_id) AS k FROM sims) WHERE k = 1)"
RANKED = "rk AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tile_id) - 1 AS rk, " + hav("qlat", "qlon", "lat", "lon") + " AS dist FROM sims s)"


def _rad(r):
    return f"r{r} AS (SELECT k.query_id, CASE WHEN max(CASE WHEN tile_id = gt_id THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN tile_id = gt_id THEN n END) ELSE -1 END AS rank{r} FROM (SELECT rk.*, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tile_id) - 1 AS n FROM rk WHERE dist <= {r}) k JOIN gt USING (query_id) GROUP BY k.query_id)"


RESULTS = f"WITH {GT}, {RANKED}, {_rad(RADII[0])}, {_rad(RADII[1])}, res AS (SELECT gt.query_id, gt.gt_id, gt.floor_m, rk.rk AS gt_tile_rank, coalesce(a.rank{RADII[0]}, -1) AS gt_rank_r{RADII[0]}, coalesce(b.rank{RADII[1]}, -1) AS gt_rank_r{RADII[1]} FROM gt JOIN rk ON rk.query_id = gt.query_id AND rk.tile_id = gt.gt_id LEFT JOIN r{RADII[0]} a ON a.query_id = gt.query_id LEFT JOIN r{RADII[1]} b ON b.query_id = gt.query_id)"


def res_sql(body: str) -> str:
    return sql(f"{RESULTS} {body}", "sims")


def ranks(spark, d, prior=None):
    """query_id, gt_id, floor_m, rank of the ground truth in the whole gallery and within each radius (-1: outside) of the query or of its ``prior``."""
    gt = _truth(spark, d)
    r = knn.truth_ranks(gallery(spark, d), queries(spark, d) if prior is None else prior, gt, RADII).drop("part", "gt_id")
    return gt.join(r, "query_id").select("query_id", "gt_id", "floor_m", F.col("rank").alias("gt_tile_rank"), *[F.col(f"rank_r{x}").alias(f"gt_rank_r{x}") for x in RADII])


@query(sql("SELECT query_id, tile_id, sim, CAST(rk AS INTEGER) AS rk FROM (SELECT query_id, tile_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tile_id) AS rk FROM sims) WHERE rk <= 5", "sims"))
def knn_topk(spark, d):
    return knn.top_k(gallery(spark, d), queries(spark, d), 5)


@query(sql("SELECT query_id, tile_id, sim, round((sim + 1)/2, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tile_id) AS k FROM sims) WHERE k = 1", "sims"))
def topk_sim(spark, d):
    return knn.top_k(gallery(spark, d), queries(spark, d), 1).select("query_id", "tile_id", "sim", F.round(V.unit_score(F.col("sim")), 6).alias("score"))


@query(res_sql("SELECT query_id, gt_id, round(floor_m, 4) AS floor_m, gt_tile_rank FROM res"))
def gt_rank(spark, d):
    return ranks(spark, d).select("query_id", "gt_id", F.round("floor_m", 4).alias("floor_m"), "gt_tile_rank")


@query(res_sql("SELECT query_id, gt_rank_r1000, gt_rank_r3000 FROM res"))
def radius_rank(spark, d):
    return ranks(spark, d).select("query_id", "gt_rank_r1000", "gt_rank_r3000")


SHIFTED = "sp AS (SELECT query_id, qlat + (query_id*29 % 161 - 80)/111320.0::DOUBLE AS plat, qlon + (query_id*13 % 161 - 80)/(111320.0::DOUBLE*cos(radians(qlat))) AS plon FROM queries), ps AS (SELECT s.*, " + hav("plat", "plon", "lat", "lon") + " AS pd FROM sims s JOIN sp USING (query_id)), pt AS (SELECT ps.query_id, ps.tile_id AS gid, ps.sim AS gs, ps.pd AS gd FROM ps JOIN gt ON ps.query_id = gt.query_id AND ps.tile_id = gt.gt_id)"


@query(sql(f"WITH {GT}, {SHIFTED} SELECT query_id, " + ", ".join(f"CASE WHEN max(gd) <= {r} THEN count(*) FILTER (WHERE pd <= {r} AND (sim > gs OR (sim = gs AND tile_id < gid))) ELSE -1 END AS gt_rank_r{r}" for r in RADII) + " FROM ps JOIN pt USING (query_id) GROUP BY query_id", "sims"))
def radius_rank_prior(spark, d):
    """Ranks within a radius of a prior that is some metres off (offsets that follow from the id)."""
    q = queries(spark, d)
    la, lo = geo.shifted_gps(F.col("qlat"), F.col("qlon"), (F.col("query_id") * 13 % 161 - 80).cast("double"), (F.col("query_id") * 29 % 161 - 80).cast("double"))
    return ranks(spark, d, q.withColumns({"_a": la, "_o": lo}).drop("qlat", "qlon").withColumnsRenamed({"_a": "qlat", "_o": "qlon"})).select("query_id", "gt_rank_r1000", "gt_rank_r3000")


@query()
def radius_rank_seeded(spark, d):
    """As ``radius_rank_prior`` with the benchmark's own prior: normal offsets seeded by the CRC-32 of flight and file name."""
    key = F.concat_ws("/", F.lpad((F.col("query_id") % 9 + 1).cast("string"), 2, "0"), F.concat(F.col("query_id").cast("string"), F.lit(".JPG")))
    q = fit.gaussian_offsets(queries(spark, d), key, K.PRIOR_SIGMA_M)
    la, lo = geo.shifted_gps(F.col("qlat"), F.col("qlon"), F.col("dx_m"), F.col("dy_m"))
    q = q.withColumns({"_a": la, "_o": lo}).drop("qlat", "qlon", "dx_m", "dy_m").withColumnsRenamed({"_a": "qlat", "_o": "qlon"})
    return ranks(spark, d, q).select("query_id", "gt_rank_r1000", "gt_rank_r3000")


@query(sql(f"WITH {RANKED} SELECT query_id, bool_or(dist <= 800) AS top5_hit FROM rk WHERE rk < 5 GROUP BY query_id", "sims"))
def topk_hit(spark, d):
    k = knn.top_k(gallery(spark, d), queries(spark, d), 5)
    g = gallery(spark, d).select("tile_id", "lat", "lon")
    q = queries(spark, d).select("query_id", "qlat", "qlon")
    dist = geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    return k.join(g, "tile_id").join(q, "query_id").groupBy("query_id").agg(F.bool_or(dist <= 800).alias("top5_hit"))


def _recall_sql(policy):
    den = {"exclude": "count(*) FILTER (WHERE rank >= 0)", "miss": "count(*)", "legacy": "count(*)"}[policy]
    hit = {"exclude": "rank >= 0 AND rank < {k}", "miss": "rank >= 0 AND rank < {k}", "legacy": "rank < {k}"}[policy]
    cols = ", ".join(f"round(count(*) FILTER (WHERE {hit.format(k=k)})*100.0::DOUBLE/nullif({den}, 0), 6) AS r{k}" for k in (1, 5, 10))
    return res_sql(f", m AS (SELECT CAST(query_id % 9 + 1 AS VARCHAR) AS flight, unnest(['denied', 'r1000', 'r3000']) AS mode, unnest([gt_tile_rank, gt_rank_r1000, gt_rank_r3000]) AS rank FROM res) SELECT flight, mode, count(*) AS n_rows, count(*) FILTER (WHERE rank >= 0) AS n_valid, {cols} FROM m GROUP BY ALL")


def _modes(spark, d):
    return recall.unpivot_modes(ranks(spark, d).withColumn("flight", (F.col("query_id") % 9 + 1).cast("string")), ["flight", "query_id"])


@query(_recall_sql("exclude"))
def recall_exclude(spark, d):
    return recall.summary(_modes(spark, d), ["flight", "mode"], "exclude")


@query(_recall_sql("miss"))
def recall_miss(spark, d):
    return recall.summary(_modes(spark, d), ["flight", "mode"], "miss")


@query(_recall_sql("legacy"))
def recall_legacy(spark, d):
    return recall.summary(_modes(spark, d), ["flight", "mode"], "legacy")


@query(res_sql(", m AS (SELECT query_id % 9 + 1 AS flight, count(*) FILTER (WHERE gt_tile_rank < 10)*100.0::DOUBLE/count(*) AS r10, count(*) FILTER (WHERE gt_tile_rank < 100)*100.0::DOUBLE/count(*) AS r100 FROM res GROUP BY 1) SELECT round(avg(r10), 4) AS r10, round(avg(r100), 4) AS r100, count(*) AS flights FROM m"))
def recall_macro(spark, d):
    """Mean over flights of each flight's recall."""
    g = _modes(spark, d).filter("mode = 'denied'").groupBy("flight").agg(recall.recall(F.col("rank"), 10).alias("r10"), recall.recall(F.col("rank"), 100).alias("r100"))
    return g.agg(F.round(F.avg("r10"), 4).alias("r10"), F.round(F.avg("r100"), 4).alias("r100"), F.count(F.lit(1)).alias("flights"))


#: Log-spaced points of the whole curve, before equal ones fall together.
POINTS = 200


@query(res_sql(f", t AS (SELECT max(gt_tile_rank) + 1 AS m FROM res), c AS (SELECT DISTINCT CAST(round(pow(10.0::DOUBLE, i*log10(m)/{POINTS - 1})) AS BIGINT) AS k FROM t, range({POINTS}) s(i)) SELECT k, round(count(*) FILTER (WHERE gt_tile_rank < k)*100.0::DOUBLE/count(*), 6) AS recall FROM res, c GROUP BY k"))
def recall_curve(spark, d):
    """Recall at unique log-spaced k from 1 to the largest rank + 1.

    Ranks are counted between neighbouring k first, so at most 201 rows are summed up.
    """
    r = knn.truth_ranks(gallery(spark, d), queries(spark, d), _truth(spark, d)).select("rank")
    top = r.agg((F.max("rank") + 1).alias("m"))
    k = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.round(F.pow(F.lit(10.0), i * F.log10("m") / (POINTS - 1))).cast("long"))
    ks = top.select(F.array_sort(F.array_distinct(k)).alias("ks"))
    # The place of the first k that a rank is below.
    at = r.join(F.broadcast(ks), F.lit(True)).groupBy(F.size(F.filter("ks", lambda x: x <= F.col("rank"))).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    pts = ks.select(F.posexplode("ks").alias("j", "k")).join(F.broadcast(at), F.lit(True))
    return pts.groupBy("k").agg(F.round(F.sum(F.when(F.col("at") <= F.col("j"), F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 6).alias("recall"))


@query(res_sql(", t AS (SELECT query_id, max(sim) FILTER (WHERE rk = 0) AS top, max(dist) FILTER (WHERE rk = 0) AS off, bool_or(dist <= 800) AS hit FROM rk WHERE rk < 5 GROUP BY 1) SELECT count(*) AS n, " + ", ".join(f"round(count(*) FILTER (WHERE off <= {100 * t})*100.0::DOUBLE/count(*), 6) AS a{t}" for t in K.THRESHOLDS) + ", round(avg(off) FILTER (WHERE off <= 2000), 4) AS mean_near, round(count(*) FILTER (WHERE hit)*100.0::DOUBLE/count(*), 6) AS top5_hit, round(median(floor_m), 4) AS floor_median, round(quantile_cont(floor_m, 0.9), 4) AS floor_p90, round(avg(off), 4) AS off_mean, round(median(off), 4) AS off_median, round(quantile_cont(off, 0.9), 4) AS off_p90, round(max(off), 4) AS off_max, round(avg(top) FILTER (WHERE off <= 2000), 6) AS sim_success, round(avg(top) FILTER (WHERE off > 2000), 6) AS sim_fail, round(median(gt_tile_rank), 4) AS median_rank FROM res JOIN t USING (query_id)"))
def retrieval_summary(spark, d):
    """The summary of a retrieval run: A@t of the first tile, mean error of the near ones, top-5 hits, floor, offsets, similarities and the median rank.

    Thresholds are a hundred times the benchmark's, as this gallery's tiles lie that much farther apart.
    """
    g, q = gallery(spark, d).select("tile_id", "lat", "lon"), queries(spark, d).select("query_id", "qlat", "qlon")
    dist = geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    first = F.col("rk") == 1
    top = knn.top_k(gallery(spark, d), queries(spark, d), 5).join(g, "tile_id").join(q, "query_id").withColumn("dist", dist)
    top = top.groupBy("query_id").agg(F.max(F.when(first, F.col("sim"))).alias("top"), F.max(F.when(first, F.col("dist"))).alias("off"), F.bool_or(F.col("dist") <= 800).alias("hit"))
    x = ranks(spark, d).join(top, "query_id")
    off, share = F.col("off"), lambda c: F.round(F.count_if(c) * 100.0 / F.count(F.lit(1)), 6)
    near = off <= 2000
    return x.agg(
        F.count(F.lit(1)).alias("n"), *[share(off <= 100 * t).alias(f"a{t}") for t in K.THRESHOLDS], F.round(F.avg(F.when(near, off)), 4).alias("mean_near"), share(F.col("hit")).alias("top5_hit"),
        F.round(F.median("floor_m"), 4).alias("floor_median"), F.round(F.percentile("floor_m", 0.9), 4).alias("floor_p90"), F.round(F.avg(off), 4).alias("off_mean"), F.round(F.median(off), 4).alias("off_median"),
        F.round(F.percentile(off, 0.9), 4).alias("off_p90"), F.round(F.max(off), 4).alias("off_max"), F.round(F.avg(F.when(near, F.col("top"))), 6).alias("sim_success"), F.round(F.avg(F.when(~near, F.col("top"))), 6).alias("sim_fail"),
        F.round(F.median("gt_tile_rank"), 4).alias("median_rank"),
    )


TABLE_KS = (1, 3, 5, 10)


def _table_sql():
    fused = "f AS (SELECT tile_id, lat, lon, alpha, " + PART.format(v="mix") + f" AS v FROM (SELECT tile_id, lat, lon, alpha, list_transform(range(1, 65), lambda i: alpha*emb[i] + (1 - alpha)*emb[65 - i]) AS mix FROM gallery, (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha)))"
    pairs = f"b AS (SELECT q.alpha, q.tile_id AS qid, g.tile_id AS tid, gt_id, round(list_inner_product(q.v, g.v), 6) AS s, {hav('q.lat', 'q.lon', 'g.lat', 'g.lon')} AS dist FROM f q JOIN gt ON gt.query_id = q.tile_id JOIN f g ON q.alpha = g.alpha AND q.tile_id <> g.tile_id), t AS (SELECT *, max(CASE WHEN tid = gt_id THEN s END) OVER w AS gs, max(CASE WHEN tid = gt_id THEN dist END) OVER w AS gd FROM b WINDOW w AS (PARTITION BY alpha, qid))"
    better = "s > gs OR (s = gs AND tid < gt_id)"
    rank = f"r AS (SELECT alpha, qid, count(*) FILTER (WHERE {better}) AS rank, " + ", ".join(f"CASE WHEN max(gd) <= {r} THEN count(*) FILTER (WHERE dist <= {r} AND ({better})) ELSE -1 END AS rank_r{r}" for r in RADII) + " FROM t GROUP BY alpha, qid)"
    cells = ", ".join(f"round(count(*) FILTER (WHERE rank < {k})*100.0::DOUBLE/count(*), 6) AS r{k}" for k in TABLE_KS) + ", " + ", ".join(f"round(count(*) FILTER (WHERE rank_r{r} = 0)*100.0::DOUBLE/nullif(count(*) FILTER (WHERE rank_r{r} >= 0), 0), 6) AS r1_{r}" for r in RADII)
    return sql(f"WITH {GT}, {fused}, {pairs}, {rank}, g AS (SELECT 'blend ' || CAST(alpha AS VARCHAR) AS model, count(*) AS n, {cells} FROM r GROUP BY alpha) SELECT *, " + ", ".join(f"r{k} = max(r{k}) OVER () AS best{k}" for k in TABLE_KS) + " FROM g", "sims")


@query(sql("SELECT bin, same, n, round(n/sum(n) OVER (PARTITION BY same)::DOUBLE, 6) AS share FROM (SELECT least(29, CAST(floor((sim + 1)*15) AS BIGINT)) AS bin, qlabel = label AS same, count(*) AS n FROM sims GROUP BY 1, 2)", "sims"))
def sim_hist(spark, d):
    """Histogram of similarities in 30 bins over [-1, 1], by whether the labels agree."""
    g = knn.histogram(gallery(spark, d), queries(spark, d), 30)
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("same")), 6))


@query(res_sql(", t AS (SELECT query_id, max(sim) AS top FROM rk WHERE rk = 0 GROUP BY 1), x AS (SELECT top, gt_tile_rank = 0 AS hit, min(top) OVER () AS lo, (max(top) OVER () - min(top) OVER ())/29 AS width FROM res JOIN t USING (query_id)), b AS (SELECT hit, CAST(CASE WHEN width > 0 THEN least(28, floor((top - lo)/width)) ELSE 0 END AS BIGINT) AS bin, any_value(width) AS width, count(*) AS n FROM x GROUP BY 1, 2) SELECT hit, bin, n, round(n/(sum(n) OVER (PARTITION BY hit)*nullif(width, 0)), 4) AS density FROM b"))
def confidence_hist(spark, d):
    """Densities of the first tile's similarity in 29 bins between its extremes, for right and wrong first tiles."""
    top = knn.top_k(gallery(spark, d), queries(spark, d), 1).select("query_id", F.col("sim").alias("top"))
    x = ranks(spark, d).join(top, "query_id").select("top", (F.col("gt_tile_rank") == 0).alias("hit"))
    ends = x.agg(F.min("top").alias("lo"), ((F.max("top") - F.min("top")) / 29).alias("width"))
    place = F.when(F.col("width") > 0, F.least(F.lit(28), F.floor((F.col("top") - F.col("lo")) / F.col("width")))).otherwise(0).cast("long")
    g = x.join(F.broadcast(ends), F.lit(True)).groupBy("hit", place.alias("bin")).agg(F.max("width").alias("width"), F.count(F.lit(1)).alias("n"))
    # Windows over 58 bins at most.
    return g.select("hit", "bin", "n", F.round(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("hit")) * F.col("width")), 4).alias("density"))


@query(sql("SELECT query_id, best AS tile_id, s1, s2 FROM (SELECT query_id, max(CASE WHEN k = 1 THEN tile_id END) AS best, max(CASE WHEN k = 1 THEN round(1 - sim, 6) END) AS s1, max(CASE WHEN k = 2 THEN round(1 - sim, 6) END) AS s2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tile_id) AS k FROM sims) WHERE k <= 2 GROUP BY query_id HAVING count(*) = 2) WHERE s1 < 0.95::DOUBLE*s2", "sims"))
def ratio_test(spark, d):
    """Keep a query's best match if it is clearly nearer than the second."""
    k = knn.top_k(gallery(spark, d), queries(spark, d), 2)
    dist = lambda i: F.max(F.when(F.col("rk") == i, F.round(1 - F.col("sim"), 6)))
    g = k.groupBy("query_id").agg(F.max(F.when(F.col("rk") == 1, F.col("tile_id"))).alias("tile_id"), dist(1).alias("s1"), dist(2).alias("s2"))
    return g.filter(F.col("s2").isNotNull() & (F.col("s1") < F.col("s2") * 0.95))


# A binary descriptor of 128 bits from a vector: which components are positive, and which exceed the next one.
BITS = "codes AS MATERIALIZED (SELECT tile_id, list_transform(range(0, 4), lambda p: CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN CASE WHEN p < 2 THEN emb[32*p + i] > 0 ELSE emb[32*(p - 2) + i] > emb[(32*(p - 2) + i) % 64 + 1] END THEN 1::BIGINT << (i - 1) ELSE 0 END)) AS BIGINT)) AS c FROM gallery)"


@query(sql(f"WITH {BITS}, p AS (SELECT q.tile_id AS query_id, g.tile_id, " + " + ".join(f"bit_count(xor(q.c[{i}], g.c[{i}]))" for i in range(1, 5)) + " AS dist FROM codes q JOIN codes g ON q.tile_id <> g.tile_id WHERE q.tile_id % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, tile_id) AS k FROM p) SELECT query_id, max(CASE WHEN k = 1 THEN tile_id END) AS tile_id, CAST(max(CASE WHEN k = 1 THEN dist END) AS INTEGER) AS d1, CAST(max(CASE WHEN k = 2 THEN dist END) AS INTEGER) AS d2, max(CASE WHEN k = 1 THEN dist END) < 0.75::DOUBLE*max(CASE WHEN k = 2 THEN dist END) AS good FROM r WHERE k <= 2 GROUP BY query_id HAVING count(*) = 2", "gallery"))
def hamming_ratio(spark, d):
    """Binary descriptors' two nearest by Hamming distance, and whether the first is clearly nearer."""
    up = lambda x, i: x > F.element_at("emb", F.pmod(i + 1, F.size("emb")) + 1)
    g = gallery(spark, d).select(F.col("tile_id").alias("id"), hamming.packed(F.concat(F.transform("emb", lambda x: x > 0), F.transform("emb", up))).alias("code"))
    found = hamming.nearest(g, g.filter("id % 10 = 0").withColumnRenamed("id", "query_id"), words=2)
    return hamming.ratio(found, K.HAMMING_RATIO).withColumnRenamed("id", "tile_id")


@query(sql("SELECT query_id, tile_id, sim, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sim + 1)/2)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tile_id) AS a, row_number() OVER (PARTITION BY tile_id ORDER BY sim DESC, query_id) AS b FROM sims) WHERE a = 1 AND b = 1", "sims"))
def mutual_nn(spark, d):
    """Pairs that are each other's best: each task keeps maxima of both sides, then one join."""
    return knn.mutual(gallery(spark, d), queries(spark, d)).withColumn("score", F.round(V.unit_score(F.col("sim")), 6))


PART = "list_transform({v}::DOUBLE[], lambda x: x/(sqrt(list_inner_product({v}::DOUBLE[], {v}::DOUBLE[])) + 1e-12))"


def _text_vec():
    """A stand-in text vector: the image vector turned round."""
    return F.reverse("emb")


@query(sql("SELECT tile_id, round(list_sum(list_transform(range(1, 65), lambda i: f[i]*i)), 6) AS moment, round(f[1], 6) AS first FROM (SELECT tile_id, " + PART.format(v="mix") + " AS f FROM (SELECT tile_id, CASE WHEN tile_id % 3 = 0 THEN emb::DOUBLE[] ELSE list_transform(range(1, 65), lambda i: 0.8::DOUBLE*emb[i] + 0.2::DOUBLE*emb[65 - i]) END AS mix FROM gallery))", "gallery"))
def fuse_gallery(spark, d):
    """Blend tile vectors with caption vectors; tiles without a caption keep the image vector."""
    fused = F.when(F.col("tile_id") % 3 == 0, V.normalise(F.col("emb"))).otherwise(V.fuse(F.col("emb"), _text_vec(), F.lit(0.8)))
    g = gallery(spark, d).select("tile_id", fused.alias("f"))
    return g.select("tile_id", F.round(F.aggregate(F.transform("f", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("moment"), F.round(F.col("f")[0], 6).alias("first"))


@query(sql("SELECT query_id, query_id % 20 <> 0 AS has_caption, round(list_sum(list_transform(range(1, 65), lambda i: f[i]*i)), 6) AS moment FROM (SELECT query_id, " + PART.format(v="mix") + " AS f FROM (SELECT query_id, CASE WHEN query_id % 20 = 0 THEN qemb::DOUBLE[] ELSE list_transform(range(1, 65), lambda i: 0.7::DOUBLE*qemb[i] + 0.3::DOUBLE*qemb[65 - i]) END AS mix FROM queries))", "queries"))
def fuse_query(spark, d):
    """A query's caption vector joins in where there is one."""
    q = queries(spark, d)
    cap = q.filter("query_id % 20 <> 0").select("query_id", F.reverse("qemb").alias("tvec"))
    f = F.when(F.col("tvec").isNull(), V.normalise(F.col("qemb"))).otherwise(V.fuse(F.col("qemb"), F.col("tvec"), F.lit(0.7)))
    x = q.join(cap, "query_id", "left").select("query_id", F.col("tvec").isNotNull().alias("has_caption"), f.alias("f"))
    return x.select("query_id", "has_caption", F.round(F.aggregate(F.transform("f", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 6).alias("moment"))


ALPHAS = [0.5, 0.75, 1.0]


def _pairs(spark, d):
    """Gallery and stated queries with a second vector each."""
    g = gallery(spark, d).withColumn("other", _text_vec())
    return g, queries(spark, d).withColumn("qother", F.reverse("qemb"))


SWEEP_KS = (1, 3, 5, 10)


@query(sql(f"WITH {GT}, f AS (SELECT tile_id, alpha, " + PART.format(v="mix") + f" AS v FROM (SELECT tile_id, alpha, list_transform(range(1, 65), lambda i: alpha*emb[i] + (1 - alpha)*emb[65 - i]) AS mix FROM gallery, (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha))), b AS (SELECT q.alpha, q.tile_id AS qid, g.tile_id AS tid, gt_id, round(list_inner_product(q.v, g.v), 6) AS s FROM f q JOIN gt ON gt.query_id = q.tile_id JOIN f g ON q.alpha = g.alpha AND q.tile_id <> g.tile_id), t AS (SELECT *, max(CASE WHEN tid = gt_id THEN s END) OVER (PARTITION BY alpha, qid) AS gs FROM b), r AS (SELECT alpha, qid, count(*) FILTER (WHERE s > gs OR (s = gs AND tid < gt_id)) AS rank FROM t GROUP BY alpha, qid) SELECT alpha, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (WHERE rank < {k})*100.0::DOUBLE/count(*), 6) AS r{k}" for k in SWEEP_KS) + " FROM r GROUP BY alpha", "sims"))
def alpha_sweep(spark, d):
    """Recall of the stated query set in the whole gallery for each blend weight: one gallery scan for all weights, blended inside its matrix products."""
    g, q = _pairs(spark, d)
    x = knn.truth_ranks(g, q, _truth(spark, d), weights=ALPHAS).withColumnRenamed("part", "alpha")
    return x.groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), *[recall.recall(F.col("rank"), k).alias(f"r{k}") for k in SWEEP_KS])


@query(_table_sql())
def retrieval_table(spark, d):
    """One row a model: recall in the whole gallery and of the first tile within each radius, with the best cell of each column marked."""
    g, q = _pairs(spark, d)
    x = knn.truth_ranks(g, q, _truth(spark, d), RADII, ALPHAS)
    x = x.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[recall.recall(F.col("rank"), k).alias(f"r{k}") for k in TABLE_KS], *[recall.recall(F.col(f"rank_r{r}"), 1).alias(f"r1_{r}") for r in RADII])
    # One row a model: the window over all of them is over a table of models.
    best = {f"best{k}": F.col(f"r{k}") == F.max(f"r{k}").over(Window.partitionBy(F.lit(0))) for k in TABLE_KS}
    return x.withColumn("model", F.concat(F.lit("blend "), F.col("part").cast("string"))).drop("part").withColumns(best)


@query(sql("SELECT coalesce(CAST(label AS VARCHAR), 'ALL') AS flight, count(*) AS n, round(avg(c0), 6) AS stock, round(avg(c1), 6) AS tuned, round(avg(c1) - avg(c0), 6) AS delta FROM (SELECT label, list_inner_product(e, o)/(sqrt(list_inner_product(e, e))*sqrt(list_inner_product(o, o))) AS c0, list_inner_product(e, m)/(sqrt(list_inner_product(e, e))*sqrt(list_inner_product(m, m))) AS c1 FROM (SELECT label, emb::DOUBLE[] AS e, list_reverse(emb::DOUBLE[]) AS o, list_transform(range(1, 65), lambda i: 0.5::DOUBLE*emb[i] + 0.5::DOUBLE*emb[65 - i]) AS m FROM gallery)) GROUP BY GROUPING SETS ((label), ())", "gallery"))
def crossview_delta(spark, d):
    """Mean cross-view cosine of two models, by flight and over all, and how much the second one gains."""
    x = gallery(spark, d).select(F.col("label").cast("string").alias("flight"), V.cosine(F.col("emb"), _text_vec()).alias("c0"), V.cosine(F.col("emb"), V.fuse(F.col("emb"), _text_vec(), F.lit(0.5))).alias("c1"))
    g = x.rollup("flight").agg(F.count(F.lit(1)).alias("n"), F.avg("c0").alias("a"), F.avg("c1").alias("b"))
    return g.select(F.coalesce("flight", F.lit("ALL")).alias("flight"), "n", F.round("a", 6).alias("stock"), F.round("b", 6).alias("tuned"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query(sql("SELECT coalesce(CAST(label AS VARCHAR), 'ALL') AS flight, count(*) AS n, round(avg(c), 6) AS mean_cos FROM (SELECT label, list_inner_product(emb::DOUBLE[], list_reverse(emb::DOUBLE[]))/(list_inner_product(emb::DOUBLE[], emb::DOUBLE[])) AS c FROM gallery) GROUP BY GROUPING SETS ((label), ())", "gallery"))
def crossview_cosine(spark, d):
    x = gallery(spark, d).select(F.col("label").cast("string").alias("flight"), V.cosine(F.col("emb"), _text_vec()).alias("c"))
    return x.rollup("flight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_cos")).withColumn("flight", F.coalesce("flight", F.lit("ALL")))


@query(sql("SELECT tile_id, round(list_sum(list_transform(emb::DOUBLE[], lambda x: sqrt(abs(x)/s))), 6) AS total FROM (SELECT *, list_sum(list_transform(emb::DOUBLE[], lambda x: abs(x))) + 1e-8 AS s FROM gallery)", "gallery"))
def rootsift(spark, d):
    return gallery(spark, d).select("tile_id", F.round(F.aggregate(V.root_l1(F.col("emb")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(sql("SELECT tile_id, round(list_inner_product(a, b)/(sqrt(list_inner_product(a, a))*sqrt(list_inner_product(b, b))), 6) AS ncc FROM (SELECT tile_id, list_transform(emb::DOUBLE[], lambda x: x - list_sum(emb::DOUBLE[])/64) AS a, list_transform(list_reverse(emb::DOUBLE[]), lambda x: x - list_sum(list_reverse(emb::DOUBLE[]))/64) AS b FROM gallery)", "gallery"))
def ncc(spark, d):
    return gallery(spark, d).select("tile_id", F.round(V.ncc(F.col("emb"), _text_vec()), 6).alias("ncc"))


#: Rows of a batch (by tile_id), scale of its logits, and metres within which two rows are no negatives of each other.
BATCH, SCALE, NEAR_M = 256, 10.0, 100.0
FLAT = "sqrt(pow((a.lon - b.lon)*111320.0::DOUBLE*cos(radians((a.lat + b.lat)/2)), 2) + pow((a.lat - b.lat)*110540.0::DOUBLE, 2))"


def _nce(side):
    return f"SELECT {side} AS id, ln(sum(exp(z)) FILTER (WHERE NOT masked)) - max(CASE WHEN a_id = b_id THEN z END) AS loss FROM p GROUP BY {side}"


@query(sql(f"WITH g AS (SELECT *, tile_id // {BATCH} AS batch FROM gallery), p AS (SELECT a.tile_id AS a_id, b.tile_id AS b_id, {SCALE}::DOUBLE*list_inner_product(a.emb::DOUBLE[], b.emb::DOUBLE[]) AS z, a.tile_id <> b.tile_id AND {FLAT} <= {NEAR_M} AS masked FROM g a JOIN g b USING (batch)), r AS ({_nce('a_id')}), c AS ({_nce('b_id')}) SELECT count(*) AS n, (SELECT CAST(count(*) AS BIGINT) FROM p WHERE masked) AS n_masked, round(avg(r.loss), 5) AS row_loss, round(avg(c.loss), 5) AS col_loss, round((avg(r.loss) + avg(c.loss))/2, 5) AS loss FROM r JOIN c USING (id)", "gallery"))
def infonce_loss(spark, d):
    return info_nce(gallery(spark, d))


def info_nce(g):
    """Symmetric InfoNCE over all rows (tile_id, lat, lon, emb), in batches of 256 consecutive ids.

    Each direction is log-sum-exp minus the diagonal's logit; pairs of a batch
    within 100 m (the diagonal apart) are masked. Losses are means over rows.
    """
    lon_m, lat_m = K.DEGREE_M, K.LATITUDE_M

    def run(t: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        n = t.num_rows
        lat, lon = np.asarray(t.column("lat")), np.asarray(t.column("lon"))
        x = np.asarray(t.column("emb").combine_chunks().flatten()).astype(np.float64).reshape(n, -1)
        z = SCALE * (x @ x.T)
        east = (lon[:, None] - lon) * lon_m * np.cos(np.radians((lat[:, None] + lat) / 2))
        masked = np.hypot(east, (lat[:, None] - lat) * lat_m) <= NEAR_M
        np.fill_diagonal(masked, False)
        own = np.diagonal(z).copy()
        z[masked] = -np.inf
        loss = []
        for axis in (1, 0):
            top = z.max(axis=axis)
            loss.append(top + np.log(np.exp(z - np.expand_dims(top, axis)).sum(axis=axis)) - own)
        return pa.table({"n": [n], "n_masked": [int(masked.sum())], "r": [float(loss[0].sum())], "c": [float(loss[1].sum())]})

    g = g.select("lat", "lon", "emb", F.floor(F.col("tile_id") / BATCH).alias("batch"))
    x = g.groupBy("batch").applyInArrow(run, "n long, n_masked long, r double, c double").agg(*[F.sum(k).alias(k) for k in ("n", "n_masked", "r", "c")])
    mean = lambda v: F.round(v / F.col("n"), 5)
    return x.select("n", "n_masked", mean(F.col("r")).alias("row_loss"), mean(F.col("c")).alias("col_loss"), mean((F.col("r") + F.col("c")) / 2).alias("loss"))


CAND = "cand AS (SELECT query_id, tile_id, sim, k AS clip_rank, (query_id*7 + tile_id*13) % 90 AS inliers, " + hav("qlat", "qlon", "lat", "lon") + " AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, tile_id) AS k FROM sims) WHERE k <= 20)"


def candidates(spark, d):
    g = gallery(spark, d).select("tile_id", "lat", "lon")
    q = queries(spark, d).select("query_id", "qlat", "qlon")
    k = knn.top_k(gallery(spark, d), queries(spark, d), 20).withColumnRenamed("rk", "clip_rank")
    dist = geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    return k.join(g, "tile_id").join(q, "query_id").select("query_id", "tile_id", "sim", "clip_rank", ((F.col("query_id") * 7 + F.col("tile_id") * 13) % 90).alias("inliers"), dist.alias("dist"))


STATS = f"WITH {CAND}, st AS (SELECT query_id, max(inliers) FILTER (WHERE clip_rank = 1) AS top1_inliers, max(dist) FILTER (WHERE clip_rank = 1) AS top1_dist, max(inliers) AS best_inliers, arg_max(clip_rank, (inliers, -clip_rank)) AS best_rank, arg_max(dist, (inliers, -clip_rank)) AS best_dist FROM cand GROUP BY 1), qs AS (SELECT st.*, 1 + (SELECT count(*) FROM cand c WHERE c.query_id = st.query_id AND c.inliers > top1_inliers) AS rank_of_top1, best_inliers - top1_inliers AS gap FROM st)"


def stats(spark, d):
    c = candidates(spark, d)
    first = F.col("clip_rank") == 1
    order = F.struct("inliers", -F.col("clip_rank"))
    w = Window.partitionBy("query_id")
    c = c.withColumn("t1", F.max(F.when(first, F.col("inliers"))).over(w))
    return c.groupBy("query_id").agg(
        F.max("t1").alias("top1_inliers"), F.max(F.when(first, F.col("dist"))).alias("top1_dist"), F.max("inliers").alias("best_inliers"), F.max_by("clip_rank", order).alias("best_rank"),
        F.max_by("dist", order).alias("best_dist"), (F.count_if(F.col("inliers") > F.col("t1")) + 1).alias("rank_of_top1"),
    ).withColumn("gap", F.col("best_inliers") - F.col("top1_inliers"))


@query(sql(f"{STATS} SELECT query_id, top1_inliers, round(top1_dist, 4) AS top1_dist, best_inliers, best_rank, round(best_dist, 4) AS best_dist, rank_of_top1, gap FROM qs", "sims"))
def query_stats(spark, d):
    return stats(spark, d).withColumns({"top1_dist": F.round("top1_dist", 4), "best_dist": F.round("best_dist", 4)})


@query(sql(f"{STATS} SELECT count(*) AS n, round(avg(CASE WHEN best_rank = 1 THEN 100.0::DOUBLE ELSE 0 END), 6) AS agree, round(avg(CASE WHEN top1_dist <= 800 THEN 100.0::DOUBLE ELSE 0 END), 6) AS a_clip, round(avg(CASE WHEN best_dist <= 800 THEN 100.0::DOUBLE ELSE 0 END), 6) AS a_oracle, round(avg(CASE WHEN gap >= 5 THEN 100.0::DOUBLE ELSE 0 END), 6) AS gap5, round((SELECT corr(sim, inliers) FROM cand), 5) AS pearson FROM qs", "sims"))
def matchability_summary(spark, d):
    pct = lambda c: F.round(F.count_if(c) * 100.0 / F.count(F.lit(1)), 6)
    c = candidates(spark, d).agg(F.round(F.corr("sim", "inliers"), 5).alias("pearson"))
    s = stats(spark, d).agg(F.count(F.lit(1)).alias("n"), pct(F.col("best_rank") == 1).alias("agree"), pct(F.col("top1_dist") <= 800).alias("a_clip"), pct(F.col("best_dist") <= 800).alias("a_oracle"), pct(F.col("gap") >= 5).alias("gap5"))
    return s.join(F.broadcast(c), F.lit(True))


@query(sql(f"{STATS} SELECT query_id, gap, best_rank FROM qs WHERE gap > 0 ORDER BY gap DESC, query_id LIMIT 10", "sims"))
def gap_topn(spark, d):
    return stats(spark, d).filter("gap > 0").orderBy(F.desc("gap"), "query_id").limit(10).select("query_id", "gap", "best_rank")


@query(sql(f"WITH {CAND}, done AS (SELECT query_id FROM cand WHERE (query_id + tile_id) % 11 <> 0 GROUP BY 1 HAVING count(*) >= 19) SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM done)", "sims"))
def resume_pending(spark, d):
    """Queries that are not finished yet: an anti-join against those with enough candidate rows."""
    done = candidates(spark, d).filter("(query_id + tile_id) % 11 <> 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 19")
    return queries(spark, d).select("query_id").join(done, "query_id", "left_anti")


@query(sql(f"{STATS} SELECT k AS rank, CAST(count(query_id) AS BIGINT) AS n FROM range(1, 21) t(k) LEFT JOIN qs ON rank_of_top1 = k GROUP BY k", "sims"))
def rank_hist(spark, d):
    """Where the most similar tile stands among the 20 candidates by inliers: counts for every rank, empty ones too."""
    g = stats(spark, d).groupBy(F.col("rank_of_top1").cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("m"))
    return spark.range(1, 21).withColumnRenamed("id", "rank").join(g, "rank", "left").select("rank", F.coalesce("m", F.lit(0)).alias("n"))


def _ncc_sql(a, b):
    mean = lambda v: f"list_transform({v}, lambda x: x - list_sum({v})/64)"
    p, q = mean(a), mean(b)
    return f"list_inner_product({p}, {q})/(sqrt(list_inner_product({p}, {p}))*sqrt(list_inner_product({q}, {q})))"


@query(sql(f"SELECT variant, count(*) AS n, round(avg(v), 6) AS ncc_mean, round(min(v), 6) AS ncc_min FROM (SELECT unnest(['+yaw', '-yaw']) AS variant, unnest([{_ncc_sql('e', 'm')}, {_ncc_sql('e', 'o')}]) AS v FROM (SELECT emb::DOUBLE[] AS e, list_reverse(emb::DOUBLE[]) AS o, list_transform(range(1, 65), lambda i: 0.8::DOUBLE*emb[i] + 0.2::DOUBLE*emb[65 - i]) AS m FROM gallery)) GROUP BY variant", "gallery"))
def ncc_summary(spark, d):
    """Mean and least normalised correlation of each geometry variant: a right sign stays near 1."""
    g = gallery(spark, d).select(V.ncc(F.col("emb"), V.fuse(F.col("emb"), _text_vec(), F.lit(0.8))).alias("+yaw"), V.ncc(F.col("emb"), _text_vec()).alias("-yaw"))
    g = g.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("v")) for v in ("+yaw", "-yaw")])).alias("x")).select("x.*")
    return g.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("ncc_mean"), F.round(F.min("v"), 6).alias("ncc_min"))
