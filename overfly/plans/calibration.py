"""Bias, scale, sweep and training-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..operators import accuracy as A
from ..operators import calibrate as C
from ..operators import fit
from ..operators.bands import with_band
from ..registry import query
from .geometry import KMAP, hav
from .views import correspondences, frames, match_results, sql

KEYS = ["method", "flight"]
TRACK = """tr AS (SELECT s.*, band = 'train' AS in_train, (pred_lon - lon)*111320.0::DOUBLE*cos(radians(lat)) AS e, (pred_lat - lat)*110540.0::DOUBLE AS n,
   coalesce(lead(lon) OVER w - lon, lon - lag(lon) OVER w)*111320.0::DOUBLE*cos(radians(CASE WHEN lead(lat) OVER w IS NOT NULL THEN lat ELSE lag(lat) OVER w END)) AS de,
   coalesce(lead(lat) OVER w - lat, lat - lag(lat) OVER w)*110540.0::DOUBLE AS dn
   FROM scored s JOIN (SELECT filename AS fn, band FROM banded) ON fn = filename WINDOW w AS (PARTITION BY method, flight ORDER BY seq)),
  dir AS (SELECT *, coalesce(de/CASE WHEN sqrt(de*de + dn*dn) < 1e-6 THEN 1 ELSE sqrt(de*de + dn*dn) END, 0) AS te, coalesce(dn/CASE WHEN sqrt(de*de + dn*dn) < 1e-6 THEN 1 ELSE sqrt(de*de + dn*dn) END, 1) AS tn FROM tr),
  er AS (SELECT *, e*te + n*tn AS along, n*te - e*tn AS crs, in_train AND coalesce(inliers, 0) >= 7 AND pred_lat IS NOT NULL AS fit FROM dir),
  bi AS (SELECT method AS bm, flight AS bf, count(*) FILTER (WHERE fit) AS k, CASE WHEN count(*) FILTER (WHERE fit) >= 10 THEN median(e) FILTER (WHERE fit) ELSE 0 END AS be, CASE WHEN count(*) FILTER (WHERE fit) >= 10 THEN median(n) FILTER (WHERE fit) ELSE 0 END AS bn,
    CASE WHEN count(*) FILTER (WHERE fit) >= 10 THEN median(along) FILTER (WHERE fit) ELSE 0 END AS ba, CASE WHEN count(*) FILTER (WHERE fit) >= 10 THEN median(crs) FILTER (WHERE fit) ELSE 0 END AS bc FROM er GROUP BY 1, 2)"""


def tr_sql(body):
    return sql(f"WITH {TRACK} {body}", "scored", "banded")


def _rows(spark, d):
    b = with_band(frames(spark, d)).select("flight", "filename", (F.col("band") == "train").alias("in_train"))
    return A.scored(match_results(spark, d)).join(b, ["flight", "filename"])


R = F.round


@query(tr_sql("SELECT method, flight, seq, round(te, 5) AS te, round(tn, 5) AS tn FROM dir"))
def track_dir(spark, d):
    return C.track_direction(_rows(spark, d), KEYS).select(*KEYS, "seq", R("te", 5).alias("te"), R("tn", 5).alias("tn"))


@query(tr_sql("SELECT method, flight, seq, round(e, 4) AS e, round(n, 4) AS n, round(along, 4) AS along, round(crs, 4) AS cross FROM er"))
def en_errors(spark, d):
    return C.with_errors(_rows(spark, d), KEYS).select(*KEYS, "seq", *[R(c, 4).alias(c) for c in ("e", "n", "along", "cross")])


def _bias_sql(ce, cn):
    plat, plon = f"(pred_lat - ({cn})/110540.0::DOUBLE)", f"(pred_lon - ({ce})/(111320.0::DOUBLE*cos(radians(lat))))"
    return tr_sql(f"SELECT method, flight, seq, round({plat}, 6) AS pred_lat, round({plon}, 6) AS pred_lon, round(coalesce({hav('lat', 'lon', plat, plon)}, offset_m), 3) AS offset_m FROM er JOIN bi ON bm = method AND bf = flight")


def _bias(spark, d, frame):
    return C.corrected(_rows(spark, d), KEYS, frame).select(*KEYS, "seq", R("pred_lat", 6).alias("pred_lat"), R("pred_lon", 6).alias("pred_lon"), R("offset_m", 3).alias("offset_m"))


@query(_bias_sql("be", "bn"))
def bias_en(spark, d):
    return _bias(spark, d, "en")


@query(_bias_sql("ba*te - bc*tn", "ba*tn + bc*te"))
def bias_track(spark, d):
    return _bias(spark, d, "track")


@query(sql(f"SELECT flight, count(*) AS n, round(any_value({KMAP}), 6) AS k_used, round(median(k), 6) AS k_median, round(quantile_cont(k, 0.25), 6) AS k_p25, round(quantile_cont(k, 0.75), 6) AS k_p75, CAST(median(inliers) AS DOUBLE) AS med_inliers FROM (SELECT *, h_scale*1.75::DOUBLE*({KMAP}) AS k FROM scored WHERE inliers >= 7) GROUP BY flight", "scored"))
def k_hscale(spark, d):
    used = geo.footprint_k(F.col("flight"))
    x = A.scored(match_results(spark, d)).filter(A.gate()).withColumn("k", F.col("h_scale") * K.SEARCH_FACTOR * used)
    q = F.percentile("k", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = x.groupBy("flight").agg(F.count(F.lit(1)).alias("n"), F.max(used).alias("k_used"), q.alias("q"), F.median("inliers").alias("med_inliers"))
    return g.select("flight", "n", R("k_used", 6).alias("k_used"), *[R(F.col("q")[i], 6).alias(c) for i, c in enumerate(("k_p25", "k_median", "k_p75"))], "med_inliers")


CELLS = "cell AS (SELECT flight, 0.8::DOUBLE + (seq % 5)/10.0::DOUBLE AS k, count(*) AS n, round(count(offset_m)/count(*)::DOUBLE, 6) AS valid_frac, round(median(offset_m), 6) AS median_off_m, round(avg(inliers), 6) AS mean_inliers FROM scored GROUP BY 1, 2)"


def _cells(spark, d):
    x = A.scored(match_results(spark, d)).withColumn("k", F.lit(0.8) + F.col("seq") % 5 / F.lit(10.0))
    return x.groupBy("flight", "k").agg(F.count(F.lit(1)).alias("n"), R(F.count("offset_m") / F.count(F.lit(1)), 6).alias("valid_frac"), R(F.median("offset_m"), 6).alias("median_off_m"), R(F.avg("inliers"), 6).alias("mean_inliers"))


@query(sql(f"WITH {CELLS} SELECT flight, arg_max(k, (mean_inliers, -k)) AS k, max(mean_inliers) AS mean_inliers FROM (SELECT *, min(median_off_m) OVER (PARTITION BY flight) AS b FROM cell WHERE valid_frac >= 0.2) WHERE median_off_m <= b + 1 GROUP BY flight", "scored"))
def k_sweep_best(spark, d):
    return C.best_cell(_cells(spark, d))


@query(sql(f"WITH {CELLS}, best AS (SELECT flight, arg_max(k, (mean_inliers, -k)) AS k FROM (SELECT *, min(median_off_m) OVER (PARTITION BY flight) AS b FROM cell WHERE valid_frac >= 0.2) WHERE median_off_m <= b + 1 GROUP BY flight) SELECT flight, round(best.k + i*0.05::DOUBLE, 2) AS k FROM best, range(-2, 3) r(i) WHERE NOT EXISTS (SELECT 1 FROM cell c WHERE c.flight = best.flight AND round(c.k, 2) = round(best.k + i*0.05::DOUBLE, 2))", "scored"))
def k_refine_grid(spark, d):
    """The finer grid around each flight's best value, less the values that were tried."""
    cells = _cells(spark, d)
    grid = C.best_cell(cells).select("flight", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.round(F.col("k") + i * 0.05, 2))).alias("k"))
    return grid.join(cells.select("flight", F.round("k", 2).alias("k")), ["flight", "k"], "left_anti")


@query(sql("SELECT flight, sgn, count(*) AS n, round(median(r), 4) AS median_deg, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 4) AS iqr_deg, round(median(abs(r)) FILTER (WHERE inliers >= 7), 4) AS abs_median FROM (SELECT flight, inliers, CASE WHEN phi1 >= 0 THEN 1 ELSE -1 END AS sgn, ((seq*17 % 101 - 50)/5.0::DOUBLE) AS r FROM scored JOIN (SELECT filename AS fn, phi1 FROM frames) ON fn = filename) GROUP BY ALL", "scored"))
def rotation_iqr(spark, d):
    x = A.scored(match_results(spark, d)).join(frames(spark, d).select("filename", "phi1"), "filename")
    r = F.col("r")
    x = x.select("flight", "inliers", F.when(F.col("phi1") >= 0, 1).otherwise(-1).alias("sgn"), ((F.col("seq") * 17 % 101 - 50) / 5.0).alias("r"))
    return x.groupBy("flight", "sgn").agg(F.count(F.lit(1)).alias("n"), R(F.median(r), 4).alias("median_deg"), R(F.percentile(r, 0.75) - F.percentile(r, 0.25), 4).alias("iqr_deg"), R(F.median(F.when(A.gate(), F.abs(r))), 4).alias("abs_median"))


# Closed-form weighted similarity of each pair, as CTEs s and ab.
WEIGHTED = "WITH s AS (SELECT pair, sum(w) AS sw, sum(w*x0) AS sx, sum(w*y0) AS sy, sum(w*x1) AS su, sum(w*y1) AS sv, sum(w*(x0*x0 + y0*y0)) AS sxx, sum(w*(x0*x1 + y0*y1)) AS sxu, sum(w*(x0*y1 - y0*x1)) AS sxv FROM (SELECT *, conf + 0.01::DOUBLE AS w FROM correspondences) GROUP BY pair), ab AS (SELECT *, (sxu - (sx*su + sy*sv)/sw)/(sxx - (sx*sx + sy*sy)/sw) AS a, (sxv - (sx*sv - sy*su)/sw)/(sxx - (sx*sx + sy*sy)/sw) AS b FROM s)"


@query(sql(WEIGHTED + " SELECT pair, round(a, 6) AS a, round(b, 6) AS b, round((su - a*sx + b*sy)/sw, 3) AS tx, round((sv - b*sx - a*sy)/sw, 3) AS ty FROM ab", "correspondences"))
def weighted_similarity(spark, d):
    g = fit.weighted_similarity(correspondences(spark, d), ["pair"], F.col("conf") + 0.01)
    return g.select("pair", R("a", 6).alias("a"), R("b", 6).alias("b"), R("tx", 3).alias("tx"), R("ty", 3).alias("ty"))


@query(sql(WEIGHTED + ", m AS (SELECT pair, a, b, (su - a*sx + b*sy)/sw AS tx, (sv - b*sx - a*sy)/sw AS ty FROM ab), r AS (SELECT pair, sqrt((a*x0 - b*y0 + tx - x1)*(a*x0 - b*y0 + tx - x1) + (b*x0 + a*y0 + ty - y1)*(b*x0 + a*y0 + ty - y1)) AS r FROM correspondences JOIN m USING (pair)) SELECT pair, count(*) AS n, count(*) FILTER (WHERE r < 3) AS inliers, round(avg(r) FILTER (WHERE r < 3), 4) AS mean_r FROM r GROUP BY pair", "correspondences"))
def similarity_inliers(spark, d):
    """How many correspondences a pair's closed-form similarity explains within 3 px, and how well."""
    c = correspondences(spark, d)
    g = fit.agreement(c, fit.weighted_similarity(c, ["pair"], F.col("conf") + 0.01), ["pair"], 3.0)
    return g.select("pair", "n", "inliers", R("mean_r", 4).alias("mean_r"))


@query(sql("SELECT method, round(avg(CASE WHEN raw_err_m <= 20 THEN 0.5*raw_err_m*raw_err_m ELSE 20*(raw_err_m - 10) END), 4) AS huber FROM scored GROUP BY method", "scored"))
def huber(spark, d):
    e = F.col("raw_err_m")
    return A.scored(match_results(spark, d)).groupBy("method").agg(R(F.avg(F.when(e <= 20, 0.5 * e * e).otherwise(20 * (e - 10))), 4).alias("huber"))


@query(sql("WITH v AS (SELECT seq % 12 AS epoch, round(median(CASE WHEN offset_m IS NULL THEN 'inf'::DOUBLE ELSE offset_m END), 6) AS med, round(count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/count(*), 6) AS a25 FROM scored GROUP BY 1) SELECT epoch, med, a25 FROM v ORDER BY med, -a25, epoch LIMIT 1", "scored"))
def select_epoch(spark, d):
    """Best validation epoch: least median error, then most accuracy, then the earliest."""
    v = A.scored(match_results(spark, d)).groupBy((F.col("seq") % 12).alias("epoch")).agg(R(F.median(F.coalesce("offset_m", F.lit(float("inf")))), 6).alias("med"), A.share(A.within(25)).alias("a25"))
    best = F.min(F.struct("med", (-F.col("a25")).alias("na"), "epoch")).alias("b")
    return v.agg(best).select("b.epoch", "b.med", (-F.col("b.na")).alias("a25"))
