"""Geodesic, pixel and map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..operators import calibrate, spatial
from ..registry import query
from .views import frames, gallery, maps, match_results, queries, sql

R6 = lambda c, n=6: F.round(c, n)
HAV = "2*6371000.0::DOUBLE*asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians({b}-{a})/2), 2) + cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-{c})/2), 2)))))"


def hav(a, c, b, d):
    return HAV.format(a=a, b=b, c=c, d=d)


KMAP = "CASE flight " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in K.FOOTPRINT_K.items()) + f" ELSE {K.FOOTPRINT_K_DEFAULT!r}::DOUBLE END"
#: Frames with the map that holds them (or is nearest), the crop's affine and everything derived from it.
ON_MAP = """hit AS (SELECT * FROM (SELECT f.*, m.map_id, lt_lat, lt_lon, rb_lat, rb_lon, w, h, pplat, pplon, (f.lon - lt_lon)*pplon AS ux, (lt_lat - f.lat)*pplat AS uy,
    (f.lon - lt_lon)*pplon >= 0 AND (f.lon - lt_lon)*pplon < w AND (lt_lat - f.lat)*pplat >= 0 AND (lt_lat - f.lat)*pplat < h AS ok,
    row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN (f.lon - lt_lon)*pplon >= 0 AND (f.lon - lt_lon)*pplon < w AND (lt_lat - f.lat)*pplat >= 0 AND (lt_lat - f.lat)*pplat < h THEN 0 ELSE 1 END,
      CASE WHEN (f.lon - lt_lon)*pplon >= 0 AND (f.lon - lt_lon)*pplon < w AND (lt_lat - f.lat)*pplat >= 0 AND (lt_lat - f.lat)*pplat < h THEN 0 ELSE
      greatest(0, -((f.lon - lt_lon)*pplon)) + greatest(0, (f.lon - lt_lon)*pplon - w) + greatest(0, -((lt_lat - f.lat)*pplat)) + greatest(0, (lt_lat - f.lat)*pplat - h) END, map_id) AS rk FROM frames f, maps m) WHERE rk = 1),
  px AS (SELECT *, CASE WHEN ok THEN ux ELSE least(greatest(ux, 0), w - 1) END AS cx, CASE WHEN ok THEN uy ELSE least(greatest(uy, 0), h - 1) END AS cy,
    1.75::DOUBLE*({k})*height/1024.0::DOUBLE AS gsd, pplon/(cos(radians((lt_lat + rb_lat)/2))*111320.0::DOUBLE) AS sx, pplat/111320.0::DOUBLE AS sy FROM hit),
  ab AS (SELECT *, gsd*sx*cos(radians(phi1)) AS a, -gsd*sx*sin(radians(phi1)) AS b, gsd*sy*sin(radians(phi1)) AS c, gsd*sy*cos(radians(phi1)) AS d FROM px),
  aff AS (SELECT *, cx - a*512 - b*340 AS tx, cy - c*512 - d*340 AS ty FROM ab),
  box AS (SELECT *, least(tx, a*1023 + tx, b*679 + tx, a*1023 + b*679 + tx) AS bx0, greatest(tx, a*1023 + tx, b*679 + tx, a*1023 + b*679 + tx) AS bx1,
    least(ty, c*1023 + ty, d*679 + ty, c*1023 + d*679 + ty) AS by0, greatest(ty, c*1023 + ty, d*679 + ty, c*1023 + d*679 + ty) AS by1 FROM aff)""".format(k=KMAP)


def on_map(body: str) -> str:
    return sql(f"WITH {ON_MAP} {body}", "frames", "maps")


def placed(spark, d):
    """Frames on their map with crop affine: the shared input of the crop queries."""
    x = spatial.map_for_point(frames(spark, d), maps(spark, d))
    m = geo.map_columns()
    gsd = geo.metres_per_px(F.col("height"), geo.footprint_k(F.col("flight")))
    t = geo.metric_affine(m, F.col("px"), F.col("py"), gsd, F.col("phi1"))
    return x.withColumn("gsd", gsd).withColumns(t)


def _affine():
    return {k: F.col(k) for k in ("a", "b", "c", "d", "tx", "ty")}


@query(sql(f"SELECT seq, round({hav('lat', 'lon', 'lat2', 'lon2')}, 6) AS dist_m FROM (SELECT seq, lat, lon, 30.0::DOUBLE + (seq % 1000)/25000.0::DOUBLE AS lat2, 115.0::DOUBLE + (seq % 997)/16000.0::DOUBLE AS lon2 FROM frames)", "frames"))
def haversine_pairs(spark, d):
    lat2, lon2 = F.lit(30.0) + F.col("seq") % 1000 / F.lit(25000.0), F.lit(115.0) + F.col("seq") % 997 / F.lit(16000.0)
    return frames(spark, d).select("seq", R6(geo.haversine_m(F.col("lat"), F.col("lon"), lat2, lon2)).alias("dist_m"))


@query(on_map("SELECT seq, map_id, round(ux, 4) AS x, round(uy, 4) AS y, round(lt_lat - uy/pplat, 7) AS lat2, round(lt_lon + ux/pplon, 7) AS lon2 FROM hit"))
def gps_px_roundtrip(spark, d):
    x = spatial.map_for_point(frames(spark, d), maps(spark, d))
    m = geo.map_columns()
    u, v = geo.gps_to_px(F.col("lat"), F.col("lon"), m)
    la, lo = geo.px_to_gps(u, v, m)
    return x.select("seq", "map_id", R6(u, 4).alias("x"), R6(v, 4).alias("y"), R6(la, 7).alias("lat2"), R6(lo, 7).alias("lon2"))


@query(sql(f"SELECT flight, filename, round(1.75::DOUBLE*({KMAP})*height/1024.0::DOUBLE, 7) AS gsd FROM frames", "frames"))
def gsd(spark, d):
    return frames(spark, d).select("flight", "filename", R6(geo.metres_per_px(F.col("height"), geo.footprint_k(F.col("flight"))), 7).alias("gsd"))


@query(on_map("SELECT seq, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round(tx, 4) AS tx, round(ty, 4) AS ty FROM aff"))
def metric_affine(spark, d):
    return placed(spark, d).select("seq", *[R6(F.col(k), 4 if k[0] == "t" else 6).alias(k) for k in ("a", "b", "c", "d", "tx", "ty")])


@query(on_map("SELECT seq, round(cov, 6) AS coverage, coalesce(cov >= 0.2::DOUBLE, false) AS accepted FROM (SELECT seq, CASE WHEN (bx1 - bx0)*(by1 - by0) > 0 THEN greatest(0, least(w, bx1) - greatest(0, bx0))*greatest(0, least(h, by1) - greatest(0, by0))/((bx1 - bx0)*(by1 - by0)) END AS cov FROM box)"))
def coverage_gate(spark, d):
    x = placed(spark, d)
    c = geo.coverage(geo.corner_box(_affine()), geo.map_columns())
    return x.select("seq", R6(c).alias("coverage"), F.coalesce(c >= K.MIN_COVERAGE, F.lit(False)).alias("accepted"))


@query(on_map("SELECT seq, greatest(0, rx - half) AS x0, greatest(0, ry - half) AS y0, least(CAST(w AS BIGINT), rx + half) AS x1, least(CAST(h AS BIGINT), ry + half) AS y1 FROM (SELECT *, CAST(ceil(sqrt((bx1 - bx0)*(bx1 - bx0) + (by1 - by0)*(by1 - by0))/2) AS BIGINT) + 4 AS half, CAST(round_even(cx, 0) AS BIGINT) AS rx, CAST(round_even(cy, 0) AS BIGINT) AS ry FROM box)"))
def roi_window(spark, d):
    x = placed(spark, d)
    return x.select("seq", *[v.alias(k) for k, v in geo.roi(geo.corner_box(_affine()), F.col("px"), F.col("py"), geo.map_columns()).items()])


PRIOR = "(seq*13 % 161 - 80)::DOUBLE AS dx_m, (seq*29 % 161 - 80)::DOUBLE AS dy_m"


def _prior():
    return (F.col("seq") * 13 % 161 - 80).cast("double"), (F.col("seq") * 29 % 161 - 80).cast("double")


def shifted(spark, d):
    """As ``placed``, with the crop centred on a prior some metres off (an integer-derived offset)."""
    x = spatial.map_for_point(frames(spark, d), maps(spark, d))
    m = geo.map_columns()
    dx, dy = _prior()
    # Metres to pixels at the map's middle latitude, as its crops are scaled.
    cx = F.col("px") + dx * m["pplon"] / (F.cos(F.radians((m["lt_lat"] + m["rb_lat"]) / 2)) * K.DEGREE_M)
    cy = F.col("py") + dy * m["pplat"] / K.DEGREE_M
    gsd_ = geo.metres_per_px(F.col("height"), geo.footprint_k(F.col("flight")))
    return x.withColumns({"gsd": gsd_, "cx": cx, "cy": cy}).withColumns(geo.metric_affine(m, F.col("cx"), F.col("cy"), F.col("gsd"), F.col("phi1")))


SHIFT = """, off AS (SELECT * REPLACE (cx + dx_m*pplon/(cos(radians((lt_lat + rb_lat)/2))*111320.0::DOUBLE) AS cx, cy + dy_m*pplat/111320.0::DOUBLE AS cy), cx AS gx0, cy AS gy0 FROM (SELECT *, {p} FROM px)),
  ab2 AS (SELECT *, gsd*sx*cos(radians(phi1)) AS a, -gsd*sx*sin(radians(phi1)) AS b, gsd*sy*sin(radians(phi1)) AS c, gsd*sy*cos(radians(phi1)) AS d FROM off),
  aff2 AS (SELECT *, cx - a*512 - b*340 AS tx, cy - c*512 - d*340 AS ty FROM ab2),
  gt AS (SELECT *, (d*(gx0 - tx) - b*(gy0 - ty))/(a*d - b*c) AS gx, (a*(gy0 - ty) - c*(gx0 - tx))/(a*d - b*c) AS gy FROM aff2)""".format(p=PRIOR)


def off_map(body: str) -> str:
    return sql(f"WITH {ON_MAP}{SHIFT} {body}", "frames", "maps")


def with_gt(spark, d):
    gx, gy = geo.invert_affine(_affine(), F.col("px"), F.col("py"))
    return shifted(spark, d).withColumns({"gx": gx, "gy": gy})


@query(off_map("SELECT seq, round(gx, 4) AS gx, round(gy, 4) AS gy, gx >= 0 AND gx < 1024 AND gy >= 0 AND gy < 680 AS gt_in_patch FROM gt"))
def gt_in_patch(spark, d):
    return with_gt(spark, d).select("seq", R6(F.col("gx"), 4).alias("gx"), R6(F.col("gy"), 4).alias("gy"), geo.in_box(F.col("gx"), F.col("gy"), K.CROP_W, K.CROP_H).alias("gt_in_patch"))


@query(off_map("SELECT seq, round(lat + dy_m/111320.0::DOUBLE, 8) AS prior_lat, round(lon + dx_m/(111320.0::DOUBLE*cos(radians(lat))), 8) AS prior_lon, round(cx - gx0, 4) AS dx_px, round(cy - gy0, 4) AS dy_px FROM gt"))
def prior_shift(spark, d):
    dx, dy = _prior()
    la, lo = geo.shifted_gps(F.col("lat"), F.col("lon"), dx, dy)
    return shifted(spark, d).select("seq", R6(la, 8).alias("prior_lat"), R6(lo, 8).alias("prior_lon"), R6(F.col("cx") - F.col("px"), 4).alias("dx_px"), R6(F.col("cy") - F.col("py"), 4).alias("dy_px"))


def _h():
    """A deterministic near-similarity with a little perspective, from seq."""
    s = F.lit(0.5) + F.col("seq") % 31 / F.lit(100.0)
    r = F.radians((F.col("seq") % 13 - 6).cast("double"))
    z = F.lit(0.0)
    return [s * F.cos(r), -s * F.sin(r), (F.col("seq") % 97).cast("double"), s * F.sin(r), s * F.cos(r), (F.col("seq") % 89).cast("double"), F.col("seq") % 5 / F.lit(100000.0), z, F.lit(1.0)]


HSQL = """, hh AS (SELECT *, s*cos(r) AS h0, -s*sin(r) AS h1, (seq % 97)::DOUBLE AS h2, s*sin(r) AS h3, s*cos(r) AS h4, (seq % 89)::DOUBLE AS h5, (seq % 5)/100000.0::DOUBLE AS h6 FROM (SELECT *, 0.5::DOUBLE + (seq % 31)/100.0::DOUBLE AS s, radians((seq % 13 - 6)::DOUBLE) AS r FROM gt)),
  pc AS (SELECT *, (h0*512 + h1*340 + h2)/(h6*512 + 1) AS qx, (h3*512 + h4*340 + h5)/(h6*512 + 1) AS qy FROM hh)"""


@query(sql(f"WITH {ON_MAP}{SHIFT}{HSQL} SELECT seq, round(qx, 4) AS px, round(qy, 4) AS py, round(sqrt((qx-gx)*(qx-gx) + (qy-gy)*(qy-gy)), 3) AS err_px, round(sqrt((qx-gx)*(qx-gx) + (qy-gy)*(qy-gy))*gsd, 3) AS err_m, round(lt_lat - (c*qx + d*qy + ty)/pplat, 6) AS lat2, round(lt_lon + (a*qx + b*qy + tx)/pplon, 6) AS lon2 FROM pc", "frames", "maps"))
def project_centre(spark, d):
    x = with_gt(spark, d)
    u, v = geo.project(_h(), F.lit(K.CROP_W / 2), F.lit(K.CROP_H / 2))
    e = F.hypot(u - F.col("gx"), v - F.col("gy"))
    la, lo = geo.px_to_gps(*geo.apply_affine(_affine(), u, v), geo.map_columns())
    return x.select("seq", R6(u, 4).alias("px"), R6(v, 4).alias("py"), R6(e, 3).alias("err_px"), R6(e * F.col("gsd"), 3).alias("err_m"), R6(la).alias("lat2"), R6(lo).alias("lon2"))


@query(sql(f"WITH {ON_MAP}{SHIFT}{HSQL} SELECT seq, round(sqrt(abs(h0*h4 - h1*h3)), 6) AS h_scale, round(degrees(atan2(h3, h0)), 6) AS rotation FROM pc", "frames", "maps"))
def sim_scale_rot(spark, d):
    return frames(spark, d).select("seq", R6(geo.similarity_scale(_h())).alias("h_scale"), R6(geo.similarity_rotation(_h())).alias("rotation"))


def _legs_sql():
    return "CASE flight " + " ".join(f"WHEN '{f}' THEN CASE WHEN {_cd('phi1', a[0])} <= {_cd('phi1', b[0])} THEN phi1 + ({a[1]}::DOUBLE) ELSE phi1 + ({b[1]}::DOUBLE) END" for f, (a, b) in K.YAW_LEGS.items()) + " ELSE phi1 END"


def _cd(a, b):
    return f"abs((({a} - ({b}::DOUBLE) + 180) % 360 + 360) % 360 - 180)"


@query(sql(f"SELECT flight, filename, round({_legs_sql()}, 6) AS yaw FROM frames", "frames"))
def corrected_yaw(spark, d):
    return frames(spark, d).select("flight", "filename", R6(geo.corrected_yaw(F.col("flight"), F.col("phi1"))).alias("yaw"))


@query(sql("SELECT flight, round(degrees(atan2(sum(sin(radians(phi1))), sum(cos(radians(phi1))))), 4) AS mean_deg FROM frames GROUP BY flight", "frames"))
def circ_mean(spark, d):
    return frames(spark, d).groupBy("flight").agg(R6(geo.circular_mean(F.col("phi1")), 4).alias("mean_deg"))


@query(sql("SELECT map_id, yi*count(*) OVER (PARTITION BY map_id, yi) + xi AS tile_id, x0, y0, round(lt_lat - (y0 + 256)/pplat, 7) AS lat, round(lt_lon + (x0 + 256)/pplon, 7) AS lon FROM (SELECT m.*, x0, y0, dense_rank() OVER (PARTITION BY map_id ORDER BY y0) - 1 AS yi, row_number() OVER (PARTITION BY map_id, y0 ORDER BY x0) - 1 AS xi FROM maps m, (SELECT DISTINCT v AS x0 FROM (SELECT unnest(range(0, 489, 256)) AS v UNION ALL SELECT 488)) a, (SELECT DISTINCT v AS y0 FROM (SELECT unnest(range(0, 2489, 256)) AS v UNION ALL SELECT 2488)) b)", "maps"))
def tile_grid(spark, d):
    g = spatial.tile_grid(maps(spark, d), 512, 256)
    return g.withColumns({"lat": R6(F.col("lat"), 7), "lon": R6(F.col("lon"), 7)})


@query(on_map("SELECT seq, map_id, round(cx, 4) AS px, round(cy, 4) AS py, ok AS in_bounds FROM px"))
def tile_for_gps(spark, d):
    x = spatial.map_for_point(frames(spark, d), maps(spark, d))
    return x.select("seq", "map_id", R6(F.col("px"), 4).alias("px"), R6(F.col("py"), 4).alias("py"), "in_bounds")


@query(sql(f"SELECT seq, tile_id, round(dist, 4) AS dist_m FROM (SELECT f.seq, g.tile_id, {hav('f.lat', 'f.lon', 'g.lat', 'g.lon')} AS dist, row_number() OVER (PARTITION BY f.seq ORDER BY {hav('f.lat', 'f.lon', 'g.lat', 'g.lon')}, g.tile_id) AS rk FROM frames f, gallery g) WHERE rk = 1", "frames", "gallery"))
def nearest_tile(spark, d):
    g = gallery(spark, d).select("tile_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    n = spatial.nearest(frames(spark, d).select("seq", "lat", "lon"), g, "seq", ("lat", "lon"), ("tlat", "tlon"), "tile_id")
    return n.withColumn("dist_m", R6(F.col("dist_m"), 4))


@query(sql("SELECT a.seq AS a, b.seq AS b, round(sqrt(pow((a.lon - b.lon)*111320.0::DOUBLE*cos(radians((a.lat + b.lat)/2)), 2) + pow((a.lat - b.lat)*110540.0::DOUBLE, 2)), 4) AS dist_m FROM frames a, frames b WHERE a.seq <> b.seq AND a.flight = b.flight AND sqrt(pow((a.lon - b.lon)*111320.0::DOUBLE*cos(radians((a.lat + b.lat)/2)), 2) + pow((a.lat - b.lat)*110540.0::DOUBLE, 2)) <= 100", "frames"))
def neg_mask_pairs(spark, d):
    """Pairs of one flight within 100 m: they are no negatives of each other."""
    j = spatial.radius_pairs(frames(spark, d), "seq", ("lat", "lon"), 100.0, metric=geo.flat_distance_m, keys=("flight",))
    return j.select("a", "b", R6(F.col("dist_m"), 4).alias("dist_m"))


@query(off_map("SELECT seq, round(CASE WHEN lim > 0 AND nn > lim THEN dx_m*lim/nn ELSE dx_m END, 6) AS dx_m, round(CASE WHEN lim > 0 AND nn > lim THEN dy_m*lim/nn ELSE dy_m END, 6) AS dy_m FROM (SELECT seq, dx_m, dy_m, (340 - 40)*gsd AS lim, sqrt(dx_m*dx_m + dy_m*dy_m) AS nn FROM gt)"))
def offset_clamp(spark, d):
    dx, dy = _prior()
    most = geo.metres_per_px(F.col("height"), geo.footprint_k(F.col("flight"))) * 300.0
    u, v = geo.clamp_offset(dx, dy, most)
    return frames(spark, d).select("seq", R6(u).alias("dx_m"), R6(v).alias("dy_m"))


@query(off_map("SELECT seq, round(1/1.75::DOUBLE, 6) AS s, round(gx - 512/1.75::DOUBLE, 3) AS tx, round(gy - 340/1.75::DOUBLE, 3) AS ty, round((gx - 512/1.75::DOUBLE)*0.5, 3) AS tx_half, round((gy - 340/1.75::DOUBLE)*0.5, 3) AS ty_half FROM gt"))
def geo_homography(spark, d):
    h = geo.geo_homography(F.col("gx"), F.col("gy"))
    half = geo.rescaled(h, 0.5, 0.5)
    return with_gt(spark, d).select("seq", R6(h[0]).alias("s"), R6(h[2], 3).alias("tx"), R6(h[5], 3).alias("ty"), R6(half[2], 3).alias("tx_half"), R6(half[5], 3).alias("ty_half"))


@query(sql(f"WITH {ON_MAP}{SHIFT}{HSQL} SELECT seq, round(dd, 3) AS disagree_m, CASE WHEN seq % 60 < 8 THEN 'few correspondences' WHEN dd > 25 THEN 'centre' ELSE 'kept' END AS reason FROM (SELECT seq, sqrt((qx-gx)*(qx-gx) + (qy-gy)*(qy-gy))*gsd AS dd FROM pc)", "frames", "maps"))
def centre_disagreement(spark, d):
    """Metres between the centre through a teacher transform and through the geometric prior, and why a pair is dropped."""
    x = with_gt(spark, d)
    u, v = geo.project(_h(), F.lit(K.CROP_W / 2), F.lit(K.CROP_H / 2))
    p, q = geo.project(geo.geo_homography(F.col("gx"), F.col("gy")), F.lit(K.CROP_W / 2), F.lit(K.CROP_H / 2))
    dd = F.hypot(u - p, v - q) * F.col("gsd")
    return x.select("seq", R6(dd, 3).alias("disagree_m"), F.when(F.col("seq") % 60 < 8, "few correspondences").when(dd > 25, "centre").otherwise("kept").alias("reason"))


@query(sql("SELECT seq, CASE WHEN height < 375 THEN 300.0::DOUBLE WHEN height = 375 THEN 300.0::DOUBLE WHEN height <= 500 THEN 450.0::DOUBLE ELSE 550.0::DOUBLE END AS scale FROM frames", "frames"))
def nearest_scale(spark, d):
    return frames(spark, d).select("seq", geo.nearest_of(F.col("height"), [300.0, 450.0, 550.0]).alias("scale"))


@query(on_map("SELECT seq, round(tx, 3) AS x00, round(a*1023 + tx, 3) AS x10, round(b*679 + tx, 3) AS x01, round(a*1023 + b*679 + tx, 3) AS x11, round(c*1023 + d*679 + ty, 3) AS y11, round(({k})/1.75::DOUBLE, 6) AS k_same FROM aff".replace("{k}", KMAP)))
def footprint(spark, d):
    t = _affine()
    corner = lambda x, y: geo.apply_affine(t, F.lit(float(x)), F.lit(float(y)))
    return placed(spark, d).select(
        "seq", *[R6(corner(1023 * i, 679 * j)[0], 3).alias(f"x{i}{j}") for i in (0, 1) for j in (0, 1)], R6(corner(1023, 679)[1], 3).alias("y11"),
        R6(geo.footprint_k(F.col("flight")) / K.SEARCH_FACTOR).alias("k_same"),
    )


@query(sql("SELECT map_id, round(cos(radians((lt_lat + rb_lat)/2))*111320.0::DOUBLE/pplon, 3) AS m_per_px_x, round(111320.0::DOUBLE/pplat, 3) AS m_per_px_y, round(w*cos(radians((lt_lat + rb_lat)/2))*111320.0::DOUBLE/pplon/1000, 2) AS ground_w_km, round(h*111320.0::DOUBLE/pplat/1000, 2) AS ground_h_km FROM maps", "maps"))
def map_extent(spark, d):
    m = geo.map_columns()
    gx, gy = F.cos(F.radians((m["lt_lat"] + m["rb_lat"]) / 2)) * K.DEGREE_M / m["pplon"], F.lit(K.DEGREE_M) / m["pplat"]
    return maps(spark, d).select("map_id", R6(gx, 3).alias("m_per_px_x"), R6(gy, 3).alias("m_per_px_y"), R6(m["w"] * gx / 1000, 2).alias("ground_w_km"), R6(m["h"] * gy / 1000, 2).alias("ground_h_km"))


@query(sql("SELECT s.method, s.seq, round((s.lon - 115.0::DOUBLE)*1000/0.06::DOUBLE, 4) AS x, round((30.04::DOUBLE - s.lat)*1000/0.04::DOUBLE, 4) AS y, round((s.lon - 115.0::DOUBLE)*1000/0.06::DOUBLE + 5*(s.pred_lon - s.lon)*1000/0.06::DOUBLE, 4) AS x2, round((30.04::DOUBLE - s.lat)*1000/0.04::DOUBLE - 5*(s.pred_lat - s.lat)*1000/0.04::DOUBLE, 4) AS y2, CASE WHEN s.offset_m IS NULL THEN 'gate failed' WHEN s.offset_m > 50 THEN 'gross' ELSE 'accepted' END AS kind FROM scored s", "scored"))
def spatial_vectors(spark, d):
    """Positions on an overview and error vectors five times as long, with their kind."""
    x, y = (F.col("lon") - 115.0) * 1000 / 0.06, (F.lit(30.04) - F.col("lat")) * 1000 / 0.04
    x2, y2 = x + (F.col("pred_lon") - F.col("lon")) * 5 * 1000 / 0.06, y - (F.col("pred_lat") - F.col("lat")) * 5 * 1000 / 0.04
    kind = F.when(F.col("offset_m").isNull(), "gate failed").when(F.col("offset_m") > 50, "gross").otherwise("accepted")
    return match_results(spark, d).filter(~F.col("skipped")).select("method", "seq", R6(x, 4).alias("x"), R6(y, 4).alias("y"), R6(x2, 4).alias("x2"), R6(y2, 4).alias("y2"), kind.alias("kind"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM orders")
def season(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", geo.season(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("season"))


@query(sql("SELECT flight, seq, round(degrees(atan2((lon2 - lon1)*111320.0::DOUBLE*cos(radians(lat)), (lat2 - lat1)*110540.0::DOUBLE)), 4) AS bearing FROM (SELECT *, coalesce(lead(lat) OVER w, lat) AS lat2, coalesce(lag(lat) OVER w, lat) AS lat1, coalesce(lead(lon) OVER w, lon) AS lon2, coalesce(lag(lon) OVER w, lon) AS lon1 FROM frames WINDOW w AS (PARTITION BY flight ORDER BY seq))", "frames"))
def central_bearing(spark, d):
    return calibrate.central_bearing(frames(spark, d), ["flight"]).select("flight", "seq", R6("bearing", 4).alias("bearing"))
