"""Scans, registries, samples, correspondence filters and pair-generation bookkeeping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import geo
from ..operators import accuracy as A
from ..operators import fit, sampling
from ..operators.bands import with_band
from ..operators.store import shared_folder
from ..registry import query
from ..sources import archives, ledger, readers
from .geometry import _h
from .views import correspondences, frames, gallery, maps, match_results, sql, table


@query("SELECT flight, seq, value, skipped FROM (SELECT lpad(CAST(user_id % 9 + 1 AS VARCHAR), 2, '0') AS flight, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value, event_id % 17 = 0 AS skipped FROM events) WHERE NOT skipped")
def typed_scan(spark, d):
    """Strings as they stand in old result files, coerced: 'nan' and junk are missing, 'True' in any case is a flag."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    raw = e.select(
        (F.col("user_id") % 9 + 1).cast("string").alias("flight"), i.cast("string").alias("seq"),
        F.when(i % 13 == 0, F.when(i % 2 == 0, "nan").otherwise("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(i % 17 == 0, F.when(i % 2 == 0, "True").otherwise("true")).when(i % 19 == 0, F.lit(None)).otherwise("False").alias("skipped"),
    )
    x = raw.select(F.lpad("flight", 2, "0").alias("flight"), F.col("seq").cast("long").alias("seq"), readers.number(F.col("value")).alias("value"), readers.flag(F.col("skipped")).alias("skipped"))
    return x.filter(~F.col("skipped"))


@query(sql("SELECT f.seq, m.map_id, round(m.pplat, 4) AS pplat, round(m.pplon, 4) AS pplon FROM frames f JOIN maps m ON CAST(f.flight AS BIGINT) % 5 = m.map_id", "frames", "maps"))
def map_scan(spark, d):
    """Frames with their flight's map row."""
    m = maps(spark, d).select("map_id", F.round(F.col("h") / (F.col("lt_lat") - F.col("rb_lat")), 4).alias("pplat"), F.round(F.col("w") / (F.col("rb_lon") - F.col("lt_lon")), 4).alias("pplon"))
    return frames(spark, d).select("seq", (F.col("flight").cast("long") % 5).alias("map_id")).join(m, "map_id")


@query(sql("SELECT r.label, s.method, count(*) AS n FROM (SELECT unnest(['m0', 'm1', 'm9']) AS method, unnest(['Zero', 'One', 'Nine']) AS label) r JOIN scored s USING (method) WHERE gt_in_patch GROUP BY ALL", "scored"))
def registry_load(spark, d):
    """Registered methods joined with what exists; one that is registered without rows gives none."""
    reg = spark.createDataFrame([("m0", "Zero"), ("m1", "One"), ("m9", "Nine")], "method string, label string")
    return A.solvable(match_results(spark, d)).join(F.broadcast(reg), "method").groupBy("label", "method").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT label % 3 AS flight, count(*) AS n, min(tile_id) AS first_tile, max(tile_id) AS last_tile FROM gallery WHERE label % 3 = 1 GROUP BY 1", "gallery"))
def gallery_partition(spark, d):
    """The rows of one gallery partition (model, flight): a filter that reaches the scan."""
    g = gallery(spark, d).withColumn("flight", F.col("label") % 3).filter("flight = 1")
    return g.groupBy("flight").agg(F.count(F.lit(1)).alias("n"), F.min("tile_id").alias("first_tile"), F.max("tile_id").alias("last_tile"))


@query(sql("SELECT flight, count(*) AS n, max(sf) AS search_factor FROM (SELECT flight, (1700 + CASE WHEN seq >= 0 THEN 50 ELSE seq END)/1000.0::DOUBLE AS sf FROM frames) GROUP BY flight", "frames"))
def stale_guard(spark, d):
    """Records carry the search factor they were made with; one made with another stops the query."""
    x = frames(spark, d).select("flight", ((F.when(F.col("seq") >= 0, 50).otherwise(F.col("seq")) + 1700) / F.lit(1000.0)).alias("sf"))
    return readers.guarded(x, "sf", K.SEARCH_FACTOR, "search factor").groupBy("flight").agg(F.count(F.lit(1)).alias("n"), F.max("sf").alias("search_factor"))


@query(sql("SELECT f.flight, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(i.ok, false)) AS n_skipped, CAST(sum(CASE WHEN i.ok THEN i.width END) AS BIGINT) AS width FROM frames f LEFT JOIN (SELECT event_id, event_id % 5 <> 0 AS ok, 3000 + event_id % 7 AS width FROM events WHERE event_id % 3 <> 0) i ON i.event_id = f.seq GROUP BY f.flight", "frames"))
def image_rows(spark, d):
    """Frames with their images; a missing or unreadable image makes a skipped row."""
    i = table(spark, d, "events").filter("event_id % 3 <> 0").select(F.col("event_id").alias("seq"), (F.col("event_id") % 5 != 0).alias("ok"), (F.col("event_id") % 7 + 3000).alias("width"))
    x = readers.with_images(frames(spark, d), i, ["seq"])
    return x.groupBy("flight").agg(F.count(F.lit(1)).alias("n"), F.count_if("skipped").alias("n_skipped"), F.sum("width").alias("width"))


@query(r"WITH t AS (SELECT o_orderkey AS job, 'v' || CAST(o_custkey % 50 AS VARCHAR) AS v, CASE WHEN o_orderkey % 11 = 0 THEN 'tar/other' || CAST(o_orderkey AS VARCHAR) || '.tar' ELSE 'tar/zz_' || CAST(o_orderkey AS VARCHAR) || '_v' || CAST(o_custkey % 50 AS VARCHAR) || '.tar' END AS path, o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AS ok, CASE WHEN o_orderkey % 5 = 0 THEN '_ft' ELSE '' END AS suffix FROM orders), c AS (SELECT v || suffix AS variant, job, path, 'out/visloc_' || v || suffix || '_results.csv' AS member FROM t WHERE ok) SELECT variant, max(job) AS job, arg_max(path, job) AS path, arg_max(member, job) AS member FROM c GROUP BY variant")
def tar_staging(spark, d):
    """Which archive each variant's result file comes from: odd names and archives with two result files are left out, file names extend variants, the newest job wins."""
    k, v = F.col("o_orderkey"), F.concat(F.lit("v"), (F.col("o_custkey") % 50).cast("string"))
    path = F.when(k % 11 == 0, F.concat(F.lit("tar/other"), k.cast("string"), F.lit(".tar"))).otherwise(F.concat(F.lit("tar/zz_"), k.cast("string"), F.lit("_"), v, F.lit(".tar")))
    csv = F.concat(F.lit("out/visloc_"), v, F.when(k % 5 == 0, "_ft").otherwise(""), F.lit("_results.csv"))
    members = F.when(k % 7 == 0, F.array(F.lit("log.txt"), csv, F.lit("old/visloc_x_results.csv"))).otherwise(F.array(F.lit("log.txt"), csv))
    return readers.staged(table(spark, d, "orders").select(path.alias("path"), members.alias("members")))


@query(sql("SELECT r.label, r.band AS population, CAST(count(s.seq) AS BIGINT) AS n, count(s.seq) = 0 AND r.method = 'm9' AS missing FROM (SELECT unnest(['m0', 'm1', 'm9']) AS method, unnest(['Zero', 'One', 'Nine']) AS label, unnest(['full', 'test', 'full']) AS band) r LEFT JOIN (SELECT s.*, b.band AS own FROM scored s JOIN (SELECT flight AS fl, filename AS fn, band FROM banded) b ON s.flight = fl AND s.filename = fn WHERE gt_in_patch) s ON s.method = r.method AND (r.band = 'full' OR s.own = 'test') GROUP BY r.label, r.band, r.method", "scored", "banded"))
def registry_bands(spark, d):
    """Registered methods with the rows of their population (all or the test band); a method without a result file is reported."""
    reg = spark.createDataFrame([("m0", "Zero", "full"), ("m1", "One", "test"), ("m9", "Nine", "full")], "method string, label string, band string")
    x = readers.registered(reg, match_results(spark, d), with_band(frames(spark, d)))
    return x.groupBy("label", F.col("band").alias("population"), "missing").agg(F.count("seq").alias("n"))


def _bounded(spark, rows, folder):
    """A few rows, read now, after which the folder that they came from is deleted."""
    got, schema = rows.collect(), rows.schema
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.createDataFrame(got, schema)


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


PER_FLIGHT = "SELECT flight, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM frames GROUP BY flight"


def _per_flight(x):
    return x.groupBy("flight").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@query(sql(PER_FLIGHT, "frames"))
def sink_overwrite(spark, d):
    """A result file written twice holds the second run's rows only; read back by flight."""
    at, x = _folder(spark, "results"), frames(spark, d).select("flight", "filename", "seq", "lat")
    readers.overwrite_csv(x.filter("seq % 2 = 0"), at)
    readers.overwrite_csv(x, at)
    return _bounded(spark, _per_flight(spark.read.csv(at, header=True, schema=x.schema)), at)


@query(sql("SELECT method, count(*) AS n, count(*) FILTER (WHERE skipped AND m > 0) AS n_skipped, CAST(sum(inliers) AS BIGINT) AS inliers, count(offset_m) AS n_offset, count(*) FILTER (WHERE m > 1) AS n_raw, round(avg(CASE WHEN NOT (skipped AND m > 0) THEN offset_m END), 4) AS mean_m FROM (SELECT *, CAST(substr(method, 2) AS INTEGER) AS m FROM match_results) GROUP BY method", "match_results"))
def result_scan(spark, d):
    """Result files of three ages in one folder (columns in another order, or not there yet), read back each by its own header."""
    at, x = _folder(spark, "ages"), match_results(spark, d)
    ages = {
        "m0": ["method", "filename", "offset_m", "inliers"],
        "m1": ["inliers", "skipped", "filename", "method", "offset_m"],
        "m2": ["method", "skipped", "raw_err_m", "filename", "offset_m", "inliers", "t_match_ms"],
    }
    for m, columns in ages.items():
        readers.overwrite_csv(x.filter(F.col("method") == m).select(*columns).withColumn("offset_m", F.coalesce(F.col("offset_m").cast("string"), F.lit("nan"))), f"{at}/{m}")
    r = readers.result_csv(spark, f"{at}/*", ["offset_m", "inliers", "raw_err_m"])
    r = r.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("skipped").alias("n_skipped"), F.sum("inliers").cast("long").alias("inliers"), F.count("offset_m").alias("n_offset"), F.count("raw_err_m").alias("n_raw"),
        F.round(F.avg(F.when(~F.col("skipped"), F.col("offset_m"))), 4).alias("mean_m"),
    )
    return _bounded(spark, r, at)


@query(sql(PER_FLIGHT, "frames"))
def sink_append_csv(spark, d):
    """Result rows appended as CSV in two runs that overlap: the header is no row, each key stands there once."""
    at, x = _folder(spark, "rows"), frames(spark, d).select("flight", "filename", "seq")
    readers.append_new(spark, x.filter("seq % 3 = 0"), at, ["flight", "filename"], "csv")
    readers.append_new(spark, x.union(x), at, ["flight", "filename"], "csv")
    return _bounded(spark, _per_flight(spark.read.csv(at, header=True, schema=x.schema)), at)


@query(sql(PER_FLIGHT, "frames"))
def sink_resume(spark, d):
    """JSON lines appended in two runs that overlap, the second with every row twice: each key stands there once."""
    at, x = _folder(spark, "captions"), frames(spark, d).select("flight", "filename", "seq")
    readers.append_new(spark, x.filter("seq % 3 = 0"), at, ["flight", "filename"], "json")
    readers.append_new(spark, x.union(x), at, ["flight", "filename"], "json")
    return _bounded(spark, _per_flight(spark.read.schema(x.schema).json(at)), at)


@query(sql(PER_FLIGHT, "frames"))
def sink_ledger(spark, d):
    """Rows appended in runs that overlap, one of which dies before its commit: each key is read back once."""
    at, x = _folder(spark, "ledger"), frames(spark, d).select("flight", "filename", "seq")
    keys = ["flight", "filename"]
    ledger.append(x.filter("seq % 3 = 0"), at, keys)
    ledger.write_batch(x.filter("seq % 5 = 0"), at, keys, 64)
    ledger.append(x.union(x), at, keys)
    return _bounded(spark, _per_flight(ledger.committed(spark, at, x.schema)), at)


@query(sql("SELECT label % 3 AS flight, count(*) AS n, min(tile_id) AS first_tile, max(tile_id) AS last_tile FROM gallery GROUP BY 1", "gallery"))
def gallery_build(spark, d):
    """Galleries by model, flight, tile and stride: built where they are absent, read where they stand."""
    at, g = _folder(spark, "gallery"), gallery(spark, d).withColumn("flight", (F.col("label") % 3).cast("string"))
    flights = [r[0] for r in g.select("flight").distinct().collect()]

    def again():
        raise AssertionError("the gallery stands already")

    parts = {f: {"model": "image", "flight": f, "tile": "1024", "stride": "512"} for f in flights}
    for f in flights:
        readers.built_once(spark, at, parts[f], lambda f=f: g.filter(F.col("flight") == f).drop("flight"))
    both = readers.union_all([readers.built_once(spark, at, parts[f], again) for f in flights])
    x = both.groupBy(F.col("flight").cast("long").alias("flight")).agg(F.count(F.lit(1)).alias("n"), F.min("tile_id").alias("first_tile"), F.max("tile_id").alias("last_tile"))
    return _bounded(spark, x, at)


@query(sql("SELECT label, count(*) AS n, min(tile_id) AS first_tile, max(tile_id) AS last_tile, round(sum(list_inner_product(emb::DOUBLE[], list_transform(range(1, 65), lambda i: i::DOUBLE))), 4) AS moment FROM gallery GROUP BY label", "gallery"))
def gallery_archive(spark, d):
    """A gallery as array archives: written, then read back without the arrays that are not asked for."""
    at = _folder(spark, "arrays")
    archives.write_arrays(gallery(spark, d).select("tile_id", "lat", "lon", "emb", "label"), at, per_file=2000)
    x = spark.read.format("array_archive").schema("tile_id long, emb array<float>, label long").load(at)
    weighed = F.aggregate(F.transform("emb", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return _bounded(spark, x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("tile_id").alias("first_tile"), F.max("tile_id").alias("last_tile"), F.round(F.sum(weighed), 4).alias("moment")), at)


@query(sql("SELECT method || '_' || flight AS variant, 2 AS job, count(*) AS n, count(*) FILTER (WHERE offset_m <= 25) AS hits FROM scored GROUP BY method, flight", "scored"))
def archive_results(spark, d):
    """Result files out of job archives: two jobs a variant, the newer one's file is read out of its tar, the other is not opened for content."""
    at = _folder(spark, "jobs")
    x = A.scored(match_results(spark, d)).groupBy(F.concat_ws("_", "method", "flight").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("offset_m") <= 25, F.lit(False))).alias("hits"))
    jobs = x.select("variant", "n", "hits", F.explode(F.array(F.lit(1), F.lit(2))).alias("job"))
    csv = F.concat_ws("\n", F.lit("n,hits"), F.concat_ws(",", F.when(F.col("job") == 2, F.col("n")).otherwise(0), F.col("hits")))
    files = F.array(F.struct(F.concat(F.lit("out/visloc_"), "variant", F.lit("_results.csv")).alias("member"), csv.cast("binary").alias("content")), F.struct(F.lit("log.txt").alias("member"), F.lit("done").cast("binary").alias("content")))
    rows = jobs.select(F.concat(F.lit("zz_"), "job", F.lit("_"), "variant", F.lit(".tar")).alias("archive"), F.explode(files).alias("f")).select("archive", "f.*")
    archives.write_tars(rows, at).count()
    archives.register(spark)
    listed = spark.read.format("tar_archive").load(at).groupBy("path").agg(F.collect_list("member").alias("members"))
    newest = readers.staged(listed)
    held = spark.read.format("tar_archive").option("content", "true").load(at).withColumnsRenamed({"path": "_p", "member": "_m"})
    got = newest.join(held, (F.col("path") == F.col("_p")) & (F.col("member") == F.col("_m"))).select("variant", "job", F.split(F.col("content").cast("string"), "\n")[1].alias("line"))
    one = F.from_csv("line", "n long, hits long")
    return _bounded(spark, got.select("variant", F.col("job").cast("int").alias("job"), one.alias("r")).select("variant", "job", "r.*"), at)


@query(sql("SELECT 'map' || CAST(map_id AS VARCHAR) AS name, CAST(w/10 AS BIGINT) AS width, CAST(h/10 AS BIGINT) AS height, round(lt_lat, 6) AS top, round(lt_lon, 6) AS left_lon, round(rb_lat, 6) AS bottom, round(rb_lon, 6) AS right_lon, CAST(w/10*h/10*(map_id + 1) AS BIGINT) AS total FROM maps", "maps"))
def map_rasters(spark, d):
    """Maps as GeoTIFF files: corners and size come from the headers alone, pixels strip by strip."""
    at = _folder(spark, "rasters")
    c = F.col
    w, h = (c("w") / 10).cast("long"), (c("h") / 10).cast("long")
    pixels = F.repeat(F.char(c("map_id") + 1), (w * h).cast("int")).cast("binary")
    archives.write_rasters(maps(spark, d).select(F.concat(F.lit("map"), "map_id").alias("name"), w.alias("width"), h.alias("height"), c("lt_lat").alias("top"), c("lt_lon").alias("left"), c("rb_lat").alias("bottom"), c("rb_lon").alias("right"), pixels.alias("pixels")), at)
    archives.register(spark)
    stem = F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("name")
    heads = spark.read.format("raster_header").load(at).select(stem, "width", "height", F.round("top", 6).alias("top"), F.round("left", 6).alias("left_lon"), F.round("bottom", 6).alias("bottom"), F.round("right", 6).alias("right_lon"))
    total = F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("long") * F.octet_length("pixels")
    sums = spark.read.format("raster_strips").load(at).groupBy(stem).agg(F.sum(total).alias("total"))
    return _bounded(spark, heads.join(sums, "name"), at)


MANIFEST = "SELECT replace(filename, '.JPG', '') AS stem, flight, CASE WHEN seq % 60 < 8 THEN 'dropped' ELSE 'written' END AS status, seq % 60 AS n_corr FROM frames"


def _manifest(spark, d):
    n = F.col("seq") % 60
    return frames(spark, d).select(F.regexp_replace("filename", r"\.JPG$", "").alias("stem"), "flight", F.when(n < 8, "dropped").otherwise("written").alias("status"), n.alias("n_corr"))


@query(sql(f"SELECT * FROM ({MANIFEST}) WHERE status = 'written'", "frames"))
def manifest(spark, d):
    return _manifest(spark, d).filter("status = 'written'").orderBy("stem")


@query(sql(f"SELECT flight, count(*) AS total, count(*) FILTER (WHERE status = 'dropped') AS dropped, round(quantile_cont(n_corr, 0.5), 4) AS p50, round(quantile_cont(n_corr, 0.9), 4) AS p90, count(*) FILTER (WHERE status = 'dropped') > 0.4*count(*) AS warn FROM ({MANIFEST}) GROUP BY flight", "frames"))
def qc_summary(spark, d):
    dropped = F.count_if(F.col("status") == "dropped")
    n = F.count(F.lit(1))
    return _manifest(spark, d).groupBy("flight").agg(n.alias("total"), dropped.alias("dropped"), F.round(F.percentile("n_corr", 0.5), 4).alias("p50"), F.round(F.percentile("n_corr", 0.9), 4).alias("p90"), (dropped > n * 0.4).alias("warn"))


@query(sql(f"SELECT flight, '{{\"flight\":\"' || flight || '\",\"total\":' || CAST(count(*) AS VARCHAR) || ',\"sum_corr\":' || CAST(CAST(sum(n_corr) AS BIGINT) AS VARCHAR) || '}}' AS doc FROM ({MANIFEST}) GROUP BY flight", "frames"))
def qc_json(spark, d):
    g = _manifest(spark, d).groupBy("flight").agg(F.count(F.lit(1)).alias("total"), F.sum("n_corr").alias("sum_corr"))
    return g.select("flight", F.to_json(F.struct("flight", "total", "sum_corr")).alias("doc"))


@query("SELECT 'v' || CAST(o_custkey % 50 AS VARCHAR) AS variant, max(o_orderkey) AS job, arg_max('jobs/' || CAST(o_orderkey AS VARCHAR) || '.tar', o_orderkey) AS path FROM orders GROUP BY 1")
def job_dedup(spark, d):
    o = table(spark, d, "orders")
    return readers.newest(o.select(F.concat(F.lit("v"), (F.col("o_custkey") % 50).cast("string")).alias("variant"), F.col("o_orderkey").alias("job"), F.concat(F.lit("jobs/"), F.col("o_orderkey").cast("string"), F.lit(".tar")).alias("path")))


@query(sql("SELECT flight, filename FROM (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY seq) - 1 AS r, count(*) OVER (PARTITION BY flight) AS n FROM frames) WHERE n <= 40 OR r IN (SELECT CAST(round_even(i*(n - 1)/39.0::DOUBLE, 0) AS BIGINT) FROM range(40) t(i))", "frames"))
def even_sample(spark, d):
    return sampling.even(frames(spark, d), 40).select("flight", "filename")


@query(sql("SELECT flight, filename FROM (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY md5('42/' || filename), seq) AS r FROM frames) WHERE r <= ceil(50.0::DOUBLE/(SELECT count(DISTINCT flight) FROM frames)) ORDER BY r, flight LIMIT 50", "frames"))
def quota_sample(spark, d):
    return sampling.quota(frames(spark, d), 50, F.md5(F.concat(F.lit("42/"), F.col("filename")))).select("flight", "filename")


@query(sql("SELECT flight, filename FROM frames ORDER BY md5('0/' || filename), seq LIMIT 64", "frames"))
def hash_sample(spark, d):
    return sampling.by_hash(frames(spark, d), 64, F.md5(F.concat(F.lit("0/"), F.col("filename")))).select("flight", "filename")


@query(sql("SELECT flight, filename FROM (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY seq) AS r FROM frames) WHERE r <= 10", "frames"))
def head_limit(spark, d):
    return sampling.head(frames(spark, d), 10).select("flight", "filename")


@query(sql("SELECT pair, count(*) AS raw, count(*) FILTER (WHERE conf >= 0.05) AS good, count(*) FILTER (WHERE conf >= 0.05 AND x1 < 1000 AND y1 < 640) AS inside, least(50, count(*) FILTER (WHERE conf >= 0.05)) AS kept FROM correspondences GROUP BY pair", "correspondences"))
def conf_mask_counts(spark, d):
    """Counters after the confidence mask, the padding mask and the cap on the most confident."""
    ok = F.col("conf") >= 0.05
    x = correspondences(spark, d)
    r = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("conf"), "k1", "k2", "k3"))
    x = x.withColumn("r", r)
    return x.groupBy("pair").agg(F.count(F.lit(1)).alias("raw"), F.count_if(ok).alias("good"), F.count_if(ok & (F.col("x1") < 1000) & (F.col("y1") < 640)).alias("inside"), F.count_if(ok & (F.col("r") <= K.TOP_MATCHES)).alias("kept"))


@query(sql("SELECT pair, k1, k2, k3, conf FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY conf DESC, k1, k2, k3) AS r FROM correspondences) WHERE r <= 50", "correspondences"))
def top_matches(spark, d):
    """The 50 most confident correspondences of each pair."""
    return fit.most_confident(correspondences(spark, d), K.TOP_MATCHES).select("pair", "k1", "k2", "k3", "conf")


#: The teacher transform of each frame and its inverse, coarse cells of 128 pixels, real height 640 of 680.
LOOP, LOOP_REAL = 128, (1024, 640)
LOOP_SQL = """WITH h AS (SELECT seq, s*cos(r) AS h0, -s*sin(r) AS h1, (seq % 97)::DOUBLE AS h2, s*sin(r) AS h3, s*cos(r) AS h4, (seq % 89)::DOUBLE AS h5, (seq % 5)/100000.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, 1.0::DOUBLE AS h8 FROM (SELECT *, 0.5::DOUBLE + (seq % 31)/100.0::DOUBLE AS s, radians((seq % 13 - 6)::DOUBLE) AS r FROM frames)),
  v AS (SELECT *, h4*h8 - h5*h7 AS g0, h2*h7 - h1*h8 AS g1, h1*h5 - h2*h4 AS g2, h5*h6 - h3*h8 AS g3, h0*h8 - h2*h6 AS g4, h2*h3 - h0*h5 AS g5, h3*h7 - h4*h6 AS g6, h1*h6 - h0*h7 AS g7, h0*h4 - h1*h3 AS g8 FROM h),
  a AS (SELECT v.*, i, (i % 8)*128.0::DOUBLE AS x, (i // 8)*128.0::DOUBLE AS y FROM v, range(1, 40) t(i)),
  b AS (SELECT *, round_even((h0*x + h1*y + h2)/(h6*x + h7*y + h8)/128, 0) AS c, round_even((h3*x + h4*y + h5)/(h6*x + h7*y + h8)/128, 0) AS r FROM a),
  j AS (SELECT *, CASE WHEN c >= 0 AND c < 8 AND r >= 0 AND r < 5 THEN CAST(c + r*8 AS BIGINT) ELSE 0 END AS j FROM b),
  k AS (SELECT *, (j % 8)*128.0::DOUBLE AS u, (j // 8)*128.0::DOUBLE AS w FROM j),
  l AS (SELECT *, round_even((g0*u + g1*w + g2)/(g6*u + g7*w + g8)/128, 0) AS c2, round_even((g3*u + g4*w + g5)/(g6*u + g7*w + g8)/128, 0) AS r2 FROM k)
  SELECT seq, CAST(count(*) AS INTEGER) AS n, CAST(sum(i*j) AS BIGINT) AS digest FROM l WHERE CASE WHEN c2 >= 0 AND c2 < 8 AND r2 >= 0 AND r2 < 5 THEN CAST(c2 + r2*8 AS BIGINT) ELSE 0 END = i AND i // 8 < 5 GROUP BY seq"""


@query(sql(LOOP_SQL, "frames"))
def loopback_grid(spark, d):
    """Coarse cells that come back through a frame's transform and its inverse: how many, and a sum that names them."""
    hm = _h()
    x = fit.looped_back(frames(spark, d).select("seq"), hm, geo.inverse(hm), K.CROP_W, K.CROP_H, LOOP, LOOP_REAL)
    return x.groupBy("seq").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.col("i").cast("long") * F.col("j")).alias("digest"))


#: CRC-32 for DuckDB, which has none: the byte table by its rule (eight shifts of the reflected polynomial), and a fold over a key's ASCII bytes.
CRC_TABLE = "crc_rule AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_rule WHERE k < 8), crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM crc_rule WHERE k = 8)"


def _crc(key: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])))"


GREEDY = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY conf DESC, k1, k2, k3) AS i, CAST(floor(x0/8) AS BIGINT)*1000 + CAST(floor(y0/8) AS BIGINT) AS a, CAST(floor(x1/8) AS BIGINT)*1000 + CAST(floor(y1/8) AS BIGINT) AS b FROM correspondences),
  g AS (SELECT pair, 0::BIGINT AS i, []::BIGINT[] AS l, []::BIGINT[] AS r, false AS keep FROM o GROUP BY pair
    UNION ALL SELECT o.pair, o.i, CASE WHEN ok THEN list_append(l, a) ELSE l END, CASE WHEN ok THEN list_append(r, b) ELSE r END, ok
    FROM (SELECT o.*, g.l, g.r, NOT list_contains(g.l, o.a) AND NOT list_contains(g.r, o.b) AS ok FROM g JOIN o ON o.pair = g.pair AND o.i = g.i + 1) o)
  SELECT o.pair, x0, y0, x1, y1, conf, k1, k2, k3 FROM o JOIN g ON g.pair = o.pair AND g.i = o.i WHERE keep"""

LEGS = """WITH RECURSIVE o AS (SELECT flight, phi1 AS h, (seq*17 % 101 - 50)/5.0::DOUBLE AS res, row_number() OVER (PARTITION BY flight ORDER BY seq) AS i FROM frames),
  g AS (SELECT flight, 0::BIGINT AS i, []::DOUBLE[] AS c, []::DOUBLE[] AS s, 0::BIGINT AS k FROM o GROUP BY flight
    UNION ALL SELECT flight, i, CASE WHEN hit IS NULL THEN list_append(c, cos(radians(h))) ELSE list_transform(c, lambda v, j: CASE WHEN j = hit THEN v + cos(radians(h)) ELSE v END) END,
      CASE WHEN hit IS NULL THEN list_append(s, sin(radians(h))) ELSE list_transform(s, lambda v, j: CASE WHEN j = hit THEN v + sin(radians(h)) ELSE v END) END, coalesce(hit, len(c) + 1)
    FROM (SELECT o.flight, o.i, o.h, g.c, g.s, list_filter(range(1, len(g.c) + 1), lambda j: abs(((o.h - degrees(atan2(g.s[j], g.c[j])) + 180) % 360 + 360) % 360 - 180) < 45)[1] AS hit FROM g JOIN o ON o.flight = g.flight AND o.i = g.i + 1)),
  m AS (SELECT g.flight, g.k, sum(cos(radians(h))) AS c, sum(sin(radians(h))) AS s, median(res) AS res, count(*) AS n FROM g JOIN o ON o.flight = g.flight AND o.i = g.i GROUP BY ALL)
  SELECT flight, CAST(k - 1 AS INTEGER) AS leg, round(degrees(atan2(s, c)), 1) AS heading, round(res, 1) AS "offset", CAST(n AS INTEGER) AS n FROM m WHERE n >= 3"""

SPREAD = """WITH RECURSIVE o AS (SELECT flight, seq, seq % 5 <> 0 AS ok, row_number() OVER (PARTITION BY flight ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY flight) AS n FROM frames),
  g AS (SELECT flight, 0 AS j, []::BIGINT[] AS used FROM o GROUP BY flight
    UNION ALL SELECT g.flight, g.j + 1, list_append(any_value(g.used), arg_min(o.p, (abs(o.p - CAST(floor((g.j + 0.5::DOUBLE)*o.n/6) AS BIGINT)), o.p))) FROM g JOIN o ON o.flight = g.flight WHERE g.j < 6 AND o.ok AND NOT list_contains(g.used, o.p) GROUP BY g.flight, g.j),
  u AS (SELECT flight, unnest(arg_max(used, j)) AS p FROM g GROUP BY flight)
  SELECT o.flight, o.seq, CAST(row_number() OVER (PARTITION BY o.flight ORDER BY o.p) - 1 AS INTEGER) AS slot FROM u JOIN o ON o.flight = u.flight AND o.p = u.p"""


@query(sql(GREEDY, "correspondences"))
def greedy_dedup(spark, d):
    return fit.greedy_one_to_one(correspondences(spark, d))


@query()
def ransac_fit(spark, d):
    return fit.ransac_similarity(correspondences(spark, d))


@query(sql(LEGS, "frames"))
def leg_clusters(spark, d):
    x = frames(spark, d).select("flight", "seq", F.col("phi1").alias("heading"), ((F.col("seq") * 17 % 101 - 50) / 5.0).alias("residual"))
    return fit.leg_clusters(x)


@query(sql(SPREAD, "frames"))
def spread_choice(spark, d):
    return fit.spread_choice(frames(spark, d).select("flight", "seq", (F.col("seq") % 5 != 0).alias("accepted")), 6)


@query()
def prior_offsets(spark, d):
    x = frames(spark, d)
    return fit.gaussian_offsets(x, F.concat_ws("/", "flight", "filename"), K.PRIOR_SIGMA_M).select("flight", "filename", "dx_m", "dy_m")


@query()
def homography_inliers(spark, d):
    """Correspondences that agree with their pair's homography, the 50 most confident of each. No SQL: the consensus is a seeded search."""
    return fit.ransac_homography(correspondences(spark, d), most=K.TOP_MATCHES).select("pair", "k1", "k2", "k3", "conf", "h")


@query(sql(f"WITH RECURSIVE {CRC_TABLE} SELECT flight, filename, CASE WHEN {_crc("'mix/' || flight || '/' || filename")} % 100 < 30 THEN 'true' ELSE 'jitter' END AS mode FROM frames, crc_table", "frames"))
def hash_route(spark, d):
    """Rows on true positions or on jittered ones, by the CRC-32 of their key."""
    return frames(spark, d).select("flight", "filename", fit.offset_mode(F.col("flight"), F.col("filename"), "mix", 30).alias("mode"))


@query()
def crop_offsets(spark, d):
    """The offset of each crop in mode mix: none on true positions, else seeded and kept in the frame. No SQL: DuckDB has neither CRC-32 nor the generator."""
    gsd = geo.metres_per_px(F.col("height"), geo.footprint_k(F.col("flight")))
    x = fit.crop_offsets(frames(spark, d), "mix", 30, K.PRIOR_SIGMA_M, gsd, 40.0, float(min(K.CROP_W, K.CROP_H)))
    return x.select("flight", "filename", "mode", "dx_m", "dy_m")


@query(sql(f"WITH m AS ({MANIFEST}), f AS (SELECT flight, count(*) AS total, CAST(sum(n_corr) AS BIGINT) AS sum_corr, list_sort(list(DISTINCT n_corr) FILTER (WHERE status = 'dropped')) AS dropped FROM m GROUP BY flight) SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(sum_corr) AS BIGINT) AS sum_corr, array_to_string(flatten(list(dropped ORDER BY flight)), ',') AS dropped FROM f", "frames"))
def qc_merge(spark, d):
    """Flights' statistics as one: numbers summed, lists joined flight by flight."""
    n = F.collect_set(F.when(F.col("status") == "dropped", F.col("n_corr")))
    x = _manifest(spark, d).groupBy("flight").agg(F.count(F.lit(1)).alias("total"), F.sum("n_corr").alias("sum_corr"), F.array_sort(n).alias("dropped"))
    return readers.merged(x, "flight").withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


@query(sql("SELECT flight, filename, seq, seq % 300 AS raw, seq % 60 AS inliers, (seq % 97)::DOUBLE AS tx, (seq % 89)::DOUBLE AS ty, 50.0::DOUBLE + seq % 700 AS t_match_ms FROM frames", "frames"))
def stand_in_match(spark, d):
    """The matcher boundary with its stand-in."""
    from ..sources import adapters

    x = adapters.match(frames(spark, d).select("flight", "filename", "seq"), adapters.stand_in_matcher, ["flight", "filename", "seq"])
    return x.select("flight", "filename", "seq", F.col("raw").cast("long").alias("raw"), F.col("inliers").cast("long").alias("inliers"), F.col("h")[2].alias("tx"), F.col("h")[5].alias("ty"), "t_match_ms")


@query(sql("SELECT flight, filename, seq % 7 AS e0, seq % 11 AS e1, CASE WHEN seq % 3 <> 0 THEN round(length(filename)/sqrt(length(filename)*length(filename) + 1)::DOUBLE, 5) END AS t0 FROM frames", "frames"))
def stand_in_encode(spark, d):
    """The encoder boundary with a stand-in bundle: an image vector for each frame, a text vector where there is a caption."""
    from ..sources import adapters

    x = frames(spark, d).select("flight", "filename", "seq", F.when(F.col("seq") % 3 != 0, F.col("filename")).alias("caption"))
    x = adapters.encode_both(x, adapters.stand_in_encoders, "seq", "caption")
    return x.select("flight", "filename", F.col("emb")[0].cast("long").alias("e0"), F.col("emb")[1].cast("long").alias("e1"), F.round(F.col("text_emb")[0].cast("double"), 5).alias("t0"))


@query(sql("SELECT flight, filename, CASE WHEN seq % 13 <> 0 THEN 'fields along road ' || CAST(seq % 100 AS VARCHAR) END AS caption FROM frames", "frames"))
def stand_in_caption(spark, d):
    """The captioner boundary with a stand-in that fails on some frames: retried, then left without a caption."""
    from ..sources import adapters

    return adapters.caption(frames(spark, d).select("flight", "filename", "seq"), adapters.stand_in_captioner, "seq", wait=0.0).select("flight", "filename", "caption")
