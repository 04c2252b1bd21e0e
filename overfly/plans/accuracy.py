"""Accuracy, error, band and table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..operators import accuracy as A
from ..operators.bands import with_band
from ..operators.quantiles import exact, with_quantiles
from ..operators.store import checkpointed, ranked, removed, shared_folder
from ..registry import query
from ..streaming.extremes import extremes_stream
from .views import frames, match_results, sql

ACC = ", ".join(f"round(count(*) FILTER (WHERE coalesce(offset_m <= {t}, false) AND coalesce(inliers, 0) >= 7)*100.0::DOUBLE/count(*), 6) AS a{t}" for t in K.THRESHOLDS)
UNG = ", ".join(f"round(count(*) FILTER (WHERE coalesce(raw_err_m <= {t}, false))*100.0::DOUBLE/count(*), 6) AS u{t}" for t in K.THRESHOLDS)
ERR = "round(avg({c}), 6) AS mean_m, round(median({c}), 6) AS median_m, round(sqrt(avg({c}*{c})), 6) AS rmse_m, round(quantile_cont({c}, 0.9), 6) AS p90_m, round(max({c}), 6) AS max_m"


@query(sql(f"SELECT method, coalesce(flight, 'ALL') AS flight, count(*) AS n, {ACC}, round(median(offset_m), 6) AS med_m FROM scored GROUP BY GROUPING SETS ((method, flight), (method))", "scored"))
def acc_by_method_flight(spark, d):
    return A.accuracy(A.scored(match_results(spark, d)), ["method", "flight"])


@query(sql(f"SELECT method, flight, count(*) AS n, {UNG}, round(median(raw_err_m), 6) AS median_m, round(quantile_cont(raw_err_m, 0.9), 6) AS p90_m, round(max(raw_err_m), 6) AS max_m FROM scored GROUP BY ALL", "scored"))
def acc_ungated(spark, d):
    x = A.scored(match_results(spark, d))
    g = x.groupBy("method", "flight").agg(F.count(F.lit(1)).alias("n"), *[A.share(A.within(t, "raw_err_m")).alias(f"u{t}") for t in K.THRESHOLDS], F.round(F.max("raw_err_m"), 6).alias("max_m"))
    return with_quantiles(g, x, ["method", "flight"], A.error_quantiles("raw_err_m"))


@query(sql(f"SELECT method, flight, {ERR.format(c='offset_m')}, round(median(t_match_ms), 6) AS t_median, round(avg(t_match_ms), 6) AS t_mean, round(quantile_cont(t_match_ms, 0.9), 6) AS t_p90, round(count(*) FILTER (WHERE inliers >= 7)*100.0::DOUBLE/count(*), 6) AS accepted, CAST(median(inliers) AS DOUBLE) AS med_inliers, round(median(inliers/nullif(good, 0)::DOUBLE), 6) AS med_ratio, round(count(*) FILTER (WHERE coalesce(gt_in_patch, false))*100.0::DOUBLE/count(*), 6) AS in_patch FROM scored GROUP BY ALL", "scored"))
def err_stats(spark, d):
    x = A.scored(match_results(spark, d))
    g = x.groupBy("method", "flight").agg(*A.errors(), F.round(F.avg("t_match_ms"), 6).alias("t_mean"), A.share(A.gate()).alias("accepted"), A.share(F.coalesce("gt_in_patch", F.lit(False))).alias("in_patch"))
    ratio = F.col("inliers") / F.nullif(F.col("good"), F.lit(0))
    t = F.col("t_match_ms")
    return with_quantiles(g, x, ["method", "flight"], A.error_quantiles() | {"t_median": (t, 0.5), "t_p90": (t, 0.9), "med_inliers": (F.col("inliers"), 0.5), "med_ratio": (ratio, 0.5)})


GRID = [float(x) for x in range(0, 101, 5)]


@query(sql("SELECT method, x::DOUBLE AS x, round(count(*) FILTER (WHERE coalesce(offset_m <= x, false))*100.0::DOUBLE/count(*), 6) AS acc FROM scored, range(0, 101, 5) g(x) WHERE coalesce(gt_in_patch, false) GROUP BY ALL", "scored"))
def acc_curve(spark, d):
    return A.curve(A.solvable(match_results(spark, d)), ["method"], GRID, F.col("offset_m"))


def _bands(spark, d):
    """Frames' bands; only what orders a flight is ranked."""
    return with_band(frames(spark, d).select("flight", "filename", "lat", "lon")).select("flight", "filename", "band")


@query(sql("SELECT flight, filename, band FROM banded", "banded"))
def band_assign(spark, d):
    return _bands(spark, d)


@query(sql("SELECT flight, band, count(*) AS n FROM banded GROUP BY ALL", "banded"))
def band_counts(spark, d):
    return _bands(spark, d).groupBy("flight", "band").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"SELECT method, coalesce(flight, 'ALL') AS flight, band, count(*) AS n, {ACC}, {UNG}, round(median(offset_m), 6) AS med_offset_m, round(median(raw_err_m), 6) AS med_raw_err_m FROM scored JOIN (SELECT flight AS fl, filename AS fn, band FROM banded) ON flight = fl AND filename = fn GROUP BY GROUPING SETS ((method, flight, band), (method, band))", "scored", "banded"))
def band_summary(spark, d):
    """Rows meet their bands once; what the figures need of them is stored for the aggregates and the quantiles' passes."""
    at = f"{shared_folder(spark)}/bands-{uuid.uuid4().hex}"
    keys = ["method", "flight", "band"]
    try:
        A.scored(match_results(spark, d)).join(_bands(spark, d), ["flight", "filename"]).select(*keys, "inliers", "offset_m", "raw_err_m").write.parquet(at)
        x = spark.read.parquet(at)
        aggs = [F.count(F.lit(1)).alias("n"), *[A.share(A.within(t, accepted=A.gate())).alias(f"a{t}") for t in K.THRESHOLDS], *[A.share(A.within(t, "raw_err_m")).alias(f"u{t}") for t in K.THRESHOLDS]]
        g = [F.col(k) for k in keys]
        out = x.groupingSets([g, [g[0], g[2]]], *g).agg(*aggs).withColumn("flight", F.coalesce("flight", F.lit("ALL")))
        return checkpointed(with_quantiles(out, A.with_total(x.select(*keys, "offset_m", "raw_err_m"), "flight"), keys, {"med_offset_m": (F.col("offset_m"), 0.5), "med_raw_err_m": (F.col("raw_err_m"), 0.5)}))
    finally:
        removed(spark, at)


@query(sql("SELECT flight, filename, band FROM banded WHERE band IN ('val', 'test')", "banded"))
def band_union(spark, d):
    b = _bands(spark, d)
    return b.filter("band = 'val'").unionByName(b.filter("band = 'test'"))


@query(sql("SELECT flight, filename FROM scored GROUP BY ALL HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM scored)", "scored"))
def common_rows(spark, d):
    """Rows that every method has. Both counts come from aggregates; the one-row total is broadcast."""
    x = A.scored(match_results(spark, d)).select("method", "flight", "filename").distinct()
    per = x.groupBy("flight", "filename").agg(F.count(F.lit(1)).alias("k"))
    every = x.agg(F.count_distinct("method").alias("every"))
    return per.join(F.broadcast(every), F.col("k") == F.col("every")).select("flight", "filename")


def methods(spark, d) -> list[str]:
    return [r[0] for r in match_results(spark, d).select("method").distinct().orderBy("method").collect()]


@query(sql("SELECT flight, round(max(a) FILTER (WHERE method = 'm0'), 6) AS m0, round(max(a) FILTER (WHERE method = 'm1'), 6) AS m1, round(max(a) FILTER (WHERE method = 'm2'), 6) AS m2 FROM (SELECT coalesce(flight, 'ALL') AS flight, method, count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/count(*) AS a FROM scored GROUP BY GROUPING SETS ((method, flight), (method))) GROUP BY flight", "scored"))
def pivot_a25(spark, d):
    """A@25 by flight, a column for each method of the results."""
    x = A.accuracy(A.scored(match_results(spark, d)), ["method", "flight"], thresholds=(25,))
    # The columns are the methods that there are: a catalogue, found by one distinct.
    return x.groupBy("flight").pivot("method", methods(spark, d)).agg(F.first("a25"))


@query(sql("WITH c AS (SELECT method, flight, round(count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/count(*), 6) AS a25 FROM scored WHERE gt_in_patch GROUP BY ALL) SELECT m.method, f.flight, a25 FROM (SELECT DISTINCT method FROM scored) m CROSS JOIN (SELECT DISTINCT flight FROM frames UNION SELECT unnest(['07', '09'])) f LEFT JOIN c ON c.method = m.method AND c.flight = f.flight", "scored"))
def heatmap(spark, d):
    """A cell for every method and every flight of the frames or of the registry (07 and 09 are registered without frames), null where there are no rows."""
    x = A.scored(match_results(spark, d))
    cells = A.solvable(match_results(spark, d)).groupBy("method", "flight").agg(A.share(A.within(25)).alias("a25"))
    # Flights are a catalogue; every cell of the matrix of methods and flights is a row.
    flights = sorted({"07", "09"} | {r[0] for r in frames(spark, d).select("flight").distinct().collect()})
    dims = x.select("method").distinct().withColumn("flight", F.explode(F.array(*[F.lit(f) for f in flights])))
    return dims.join(cells, ["method", "flight"], "left")


@query(sql("SELECT method, flight, filename, seq, CAST(n_ok AS BIGINT) AS n_ok, n_seen FROM (SELECT method, flight, filename, seq, sum(CASE WHEN coalesce(offset_m <= 25, false) THEN 1 ELSE 0 END) OVER w AS n_ok, count(*) OVER w AS n_seen FROM scored WINDOW w AS (PARTITION BY method, flight ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", "scored"))
def running_acc(spark, d):
    """Successes and rows so far, in each method's order of a flight's frames."""
    x = A.scored(match_results(spark, d)).select("method", "flight", "filename", "seq", "offset_m")
    x = ranked(x, ["method", "flight"], [F.col("seq")], "n_seen", {"n_ok": A.within(25).cast("long")})
    return x.select("method", "flight", "filename", "seq", "n_ok", (F.col("n_seen") + 1).alias("n_seen"))


@query(sql("SELECT method, count(*) FILTER (WHERE gt_in_patch AND ok) AS localized, count(*) FILTER (WHERE gt_in_patch AND NOT ok) AS missed, count(*) FILTER (WHERE NOT gt_in_patch) AS unsolvable FROM (SELECT *, coalesce(offset_m <= 25, false) AS ok FROM scored) GROUP BY method", "scored"))
def outcomes(spark, d):
    inside, ok = F.coalesce("gt_in_patch", F.lit(False)), A.within(25)
    return A.scored(match_results(spark, d)).groupBy("method").agg(F.count_if(inside & ok).alias("localized"), F.count_if(inside & ~ok).alias("missed"), F.count_if(~inside).alias("unsolvable"))


@query(sql("SELECT method, lo, CAST(count(s.seq) AS BIGINT) AS n, round(count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/nullif(count(s.seq), 0), 6) AS a25 FROM (SELECT DISTINCT method FROM scored) CROSS JOIN (SELECT unnest([0,7,15,30,60,125,250,500,1000]) AS lo, unnest([7,15,30,60,125,250,500,1000,NULL]) AS hi) b LEFT JOIN (SELECT method AS mm, seq, inliers, offset_m FROM scored) s ON mm = method AND inliers >= lo AND (hi IS NULL OR inliers < hi) GROUP BY method, lo", "scored"))
def inlier_bins(spark, d):
    """Bins by one CASE ladder and a left join on the bin list, so an empty bin stays, with a null rate."""
    edges = K.INLIER_EDGES
    lo = F.lit(None).cast("int")
    for e in edges:
        lo = F.when(F.col("inliers") >= e, F.lit(e)).otherwise(lo)
    x = A.scored(match_results(spark, d)).withColumn("lo", lo)
    got = x.groupBy("method", "lo").agg(F.count(F.lit(1)).alias("n"), A.share(A.within(25)).alias("a25"))
    bins = x.select("method").distinct().withColumn("lo", F.explode(F.array(*[F.lit(e) for e in edges])))
    return bins.join(got, ["method", "lo"], "left").select("method", "lo", F.coalesce("n", F.lit(0)).alias("n"), "a25")


@query(sql("WITH q AS (SELECT method, quantile_cont(height, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS e FROM scored GROUP BY method), u AS (SELECT method, unnest(list_sort(list_distinct(e))) AS v FROM q), b AS (SELECT method, v AS lo, lead(v) OVER (PARTITION BY method ORDER BY v) AS hi FROM u) SELECT b.method, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n, round(median(raw_err_m), 6) AS med FROM b JOIN scored s ON s.method = b.method AND s.height BETWEEN lo AND hi WHERE hi IS NOT NULL GROUP BY b.method, lo, hi HAVING count(*) >= 5", "scored"))
def altitude_trend(spark, d):
    """Deciles of height, closed at both ends: a row on an inner edge counts in both bins.

    At most ten bins a method are broadcast; rows meet them in a range join.
    """
    x = A.scored(match_results(spark, d)).select("method", "height", "raw_err_m")
    e = F.array_sort(F.array_distinct(F.percentile("height", F.array(*[F.lit(i / 10) for i in range(11)]))))
    b = x.groupBy(F.col("method").alias("bm")).agg(e.alias("e")).select("bm", F.explode(F.expr("transform(sequence(1, size(e) - 1), i -> struct(e[i - 1] AS lo, e[i] AS hi))")).alias("b")).select("bm", "b.lo", "b.hi")
    j = x.join(F.broadcast(b), (F.col("method") == F.col("bm")) & F.col("height").between(F.col("lo"), F.col("hi")))
    g = j.groupBy("method", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("raw_err_m"), 6).alias("med")).filter("n >= 5")
    return g.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query(sql("SELECT method, round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3, round(min(raw_err_m) FILTER (WHERE raw_err_m >= q[1] - 1.5::DOUBLE*(q[3] - q[1])), 6) AS whisker_lo, round(max(raw_err_m) FILTER (WHERE raw_err_m <= q[3] + 1.5::DOUBLE*(q[3] - q[1])), 6) AS whisker_hi FROM scored JOIN (SELECT method AS mm, quantile_cont(raw_err_m, [0.25, 0.5, 0.75]) AS q FROM scored GROUP BY method) ON mm = method GROUP BY method, q", "scored"))
def box_stats(spark, d):
    x = A.scored(match_results(spark, d)).select("method", "raw_err_m")
    q = exact(x, ["method"], {f"q{i}": (F.col("raw_err_m"), i / 4) for i in (1, 2, 3)}).select("method", F.array("q1", "q2", "q3").alias("q"))
    # A row for each method goes to where the rows lie.
    reach = (F.col("q")[2] - F.col("q")[0]) * 1.5
    v = F.col("raw_err_m")
    g = x.join(F.broadcast(q), "method").groupBy("method", "q").agg(F.min(F.when(v >= F.col("q")[0] - reach, v)).alias("whisker_lo"), F.max(F.when(v <= F.col("q")[2] + reach, v)).alias("whisker_hi"))
    return g.select("method", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)], F.round("whisker_lo", 6).alias("whisker_lo"), F.round("whisker_hi", 6).alias("whisker_hi"))


@query(sql("SELECT * FROM (SELECT method, flight, filename, inliers, CAST(row_number() OVER (PARTITION BY method, flight ORDER BY inliers DESC, seq) AS INTEGER) AS best_rank, CAST(row_number() OVER (PARTITION BY method, flight ORDER BY inliers, seq) AS INTEGER) AS worst_rank FROM scored) WHERE best_rank <= 3 OR worst_rank <= 3", "scored"))
def best_worst(spark, d):
    w = Window.partitionBy("method", "flight")
    x = A.scored(match_results(spark, d)).select("method", "flight", "filename", "inliers", F.row_number().over(w.orderBy(F.desc("inliers"), "seq")).alias("best_rank"), F.row_number().over(w.orderBy("inliers", "seq")).alias("worst_rank"))
    return x.filter("best_rank <= 3 OR worst_rank <= 3")


@query(sql("WITH r AS (SELECT method, flight, filename, inliers, row_number() OVER (PARTITION BY method, flight ORDER BY inliers DESC, seq) AS b, row_number() OVER (PARTITION BY method, flight ORDER BY inliers, seq) AS w FROM scored) SELECT method, flight, 'best' AS side, CAST(b AS INTEGER) AS place, filename, inliers FROM r WHERE b <= 3 UNION ALL SELECT method, flight, 'worst', CAST(w AS INTEGER), filename, inliers FROM r WHERE w <= 3", "scored"))
def best_worst_stream(spark, d):
    """Best and worst rows out of a stream: files arrive one after the other, some rows twice; the state holds six rows a group."""
    at = f"{shared_folder(spark)}/extremes-{uuid.uuid4().hex}"
    x = A.scored(match_results(spark, d)).select("method", "flight", "filename", "seq", "inliers")
    x.repartition(4, "seq").unionByName(x.filter("seq % 10 = 0").coalesce(1)).write.parquet(f"{at}/in")
    each = lambda rows, i: rows.write.mode("overwrite").parquet(f"{at}/out/batch={i}")
    extremes_stream(spark, f"{at}/in", x.schema, f"{at}/state", each, files=2).awaitTermination()
    got = spark.read.parquet(f"{at}/out")
    # A group's latest batch replaces its earlier ones.
    last = got.groupBy("method", "flight").agg(F.max("batch").alias("batch"))
    rows = checkpointed(got.join(last, ["method", "flight", "batch"]).select("method", "flight", "side", "place", "filename", "inliers"))
    removed(spark, at)
    return rows


@query(sql("WITH a AS (SELECT method, count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/count(*) AS stored, count(*) FILTER (WHERE coalesce(round(offset_m, 2) <= 25, false))*100.0::DOUBLE/count(*) AS again FROM scored GROUP BY method) SELECT method, round(stored, 6) AS stored, round(again, 6) AS recomputed, abs(stored - again) > 0.5 AS drifted FROM a", "scored"))
def drift_check(spark, d):
    """Stored flags (unrounded errors) against flags recomputed from errors rounded to 2 digits; tolerance half a point."""
    x = A.scored(match_results(spark, d)).withColumn("again_m", F.round("offset_m", 2))
    g = x.groupBy("method").agg(A.share(A.within(25)).alias("stored"), A.share(A.within(25, "again_m")).alias("recomputed"))
    return g.withColumn("drifted", F.abs(F.col("stored") - F.col("recomputed")) > 0.5)


@query(sql("WITH g AS (SELECT method, count(*) AS n, round(count(*) FILTER (WHERE coalesce(offset_m <= 5, false))*100.0::DOUBLE/count(*), 6) AS a5, round(count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/count(*), 6) AS a25, round(median(offset_m), 6) AS med_err_m, round(median(t_match_ms), 6) AS med_t_ms FROM scored WHERE gt_in_patch GROUP BY method), s AS (SELECT method AS mm, count(*) FILTER (WHERE skipped) AS skipped FROM match_results GROUP BY method) SELECT CASE WHEN method = 'm0' THEN 'classical' ELSE 'learned' END AS family, method, n, a5, a25, med_err_m, med_t_ms, skipped, a25 = max(a25) OVER () AS best FROM g JOIN s ON mm = method", "scored"))
def matcher_table(spark, d):
    x = match_results(spark, d)
    g = A.solvable(x).groupBy("method").agg(F.count(F.lit(1)).alias("n"), A.share(A.within(5)).alias("a5"), A.share(A.within(25)).alias("a25"), F.round(F.median("offset_m"), 6).alias("med_err_m"), F.round(F.median("t_match_ms"), 6).alias("med_t_ms"))
    s = x.groupBy("method").agg(F.count_if("skipped").alias("skipped"))
    fam = spark.createDataFrame([("m0", "classical"), ("m1", "learned"), ("m2", "learned")], "method string, family string")
    # One row a method: the window over all of them is over a table of methods.
    best = F.col("a25") == F.max("a25").over(Window.partitionBy(F.lit(0)))
    return g.join(s, "method").join(F.broadcast(fam), "method").withColumn("best", best).select("family", "method", "n", "a5", "a25", "med_err_m", "med_t_ms", "skipped", "best")


@query(sql("WITH g AS (SELECT method, round(count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/count(*), 1) AS a25, count(*) AS n FROM scored GROUP BY method) SELECT method || ' & ' || CAST(n AS VARCHAR) || ' & ' || CASE WHEN a25 = max(a25) OVER () THEN '\\textbf{' || format('{:.1f}', a25) || '}' ELSE format('{:.1f}', a25) END || ' \\\\' AS line FROM g", "scored"))
def table_render(spark, d):
    g = A.scored(match_results(spark, d)).groupBy("method").agg(F.round(F.count_if(A.within(25)) * 100.0 / F.count(F.lit(1)), 1).alias("a25"), F.count(F.lit(1)).alias("n"))
    text = F.format_string("%.1f", "a25")
    cell = F.when(F.col("a25") == F.max("a25").over(Window.partitionBy(F.lit(0))), F.concat(F.lit("\\textbf{"), text, F.lit("}"))).otherwise(text)
    return g.select(F.concat(F.concat_ws(" & ", "method", F.col("n").cast("string"), cell), F.lit(" \\\\")).alias("line"))


@query(sql("SELECT flight, arg_max(method, (a, method)) AS best_method, round(max(a), 6) AS a25 FROM (SELECT flight, method, count(*) FILTER (WHERE coalesce(offset_m <= 25, false))*100.0::DOUBLE/count(*) AS a FROM scored GROUP BY ALL) GROUP BY flight", "scored"))
def best_method(spark, d):
    g = A.scored(match_results(spark, d)).groupBy("flight", "method").agg(A.share(A.within(25)).alias("a25"))
    return g.groupBy("flight").agg(F.max_by("method", F.struct("a25", "method")).alias("best_method"), F.max("a25").alias("a25"))


@query(sql("SELECT method, round(median(CASE WHEN offset_m IS NULL THEN 'inf'::DOUBLE ELSE offset_m END), 6) AS med_m, round(count(*) FILTER (WHERE offset_m IS NULL)*1.0::DOUBLE/count(*), 6) AS fail_share, round(avg(inliers), 6) AS mean_inliers, round(count(*) FILTER (WHERE coalesce(raw_err_m <= 20, false))*100.0::DOUBLE/count(*), 6) AS u20 FROM scored GROUP BY method", "scored"))
def inf_median(spark, d):
    """Medians with failures as infinite errors."""
    x = A.scored(match_results(spark, d))
    return x.groupBy("method").agg(
        F.round(F.median(F.coalesce("offset_m", F.lit(float("inf")))), 6).alias("med_m"), F.round(F.count_if(F.col("offset_m").isNull()) / F.count(F.lit(1)), 6).alias("fail_share"),
        F.round(F.avg("inliers"), 6).alias("mean_inliers"), A.share(A.within(20, "raw_err_m")).alias("u20"),
    )


def _fixed(c: str, n: int) -> str:
    """Half-up rounding by doubles alone, which both engines do alike."""
    return f"floor({c}*1e{n}::DOUBLE + 0.5::DOUBLE)/1e{n}::DOUBLE"


@query(sql(f"SELECT method, flight, filename, CASE WHEN good > 0 THEN {_fixed('(inliers/good::DOUBLE)', 4)} ELSE 0.0::DOUBLE END AS inlier_ratio, {_fixed('raw_err_m', 2)} AS raw_err_m, {_fixed('offset_m', 2)} AS offset_m, {_fixed('pred_lat', 7)} AS pred_lat, {_fixed('pred_lon', 7)} AS pred_lon, {_fixed('h_scale', 5)} AS h_scale, coalesce(offset_m <= 5, false) AS success_5, coalesce(offset_m <= 25, false) AS success_25 FROM scored", "scored"))
def row_contract(spark, d):
    """Stored rounding of a result row; no correspondences give ratio 0."""

    def fixed(c, n):
        return F.floor(c * float(f"1e{n}") + 0.5) / float(f"1e{n}")

    ratio = F.when(F.col("good") > 0, fixed(F.col("inliers") / F.col("good"), 4)).otherwise(F.lit(0.0))
    return A.scored(match_results(spark, d)).select(
        "method", "flight", "filename", ratio.alias("inlier_ratio"), *[fixed(F.col(c), n).alias(c) for c, n in (("raw_err_m", 2), ("offset_m", 2), ("pred_lat", 7), ("pred_lon", 7), ("h_scale", 5))],
        A.within(5).alias("success_5"), A.within(25).alias("success_25"),
    )


@query(sql("SELECT method, flight, filename, seq FROM scored WHERE inliers > 0 AND raw_err_m > 0 AND isfinite(raw_err_m) AND seq BETWEEN 10 AND 5000 AND (seq - 10) % 3 = 0", "scored"))
def outlier_slice(spark, d):
    x = F.col("raw_err_m")
    finite = (x > 0) & (x < float("inf")) & ~F.isnan(x)
    return A.scored(match_results(spark, d)).filter((F.col("inliers") > 0) & finite & F.col("seq").between(10, 5000) & (F.pmod(F.col("seq") - 10, F.lit(3)) == 0)).select("method", "flight", "filename", "seq")


@query(sql("SELECT method, flight, filename, skipped, b.band IS NOT NULL AS in_train FROM match_results LEFT JOIN (SELECT flight AS fl, filename AS fn, band FROM banded WHERE band = 'train') b ON flight = fl AND filename = fn", "match_results", "banded"))
def train_flag(spark, d):
    b = with_band(frames(spark, d)).filter("band = 'train'").select("flight", "filename", F.lit(True).alias("t"))
    return match_results(spark, d).join(b, ["flight", "filename"], "left").select("method", "flight", "filename", "skipped", F.coalesce("t", F.lit(False)).alias("in_train"))
