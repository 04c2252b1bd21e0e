"""Caption cleaning, checks and caption joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import text as T
from ..registry import query
from .views import captions, frames, sql, table

COLORS = "|".join((*K.COLOR_WORDS, "shadows?"))
#: Letters beyond ASCII that these texts have; DuckDB's word boundaries know ASCII only, so they stand between marks of ASCII letters meanwhile.
WIDE, MARKED = "([À-ÖØ-öø-ÿ])", "zq9([À-ÖØ-öø-ÿ])9qz"


def _clean_sql() -> str:
    c = "trim(regexp_replace(caption, '(?s)<think>.*?</think>', '', 'g'))"
    c = f"regexp_replace({c}, '{WIDE}', 'zq9\\1' || '9qz', 'g')"
    c = f"regexp_replace({c}, '(?i){K.COLOR_PATTERN.format(words=COLORS)}', ' ', 'g')"
    c = f"regexp_replace({c}, '{MARKED}', '\\1', 'g')"
    for pattern, to in K.TIDY_RULES:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace(trim({c}), '{K.OUTER_COMMAS}', '', 'g'))"


EDGE = "[^0-9A-Za-zÀ-ÿ_]"


@query(sql(f"SELECT id, CAST(length(c) AS BIGINT) AS n, md5(c) AS digest FROM (SELECT id, {_clean_sql()} AS c FROM captions)", "captions"))
def caption_clean(spark, d):
    """Cleaned captions of every language and of none, by length and digest."""
    c = T.clean(F.col("caption"))
    return captions(spark, d).select("id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


QA = "count(*) AS n, count(*) FILTER (WHERE regexp_matches(caption, '(?i)(^|{e})({l}){s}($|{e})')) AS leaks, count(*) FILTER (WHERE regexp_matches(caption, '(?i)(^|{e})({b})($|{e})')) AS banned, count(*) - count(DISTINCT caption) AS dupes, count(*) FILTER (WHERE trim(caption) = '') AS empty, CAST(min(w) AS BIGINT) AS len_min, round(avg(w), 6) AS len_mean, CAST(max(w) AS BIGINT) AS len_max, count(*) FILTER (WHERE w < 8 OR w > 20) AS outliers".format(e=EDGE, s=K.COLOR_SUFFIX, l=COLORS, b="|".join(K.BANNED_WORDS))


@query(sql(f"SELECT coalesce(flight, 'ALL') AS flight, {QA} FROM (SELECT *, len(regexp_extract_all(caption, '\\S+')) AS w FROM captions) GROUP BY GROUPING SETS ((flight), ())", "captions"))
def caption_qa(spark, d):
    c, w = F.col("caption"), F.col("w")
    lo, hi = K.CAPTION_WORDS
    # Texts are looked at once, before the rows are doubled for the totals; copies are told by digests.
    x = captions(spark, d).select(
        "flight", T.word_count(c).alias("w"), T.has_word(c, (*K.COLOR_WORDS, "shadows?"), K.COLOR_SUFFIX).alias("leak"), T.has_word(c, K.BANNED_WORDS).alias("ban"),
        F.md5(c).alias("digest"), (F.trim(c) == "").alias("none"),
    )
    return x.rollup("flight").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("leak").alias("leaks"), F.count_if("ban").alias("banned"), (F.count(F.lit(1)) - F.count_distinct("digest")).alias("dupes"),
        F.count_if("none").alias("empty"), F.min(w).cast("long").alias("len_min"), F.round(F.avg(w), 6).alias("len_mean"), F.max(w).cast("long").alias("len_max"),
        F.count_if((w < lo) | (w > hi)).alias("outliers"),
    ).withColumn("flight", F.coalesce("flight", F.lit("ALL")))


@query(r"WITH e AS (SELECT user_id, event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT user_id, arg_max(k, event_id) AS k, max(event_id) AS line_no FROM e WHERE k IS NOT NULL GROUP BY user_id")
def caption_scan_last_wins(spark, d):
    """JSON lines by key: unreadable ones are dropped and the last of a key wins."""
    e = table(spark, d, "events").select("user_id", "event_id", F.from_json("props", "k long").alias("p")).filter("p.k IS NOT NULL")
    return e.groupBy("user_id").agg(F.max_by("p.k", "event_id").alias("k"), F.max("event_id").alias("line_no"))


@query(sql("SELECT f.flight, f.filename, f.seq, s.id AS sat_id, coalesce(dr.caption_len, 0) AS drone_len FROM frames f JOIN (SELECT id FROM captions WHERE id % 3 <> 0) s ON s.id = f.seq LEFT JOIN (SELECT id, CAST(length(caption) AS BIGINT) AS caption_len FROM captions WHERE id % 2 = 0) dr ON dr.id = f.seq", "frames", "captions"))
def triples(spark, d):
    """Training triples: the map caption is required, the query caption optional."""
    c = captions(spark, d)
    sat = c.filter("id % 3 <> 0").select(F.col("id").alias("sat_id"))
    drone = c.filter("id % 2 = 0").select(F.col("id").alias("did"), F.length("caption").cast("long").alias("n"))
    x = frames(spark, d).join(sat, F.col("seq") == F.col("sat_id")).join(drone, F.col("seq") == F.col("did"), "left")
    return x.select("flight", "filename", "seq", "sat_id", F.coalesce("n", F.lit(0)).alias("drone_len"))


@query(sql("SELECT flight, filename FROM frames WHERE seq IN (SELECT id FROM captions WHERE id % 3 <> 0) AND seq IN (SELECT id FROM captions WHERE id % 2 = 0)", "frames", "captions"))
def both_captions(spark, d):
    c = captions(spark, d).select(F.col("id").alias("seq"))
    return frames(spark, d).join(c.filter("seq % 3 <> 0"), "seq", "left_semi").join(c.filter("seq % 2 = 0"), "seq", "left_semi").select("flight", "filename")


@query("SELECT DISTINCT CASE WHEN regexp_extract(base, 'visloc_(.+?)_results\\.csv$', 1) <> '' THEN regexp_extract(base, 'visloc_(.+?)_results\\.csv$', 1) ELSE regexp_replace(base, '\\.csv$', '') END AS method, lpad(CAST(k AS VARCHAR), 2, '0') AS flight, replace(replace('clip-vit.l' || CAST(k AS VARCHAR), '-', '_'), '.', '_') AS tag FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'visloc_m' || CAST(p_partkey % 11 AS VARCHAR) || '_results.csv' ELSE 'other' || CAST(p_partkey % 5 AS VARCHAR) || '.csv' END AS base, p_partkey % 11 AS k FROM part)")
def name_extract(spark, d):
    k = (F.col("p_partkey") % 11).cast("string")
    base = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("out/visloc_m"), k, F.lit("_results.csv"))).otherwise(F.concat(F.lit("out/other"), (F.col("p_partkey") % 5).cast("string"), F.lit(".csv")))
    return table(spark, d, "part").select(T.method_name(base).alias("method"), F.lpad(k, 2, "0").alias("flight"), T.backbone_tag(F.concat(F.lit("hub/clip-vit.l"), k)).alias("tag")).distinct()


@query("SELECT alpha, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 21)/20.0::DOUBLE END AS alpha FROM supplier) WHERE alpha IS NOT NULL GROUP BY alpha")
def alpha_from_path(spark, d):
    a = F.format_string("%.2f", F.col("s_suppkey") % 21 / F.lit(20.0))
    path = F.when(F.col("s_suppkey") % 4 == 0, F.lit("run/fusion_results.csv")).otherwise(F.concat(F.lit("run/fusion_a"), a, F.lit("_results.csv")))
    return table(spark, d, "supplier").select(T.alpha_in(path).alias("alpha")).filter("alpha IS NOT NULL").groupBy("alpha").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT flight, filename, CAST(row_number() OVER (PARTITION BY flight ORDER BY seq) AS BIGINT) AS ordinal, max(seq) OVER (PARTITION BY flight) AS last_seq FROM frames", "frames"))
def typed_frames(spark, d):
    w = Window.partitionBy("flight")
    return frames(spark, d).select("flight", "filename", F.row_number().over(w.orderBy("seq")).cast("long").alias("ordinal"), F.max("seq").over(w).alias("last_seq"))
