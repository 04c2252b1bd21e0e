"""Typed scans of the domain's files, resumable sinks and registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..operators.store import checkpointed

FRAMES = "filename string, lat double, lon double, height double, Phi1 double, date string"
MAPS = "mapname string, LT_lat_map double, LT_lon_map double, RB_lat_map double, RB_lon_map double, region string, w int, h int"
CAPTIONS = "flight string, filename string, tile_id int, caption string"


def flight_paths(flight: str, root: str) -> dict[str, str]:
    """Paths of a flight's map, images, frames and of the corners of all maps."""
    return {k: f"{root.rstrip('/')}/{v.format(flight=flight)}" for k, v in K.FLIGHT_FILES.items()}


def in_file_order(d: DataFrame) -> DataFrame:
    """Add ``file_path`` and ``_at``, which orders a file's rows as they stand in it, however the file is split and read.

    A row's split is known by where it begins in the file; inside a split rows are
    read in order, and a split is never dealt to two tasks.
    """
    return d.select("*", "_metadata.file_path", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_at"))


def frame_csv(spark: SparkSession, path: str) -> DataFrame:
    """One flight's (or many flights') frame files; the flight is the folder's name, ``seq`` counts a file's rows from 0.

    Rows of a split are counted, and splits are put in order by their place in the
    file, so no window runs over a whole file's rows.
    """
    d = in_file_order(spark.read.csv(path, header=True, schema=FRAMES, mode="PERMISSIVE")).select("*", "_at.block", "_at.row")
    per = d.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Rows of one split have neighbouring numbers, as nothing is filtered before they are given.
    d = d.join(per.select("file_path", "block", "_first", before.alias("_before")), ["file_path", "block"])
    d = d.withColumn("flight", F.lpad(F.element_at(F.split("file_path", "/"), -2), 2, "0")).withColumn("seq", F.col("row") - F.col("_first") + F.col("_before"))
    return d.drop("file_path", "_at", "block", "row", "_first", "_before").withColumn("Phi1", F.coalesce("Phi1", F.lit(0.0)))


def map_csv(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Map corners; naming a map that is absent is an error."""
    d = spark.read.csv(path, header=True, schema=MAPS)
    if name is not None:
        d = d.filter(F.col("mapname") == name)
        if not d.take(1):
            raise KeyError(f"no map {name!r} in {path}")
    return d


def number(c: Column) -> Column:
    """A number or null; NaN counts as missing."""
    v = c.try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def flag(c: Column) -> Column:
    """'True' in any case is true, everything else (missing too) false."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header): the first line of each text file that has one; a task sends one line a file."""
    d = in_file_order(spark.read.text(path))
    # Only a file's first block can hold its first line.
    d = d.filter(F.col("_at.block") == 0).groupBy("file_path").agg(F.min_by("value", "_at").alias("header"))
    return d.select(F.col("file_path").alias("file"), F.regexp_replace("header", "^\ufeff|\\r$", "").alias("header"))


def csv_by_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of CSV files whose headers differ: each file is read by its own, columns are strings and null where a file has none.

    Files of one header are one scan, scans are united by column name (exact, blanks around names
    cut off); columns come in the order in which headers, sorted, first name them. Empty
    files and files with a header alone give no rows; no file at all is an error, as with
    Spark's own reader. Only names of files come to the driver.
    """
    plain = lambda uri: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()
    groups = headers(spark, path).filter("trim(header) <> ''").groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    scans = []
    for g in groups:
        d = spark.read.csv([plain(f) for f in g["files"]], header=True)
        scans.append(d.toDF(*[c.strip() for c in d.columns]))
    return union_all(scans) if scans else spark.createDataFrame([], "skipped string")


def result_csv(spark: SparkSession, path: str | list[str], numbers: list[str]) -> DataFrame:
    """Result rows of any age, each file read by its own header: numbers coerced, columns that a file lacks null, ``skipped`` a flag (missing: false)."""
    d = csv_by_header(spark, path)
    for c in numbers:
        d = d.withColumn(c, number(F.col(c)) if c in d.columns else F.lit(None).cast("double"))
    return d.withColumn("skipped", flag(F.col("skipped"))) if "skipped" in d.columns else d.withColumn("skipped", F.lit(False))


def registry_csv(spark: SparkSession, files: dict[str, str], numbers: list[str]) -> tuple[DataFrame, list[str]]:
    """(rows of every registered method's result files with ``method``, methods whose files are absent): one scan per header, whatever the number of methods."""
    there = {m: f for m, f in files.items() if present(spark, f)}
    missing = sorted(set(files) - set(there))
    if not there:
        raise FileNotFoundError(f"no result file of {', '.join(missing)}")
    parts = [result_csv(spark, f, numbers).withColumn("method", F.lit(m)) for m, f in sorted(there.items())]
    return union_all(parts), missing


def caption_json(spark: SparkSession, path: str, keys: tuple[str, ...] = ("flight", "filename")) -> DataFrame:
    """Caption lines; malformed ones are dropped and the last of a key wins: the later file by name, the later line in a file."""
    d = in_file_order(spark.read.schema(CAPTIONS).option("mode", "DROPMALFORMED").json(path)).filter(F.col("caption").isNotNull())
    return d.groupBy(*keys).agg(F.max_by("caption", F.struct("file_path", "_at")).alias("caption"))


def present(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file exists in the store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def overwrite_csv(rows: DataFrame, path: str) -> None:
    """Result rows as CSV files with a header each, in place of what stood there; rows of a later run replace all earlier ones."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], kind: str = "parquet") -> int:
    """Append the rows whose key is not yet at ``path`` (a resumable sink of Parquet, JSON lines or CSV); returns how many were written.

    Keys are compared with nulls equal. A key that a batch has several times is written once: the
    row of least hash, the same in every run. The new rows are found once and
    checkpointed, so that the count and the files agree.
    """
    options = {"header": True} if kind == "csv" else {}
    if present(spark, path):
        done = spark.read.schema(rows.schema).options(**options).format(kind).load(path).select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
        rows = rows.join(done, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys]), "left_anti")
    rows = checkpointed(rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(F.xxhash64(*rows.columns))).alias("_row")).select("_row.*"))
    n = rows.count()
    if n:
        rows.write.mode("append").options(**options).format(kind).save(path)
    return n


def built_once(spark: SparkSession, path: str, parts: dict[str, str], build) -> DataFrame:
    """The rows of one partition of a table at ``path`` (a gallery by model, flight, tile and stride); built and written if it is absent.

    ``build`` is called without arguments only where the partition's folder has no finished write.
    """
    at = "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in parts.items()]])
    if not present(spark, f"{at}/_SUCCESS"):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at).withColumns({k: F.lit(v) for k, v in parts.items()})


def guarded(d: DataFrame, column: str, value: float, what: str) -> DataFrame:
    """The rows; one whose ``column`` is missing or differs from ``value`` stops the query when it is read."""
    c = F.col(column)
    stop = F.raise_error(F.concat(F.lit(f"stale {what}: "), F.coalesce(c.cast("string"), F.lit("none")))).cast("double")
    return d.withColumn(column, F.when(F.abs(c - value) <= 1e-6, c).otherwise(stop))


def with_images(frames: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Every frame with its image's columns and ``skipped``: true where the image is missing or could not be read (``ok`` not true)."""
    extra = [c for c in images.columns if c not in (*keys, "ok")]
    side = images.groupBy(*keys).agg(F.max(F.coalesce(F.col("ok"), F.lit(False))).alias("_ok"), *[F.max(F.when(F.col("ok"), F.col(c))).alias(c) for c in extra])
    return frames.join(side, keys, "left").withColumn("skipped", ~F.coalesce("_ok", F.lit(False))).drop("_ok")


def staged(tars: DataFrame) -> DataFrame:
    """(path, members) of archives to variant, job, path, member: which archive each variant's result file is taken from.

    Names that do not parse and archives without exactly one result file are left out; a
    variant that the file's own name extends takes that name; the newest job wins, and
    of equal jobs the first path.
    """
    name = F.element_at(F.split("path", "/"), -1)
    d = tars.withColumns({"job": F.regexp_extract(name, K.ARCHIVE_NAME, 1).try_cast("long"), "variant": F.regexp_extract(name, K.ARCHIVE_NAME, 2)}).filter("job IS NOT NULL")
    d = d.withColumn("_csv", F.filter("members", lambda m: m.rlike(K.RESULT_NAME))).filter("size(_csv) = 1").withColumn("member", F.col("_csv")[0])
    inner = F.regexp_extract("member", K.RESULT_NAME, 1)
    d = d.withColumn("variant", F.when(F.startswith(inner, F.col("variant")), inner).otherwise(F.col("variant")))
    best = F.min_by(F.struct("job", "path", "member"), F.struct(-F.col("job"), "path"))
    return d.groupBy("variant").agg(best.alias("b")).select("variant", "b.*")


def registered(registry: DataFrame, results: DataFrame, band: DataFrame) -> DataFrame:
    """Evaluation rows of every registered method, by its ``band``, with one row of nulls where a method has no result file.

    registry: method, label, band (``full`` or ``test``), a catalogue of a few rows; results: method, flight,
    filename, skipped, gt_in_patch and more; band: flight, filename, band. Rows skipped
    or with the truth outside the patch are left out; a method of band ``test`` keeps
    only that band's rows. ``missing`` marks methods without any result row.
    """
    have = results.select(F.col("method").alias("_have")).distinct()
    reg = registry.join(have, F.col("method") == F.col("_have"), "left").withColumn("missing", F.col("_have").isNull()).drop("_have")
    rows = results.filter(~F.coalesce("skipped", F.lit(False)) & F.coalesce("gt_in_patch", F.lit(False)))
    rows = rows.join(band.select("flight", "filename", F.col("band").alias("_band")), ["flight", "filename"], "left")
    rows = rows.join(F.broadcast(reg), "method").filter("band <> 'test' OR _band = 'test'").drop("_band")
    return rows.unionByName(reg.filter("missing"), allowMissingColumns=True)


def merged(stats: DataFrame, key: str) -> DataFrame:
    """One row over all keys' statistics: list columns joined in the order of ``key``, numbers summed."""
    lists = [c for c, t in stats.dtypes if t.startswith("array") and c != key]
    sums = [c for c, t in stats.dtypes if c not in (*lists, key)]
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, F.coalesce(c, F.array().cast(stats.schema[c].dataType)).alias("v")))), lambda x: x["v"]))
    return stats.agg(*[F.sum(c).alias(c) for c in sums], *[ordered(c).alias(c) for c in lists])


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of different ages together; columns that one lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def newest(catalogue: DataFrame) -> DataFrame:
    """(variant, job, path) rows to the newest job of each variant."""
    return catalogue.groupBy("variant").agg(F.max("job").alias("job"), F.max_by("path", "job").alias("path"))
