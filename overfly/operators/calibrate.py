"""Bias and scale calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import geo
from .accuracy import gate
from .store import with_neighbours


def track_direction(d: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Add te, tn: the unit direction of motion (east, north) to the next position.

    The last row repeats the one before; a single row points north; steps under a
    micrometre stay unscaled. Each step is scaled at the latitude it starts from.
    Tracks lie in ranges of rows that exchange their ends, so none is gathered in a task.
    """
    d = with_neighbours(d, keys, [order], ["lat", "lon"], "_b", "_a")
    step = lambda c: F.coalesce(F.col(f"_a.{c}") - F.col(c), F.col(c) - F.col(f"_b.{c}"))
    start = F.when(F.col("_a.lat").isNotNull(), F.col("lat")).otherwise(F.col("_b.lat"))
    d = d.withColumns({"_e": step("lon") * geo.metres_per_lon(start), "_n": step("lat") * K.LATITUDE_M})
    size = F.hypot("_e", "_n")
    size = F.when(size < 1e-6, 1.0).otherwise(size)
    return d.withColumns({"te": F.coalesce(F.col("_e") / size, F.lit(0.0)), "tn": F.coalesce(F.col("_n") / size, F.lit(1.0))}).drop("_e", "_n", "_a", "_b")


def central_bearing(d: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Add ``bearing``: degrees from north of the way from the position before to the one after (the own one at either end)."""
    d = with_neighbours(d, keys, [order], ["lat", "lon"], "_b", "_a")
    step = lambda c: F.coalesce(F.col(f"_a.{c}"), F.col(c)) - F.coalesce(F.col(f"_b.{c}"), F.col(c))
    b = F.degrees(F.atan2(step("lon") * geo.metres_per_lon(F.col("lat")), step("lat") * K.LATITUDE_M))
    return d.withColumn("bearing", b).drop("_a", "_b")


def with_errors(d: DataFrame, keys: list[str]) -> DataFrame:
    """Add e, n (prediction error in metres) and along, cross (in the direction of motion)."""
    e, n = geo.east_north(F.col("lat"), F.col("lon"), F.col("pred_lat"), F.col("pred_lon"))
    d = track_direction(d, keys).withColumns({"e": e, "n": n})
    al, cr = geo.along_cross(F.col("e"), F.col("n"), F.col("te"), F.col("tn"))
    return d.withColumns({"along": al, "cross": cr})


def bias(d: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Median errors by ``keys`` over accepted rows with ``in_train``; no correction under ``least`` of them."""
    fit = F.col("in_train") & gate() & F.col("pred_lat").isNotNull()
    med = lambda c: F.when(F.count_if(fit) >= least, F.median(F.when(fit, F.col(c)))).otherwise(0.0)
    return d.groupBy(*keys).agg(med("e").alias("be"), med("n").alias("bn"), med("along").alias("ba"), med("cross").alias("bc"), F.count_if(fit).alias("fit_rows"))


def corrected(d: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Predictions less the bias ('en': east/north, 'track': along/cross), and offset_m again; rows without one stay."""
    x = with_errors(d, keys)
    x = x.join(bias(x, keys), keys)
    if frame == "en":
        ce, cn = F.col("be"), F.col("bn")
    else:
        ce, cn = F.col("ba") * F.col("te") - F.col("bc") * F.col("tn"), F.col("ba") * F.col("tn") + F.col("bc") * F.col("te")
    plon, plat = F.col("pred_lon") - ce / geo.metres_per_lon(F.col("lat")), F.col("pred_lat") - cn / K.LATITUDE_M
    off = F.coalesce(geo.haversine_m(F.col("lat"), F.col("lon"), plat, plon), F.col("offset_m"))
    return x.select(*keys, "filename", "seq", "inliers", plat.alias("pred_lat"), plon.alias("pred_lon"), off.alias("offset_m"))


def best_cell(cells: DataFrame, key: str = "flight", valid: float = 0.2, room: float = 1.0) -> DataFrame:
    """The sweep value of each flight: valid share reached, median within ``room`` of the best, most mean inliers (the smaller value on a tie)."""
    ok = cells.filter(F.col("valid_frac") >= valid)
    ok = ok.withColumn("_best", F.min("median_off_m").over(Window.partitionBy(key))).filter(F.col("median_off_m") <= F.col("_best") + room)
    return ok.groupBy(key).agg(F.max_by("k", F.struct("mean_inliers", -F.col("k"))).alias("k"), F.max("mean_inliers").alias("mean_inliers"))
