"""Accuracy at X metres, error statistics and their populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .quantiles import with_quantiles


def scored(d: DataFrame) -> DataFrame:
    """Without skipped rows; an unknown flag counts as not skipped."""
    return d.filter(~F.coalesce(F.col("skipped"), F.lit(False)))


def solvable(d: DataFrame) -> DataFrame:
    return scored(d).filter(F.coalesce(F.col("gt_in_patch"), F.lit(False)))


def gate(least: int = K.MIN_INLIERS) -> Column:
    return F.coalesce(F.col("inliers"), F.lit(0)) >= least


def within(t: float, c: str = "offset_m", accepted: Column | None = None) -> Column:
    """Error of at most t metres; unknown errors and, if given, unaccepted rows are failures."""
    ok = F.coalesce(F.col(c) <= float(t), F.lit(False))
    return ok if accepted is None else ok & accepted


def share(c: Column) -> Column:
    """Percentage of the group's rows (aggregate)."""
    return F.round(F.count_if(c) * 100.0 / F.count(F.lit(1)), 6)


def with_total(d: DataFrame, total: str) -> DataFrame:
    """Each row once under its own ``total`` and once under 'ALL'; a row without one counts under 'ALL' as its own."""
    return d.withColumn("_t", F.explode(F.array(F.coalesce(total, F.lit("ALL")), F.lit("ALL")))).withColumn(total, F.col("_t")).drop("_t")


def accuracy(d: DataFrame, keys: list[str], total: str = "flight", thresholds: tuple[int, ...] = K.THRESHOLDS) -> DataFrame:
    """Gated counts and percentages at each threshold by ``keys``, with a total row ('ALL') over the last key.

    The median error is exact and gathers no large group (``quantiles``).
    """
    rest = [k for k in keys if k != total]
    aggs = [F.count(F.lit(1)).alias("n")] + [share(within(t, accepted=gate())).alias(f"a{t}") for t in thresholds]
    g = d.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in rest]], *[F.col(k) for k in keys]).agg(*aggs).withColumn(total, F.coalesce(total, F.lit("ALL")))
    return with_quantiles(g, with_total(d.select(*keys, "offset_m"), total), keys, {"med_m": (F.col("offset_m"), 0.5)})


def errors(c: str = "offset_m") -> list[Column]:
    """Mean, root mean square and maximum of known errors; their median and 90th percentile are ``error_quantiles``."""
    v = F.col(c)
    return [F.round(x, 6).alias(n) for n, x in (("mean_m", F.avg(v)), ("rmse_m", F.sqrt(F.avg(v * v))), ("max_m", F.max(v)))]


def error_quantiles(c: str = "offset_m") -> dict[str, tuple[Column, float]]:
    return {"median_m": (F.col(c), 0.5), "p90_m": (F.col(c), 0.9)}


def curve(d: DataFrame, keys: list[str], grid: list[float], c: Column) -> DataFrame:
    """Share of rows with an error of at most x, for each x of the grid (one pass, no join)."""
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.count_if(F.coalesce(c <= float(x), F.lit(False))).alias("k")) for x in grid])
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), points.alias("p")).select(*keys, "n", F.explode("p").alias("p"))
    return out.select(*keys, F.col("p.x").alias("x"), F.round(F.col("p.k") * 100.0 / F.col("n"), 6).alias("acc"))
