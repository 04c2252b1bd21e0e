"""Recall at k under three stated policies for missing ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(rank: Column, k: int, policy: str = "exclude") -> Column:
    """Percentage with 0-based rank < k (aggregate).

    ``exclude``: unknown ranks and -1 (out of the radius) leave numerator and
    denominator. ``miss``: both count as misses. ``legacy``: unknown is a miss, but -1
    is taken literally and hits.
    """
    known = rank.isNotNull() & (rank >= 0)
    if policy == "exclude":
        return F.round(F.try_divide(F.count_if(known & (rank < k)) * 100.0, F.count_if(known).cast("double")), 6)
    hit = (rank < k) if policy == "legacy" else known & (rank < k)
    if policy not in ("miss", "legacy"):
        raise ValueError(policy)
    return F.round(F.count_if(F.coalesce(hit, F.lit(False))) * 100.0 / F.count(F.lit(1)), 6)


def unpivot_modes(d: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, mode, rank): ``gt_tile_rank`` as mode denied and each ``gt_rank_r<R>`` as r<R>."""
    modes = {"gt_tile_rank": "denied"} | {c: c.removeprefix("gt_rank_") for c in sorted(d.columns) if c.startswith("gt_rank_r")}
    stacked = ", ".join(f"'{m}', `{c}`" for c, m in modes.items())
    return d.select(*ids, F.expr(f"stack({len(modes)}, {stacked}) AS (mode, rank)"))


def summary(d: DataFrame, keys: list[str], policy: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Rows, rows with a valid rank, and recall at each k, by keys."""
    r = F.col("rank")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(r.isNotNull() & (r >= 0)).alias("n_valid"), *[recall(r, k, policy).alias(f"r{k}") for k in ks])
