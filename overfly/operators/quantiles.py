"""Exact quantiles of groups of any size.

A group's quantile needs the values at one or two ranks. A first pass counts values by bins of
the logarithm of their size, ``FINE`` to each factor of e, which need not know the data: of
each group only the bins that hold a rank go on, with their least and greatest value. While
more than ``LIMIT`` values lie in such an interval, a pass counts its values by ``CUTS`` equal
parts and goes on with the part that holds the rank. Logarithm, difference and quotient never
fall where values rise, so bins keep the values' order, however they are rounded. Values of
one bin have one sign and one size, so after a few passes (four at most, by the digits of a
double) a part holds one value, however many copies there are. Passes add up counts only;
then an interval's values are gathered, ``LIMIT`` at most, so no task ever holds a large
group, and what is gathered of a small one is a bin of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import checkpointed

#: Values of one interval that a task may gather, equal parts of a pass, and bins to a factor of e in the first.
LIMIT, CUTS, FINE = 1 << 17, 4096, 64
#: Intervals that are broadcast to where the values lie; more are joined as Spark sees fit.
FEW = 1 << 16


def _same(a: DataFrame, b: DataFrame, keys: list[str], more: Column) -> DataFrame:
    """Rows of ``a`` with those of ``b`` that have the same keys (nulls equal), b's keys left out."""
    b = b.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys], more)
    return a.join(b, on).drop(*[f"_o_{k}" for k in keys])


def _size_bin(v: Column) -> Column:
    """A bin that does not fall where ``v`` rises: by sign and logarithm; zero and the infinite have their own."""
    size = F.abs(v)
    bin_ = F.when(size == float("inf"), 1 << 20).otherwise(F.floor((F.log(size) + 750) * FINE).cast("int"))
    return F.when(v == 0, 0).when(v > 0, bin_).otherwise(-bin_)


def exact(d: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], limit: int = LIMIT, cuts: int = CUTS) -> DataFrame:
    """``keys`` and a column for each wanted (value, q): the q-quantile of the group's finite values, linear between ranks.

    Null and NaN values do not count; a group without values gives null, or no row where it
    has none in any column. Infinite values take part as the least and the greatest.
    """
    names = list(wanted)
    # Quantiles of one value share its passes.
    first = {str(wanted[n][0]): n for n in reversed(names)}
    values = sorted(set(first.values()))
    column = {n: values.index(first[str(wanted[n][0])]) for n in names}
    x = d.select(*keys, F.posexplode(F.array(*[wanted[n][0].cast("double") for n in values])).alias("_c", "_v"))
    x = x.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    by = [*keys, "_c"]
    at = lambda n: (F.col("_n") - 1) * F.lit(float(wanted[n][1]))
    ranks = [F.when(F.col("_c") == column[n], F.array(F.floor(at(n)), F.ceil(at(n)))).otherwise(F.array().cast("array<bigint>")) for n in names]
    counted = [F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_l"), F.max("_v").alias("_h")]

    def holding(h: DataFrame, within: list[str]) -> DataFrame:
        """The bins that hold a rank, as new intervals; a window over the bins of one interval."""
        w = Window.partitionBy(*within).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("_b", F.col("_below") + F.coalesce(F.sum("_k").over(w), F.lit(0)))
        h = h.withColumn("_ks", F.filter("_ks", lambda k: (k >= F.col("_b")) & (k < F.col("_b") + F.col("_k")))).filter(F.size("_ks") > 0)
        return h.select(*by, "_n", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_b").alias("_below"), F.col("_k").alias("_m"), "_ks")

    h = x.groupBy(*by, _size_bin(F.col("_v")).alias("_bin")).agg(*counted)
    h = h.withColumn("_n", F.sum("_k").over(Window.partitionBy(*by))).withColumns({"_below": F.lit(0).cast("long"), "_ks": F.array_distinct(F.concat(*ranks))})
    state = checkpointed(holding(h, by))
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    wide = (F.col("_m") > limit) & (F.col("_lo") < F.col("_hi"))
    small = lambda s: F.broadcast(s) if s.count() <= FEW else s
    while (more := state.filter(wide)).take(1):
        # The least value is in the first part and the greatest past the last, so parts are always narrower.
        bin_ = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cuts)
        h = _same(x, small(more), by, inside).groupBy(*by, "_lo", "_hi", bin_.alias("_bin")).agg(*counted, *[F.first(c).alias(c) for c in ("_n", "_below", "_ks")])
        state = checkpointed(state.filter(~wide).unionByName(holding(h, [*by, "_lo", "_hi"])))
    one = F.col("_lo") == F.col("_hi")
    gathered = _same(x, small(state.filter(~one)), by, inside).groupBy(*by, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_vs"), *[F.first(c).alias(c) for c in ("_n", "_below", "_ks")])
    picked = gathered.select(*by, "_n", F.explode("_ks").alias("_k"), "_vs", "_below").select(*by, "_n", "_k", F.element_at("_vs", (F.col("_k") - F.col("_below") + 1).cast("int")).alias("_x"))
    picked = picked.unionByName(state.filter(one).select(*by, "_n", F.explode("_ks").alias("_k"), F.col("_lo").alias("_x")))

    def quantile(n: str) -> Column:
        own = F.col("_c") == column[n]
        low, high = (F.max(F.when(own & (F.col("_k") == r), F.col("_x"))) for r in (F.floor(at(n)), F.ceil(at(n))))
        part = F.max(F.when(own, at(n) - F.floor(at(n))))
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(n)

    return picked.groupBy(*keys).agg(*[quantile(n) for n in names])


def with_quantiles(grouped: DataFrame, d: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], digits: int = 6, **kw: int) -> DataFrame:
    """An aggregate by ``keys`` (no null ones) with the wanted quantiles of ``d`` added, rounded."""
    q = exact(d, keys, wanted, **kw)
    q = q.select(*[F.col(k).alias(f"_q_{k}") for k in keys], *[F.round(n, digits).alias(n) for n in wanted])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys])
    return grouped.join(q, on, "left").drop(*[f"_q_{k}" for k in keys])
