"""Exact nearest neighbours of binary codes in Hamming distance by a multi-index hash.

A code is an array of 64-bit words. Each word is cut into equal parts; two codes that differ
in at most ``parts * (s + 1) - 1`` bits differ in at most ``s`` bits of some part. So a query
looks up, part by part, all values within ``s`` bits of its own (an equi-join on part and
value), s growing from 0, until its k-th neighbour is no farther than what has been covered.
A pair is looked at once: at the least distance of its parts, in the first part that has it.

Equal codes are one entry, which keeps as many of their ids as can be among a query's k
nearest, so that copies cost nothing, however many. When the open queries' look-ups at a
radius, or the codes that these would meet, come to more than ``SHARE`` times the index, the
queries still open are compared with all codes in blocks: what is shuffled stays in
proportion to the input, however the codes are spread.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .knn import against
from .store import checkpointed

#: Look-ups of one part and radius at most; beyond, open queries are compared in blocks.
MOST_PROBES = 1 << 14
#: Look-ups of all open queries, and codes met by them, at one radius: so many times the entries of the index.
SHARE = 4


def packed(bits: Column) -> Column:
    """An array of booleans as 64-bit words, the first element in the lowest bit; a null element counts as not set."""
    at = lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 64).cast("int"))
    word = lambda w: F.aggregate(F.slice(F.transform(bits, at), w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.transform(words, word)


def distance(a: Column, b: Column) -> Column:
    """Bits that differ between two codes of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


class Parts:
    """How codes of ``words`` 64-bit words are cut, for about ``n`` distinct codes: parts that n codes fill about once."""

    def __init__(self, words: int, n: int) -> None:
        wide = min(32, max(4, round(math.log2(max(n, 2)))))
        self.per_word = max(1, round(64 / wide))
        self.edges = [round(i * 64 / self.per_word) for i in range(self.per_word + 1)]
        self.words, self.count = words, words * self.per_word

    def width(self, j: int) -> int:
        i = j % self.per_word
        return self.edges[i + 1] - self.edges[i]

    def value(self, code: Column, j: int) -> Column:
        low = F.shiftrightunsigned(code[j // self.per_word], self.edges[j % self.per_word])
        return low if self.width(j) == 64 else low.bitwiseAND((1 << self.width(j)) - 1)

    def probes(self, s: int) -> int:
        """Look-ups of a query at radius s."""
        return sum(math.comb(self.width(j), s) for j in range(self.count))

    def around(self, code: Column, j: int, s: int) -> Column:
        """(part, value) of all values that differ from the code's part j in exactly s bits."""
        masks = [sum(1 << b for b in c) for c in combinations(range(self.width(j)), s)]
        own = self.value(code, j)
        return F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), lambda m: F.struct(F.lit(j).alias("part"), own.bitwiseXOR(m).alias("value")))

    def first_at(self, a: Column, b: Column, s: int) -> Column:
        """The first part in which two codes differ in exactly s bits, if none differs in fewer; else null."""
        apart = [F.bit_count(self.value(a, j).bitwiseXOR(self.value(b, j))) for j in range(self.count)]
        first = F.coalesce(*[F.when(x == s, F.lit(j)) for j, x in enumerate(apart)])
        return F.when(F.least(*apart) == s if len(apart) > 1 else apart[0] == s, first)


def _entries(gallery: DataFrame, keep: int) -> DataFrame:
    """Distinct codes with their ``keep`` least ids; within a code only so many ids leave a task."""
    w = Window.partitionBy("group", "code").orderBy("id")
    least = gallery.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    return least.groupBy("group", "code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _best(d: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "group").orderBy("dist", "id")
    return d.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def nearest(gallery: DataFrame, queries: DataFrame, k: int = 2, within: str | None = None, exclude_self: bool = True, words: int = 1, block_bytes: int | None = None) -> DataFrame:
    """query_id, id, dist, rk (and ``within``): each query's k nearest codes, ties to the smaller id.

    gallery: id, code; queries: query_id, code (arrays of ``words`` longs); both with the
    column ``within`` if matches are to stay inside its groups (one image pair). Codes that
    are null, hold nulls or have another number of words take no part, nor do null ids.
    With ``exclude_self`` a query does not find its own id. Fewer codes than k give fewer
    rows; an empty side gives none.
    """
    group = (F.col(within) if within else F.lit(0)).alias("group")
    fits = (F.size("code") == words) & F.coalesce(F.forall("code", lambda x: x.isNotNull()), F.lit(False))
    rows = gallery.filter(fits & F.col("id").isNotNull()).select("id", F.col("code").cast("array<long>").alias("code"), group)
    asked = queries.filter(fits & F.col("query_id").isNotNull()).select("query_id", F.col("code").cast("array<long>").alias("code"), group)
    entries = checkpointed(_entries(rows, k + 1 if exclude_self else k))
    n = entries.count()
    parts = Parts(words, n)
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("part"), parts.value(F.col("code"), j).alias("value")) for j in range(parts.count)])).alias("c")
    index = entries.select("group", F.col("code").alias("_code"), "ids", cells).select("group", "_code", "ids", "c.*")
    open_ = checkpointed(asked.distinct())
    found = None
    s = 0
    most = SHARE * parts.count * max(n, 1)
    sizes = index.groupBy("group", "part", "value").agg(F.count(F.lit(1)).alias("n"))
    while s <= max(map(parts.width, range(parts.count))) and parts.probes(s) <= max(n, 1) and parts.probes(s) <= MOST_PROBES * parts.count:
        if open_.count() * parts.probes(s) > most:
            rest = True
            break
        near = [parts.around(F.col("code"), j, s) for j in range(parts.count) if s <= parts.width(j)]
        probes = open_.select("query_id", F.col("group").alias("_group"), "code", F.explode(F.concat(*near)).alias("p")).select("query_id", "_group", "code", F.col("p.part").alias("_part"), F.col("p.value").alias("_value"))
        same = (F.col("_part") == F.col("part")) & (F.col("_value") == F.col("value")) & F.col("_group").eqNullSafe(F.col("group"))
        asked_for = probes.groupBy("_group", "_part", "_value").agg(F.count(F.lit(1)).alias("_times"))
        if (asked_for.join(sizes, same).agg(F.sum(F.col("_times") * F.col("n"))).first()[0] or 0) > most:
            rest = True
            break
        hits = probes.join(index, same)
        hits = hits.filter(parts.first_at(F.col("code"), F.col("_code"), s) == F.col("part"))
        hits = hits.select("query_id", "group", distance(F.col("code"), F.col("_code")).alias("dist"), F.explode("ids").alias("id"))
        if exclude_self:
            hits = hits.filter(F.col("id") != F.col("query_id"))
        both = hits if found is None else found.drop("rk").unionByName(hits)
        found = checkpointed(_best(both, k))
        covered = parts.count * (s + 1) - 1
        done = found.filter((F.col("rk") == k) & (F.col("dist") <= covered)).select(F.col("query_id").alias("_q"), F.col("group").alias("_g"))
        open_ = checkpointed(open_.join(done, (F.col("query_id") == F.col("_q")) & F.col("group").eqNullSafe(F.col("_g")), "left_anti"))
        if not open_.take(1):
            rest = False
            break
        s += 1
    else:
        rest = True
    if rest:
        rest = _scanned(entries, open_, k, exclude_self, words, block_bytes)
        if found is None:
            found = rest
        else:
            asked_again = open_.select(F.col("query_id").alias("_q"), F.col("group").alias("_g"))
            found = found.join(asked_again, (F.col("query_id") == F.col("_q")) & F.col("group").eqNullSafe(F.col("_g")), "left_anti").unionByName(rest)
    out = found.select("query_id", "id", "dist", "rk", *([F.col("group").alias(within)] if within else []))
    return out


def _scanned(entries: DataFrame, asked: DataFrame, k: int, exclude_self: bool, words: int, block_bytes: int | None) -> DataFrame:
    """The same by comparing open queries, in blocks, with all codes."""

    def task(asked, tiles):
        import numpy as np

        qid, qc, qg = asked["query_id"], asked["qcode"].view(np.uint64), asked["qgroup"]
        far = 1 << 40
        ids, dist = np.zeros((len(qid), k), np.int64), np.full((len(qid), k), far)
        for q, b in tiles:
            own, code = b["id"], b["code"].view(np.uint64)
            d = np.zeros((len(qid[q]), len(own)), np.int32)
            for w in range(words):
                d += np.bitwise_count(qc[q, w][:, None] ^ code[:, w][None, :])
            # Only what is as near as a query's k-th so far is looked at, which is little after the first tiles.
            row, col = np.nonzero(d <= dist[q][:, -1:])
            ok = qg[q][row] == b["group_key"][col]
            if exclude_self:
                ok &= qid[q][row] != own[col]
            row, col = row[ok], col[ok]
            # What was found so far takes part.
            had = np.nonzero(dist[q] < far)
            every = np.concatenate([had[0], row])
            dd, tt = np.concatenate([dist[q][had], d[row, col]]), np.concatenate([ids[q][had], own[col]])
            order = np.lexsort((tt, dd, every))
            every, dd, tt = every[order], dd[order], tt[order]
            place = np.arange(len(every)) - np.searchsorted(every, every)
            top = place < k
            dist[q.start + every[top], place[top]], ids[q.start + every[top], place[top]] = dd[top], tt[top]
        ok = dist < far
        row = np.nonzero(ok)[0]
        return qid[row], qg[row], ids[ok], dist[ok]

    key = F.xxhash64(F.col("group").isNull(), "group")
    rows = entries.select(F.explode("ids").alias("id"), "code", key.alias("group_key"))
    ask = asked.select("query_id", F.col("code").alias("qcode"), key.alias("qgroup"))
    w = Window.partitionBy("query_id", "qgroup").orderBy("dist", "id")
    best = lambda d: d.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    got = against(rows, ask, task, "query_id long, qgroup long, id long, dist long", best, block_bytes)
    back = asked.select(F.col("query_id").alias("_q"), "group", key.alias("_key"))
    return got.join(back, (F.col("query_id") == F.col("_q")) & (F.col("qgroup") == F.col("_key"))).select("query_id", "group", F.col("dist").cast("int").alias("dist"), "id", "rk")


def ratio(found: DataFrame, share: float, within: str | None = None) -> DataFrame:
    """query_id (and ``within``), id, d1, d2 and good: d1 below ``share`` of d2, for queries that found two."""
    keys = ["query_id", *([within] if within else [])]
    at = lambda i, c: F.max(F.when(F.col("rk") == i, F.col(c)))
    d = found.groupBy(*keys).agg(at(1, "id").alias("id"), at(1, "dist").alias("d1"), at(2, "dist").alias("d2")).filter("d2 IS NOT NULL")
    return d.withColumn("good", F.col("d1") < F.col("d2") * share)
