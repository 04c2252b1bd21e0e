"""Similarity search by blocks: exact cosine top-k, ranks of a true tile, histograms and mutual nearest neighbours.

Queries are a stated set. While they fit in one block of bounded bytes they are broadcast
and the gallery is read where it lies, unshuffled. Beyond that both sides are cut into blocks
and dealt out once, a task for each pair of blocks; nothing goes through the driver. Either
way a task makes matrix products of bounded tiles and hands out only what it keeps: k
candidates, counts or maxima, never pairs.

Vectors that are null, hold nulls or numbers that are not finite, or have another length
than most queries' take no part on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import checkpointed

#: Bytes of a block of either side; queries of one block are broadcast.
BLOCK_BYTES = 32 << 20
#: Gallery rows, and queries, of one matrix product.
STEP = TILE = 1024


def usable(c: str, width: int, kind: str) -> Column:
    """Vectors of ``width`` numbers, all there and finite."""
    whole = "int" in kind
    ok = F.forall(c, lambda x: x.isNotNull() if whole else x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(c) == width) & F.coalesce(ok, F.lit(False))


def against(gallery: DataFrame, queries: DataFrame, task: Callable, schema: str, fold: Callable[[DataFrame], DataFrame], block_bytes: int | None = None) -> DataFrame:
    """All of ``queries`` against all of ``gallery``.

    ``task(asked, tiles)`` gets queries' columns as arrays (vectors as matrices) and an
    iterator of (queries' slice, the same for at most ``STEP`` gallery rows), and returns
    the columns of ``schema``. ``fold`` reduces the rows of all tasks; where a query meets
    the gallery in several tasks, or several queries a tile, their rows are folded too.
    The first column of either side deals it out.
    """
    spark = gallery.sparkSession
    block = block_bytes or BLOCK_BYTES
    kinds = dict(queries.dtypes) | dict(gallery.dtypes)
    vectors = [c for c, t in queries.dtypes if t.startswith("array")]
    key = vectors[0]
    found = queries.groupBy(F.size(key).alias("w")).agg(F.count(F.lit(1)).alias("n")).filter("w >= 0")
    found = found.agg(F.max_by("w", F.struct("n", "w")), F.sum("n")).first()
    if not found[1]:
        return fold(spark.createDataFrame([], schema))
    width = found[0]
    fit = lambda d: d.filter(reduce(lambda a, b: a & b, [usable(c, width, kinds[c]) for c, t in d.dtypes if t.startswith("array")]))
    names = [f.split()[0] for f in schema.split(", ")]
    row = lambda d: 8 * sum(width if t.startswith("array") else 1 for _, t in d.dtypes)
    gallery, queries = fit(gallery), fit(queries)
    step, tile = STEP, TILE

    def columns(t):
        import numpy as np
        import pyarrow as pa

        def one(c):
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            if not pa.types.is_list(c.type):
                return np.asarray(c)
            whole = pa.types.is_integer(c.type.value_type)
            return np.asarray(c.flatten()).astype(np.int64 if whole else np.float64).reshape(len(c), -1)

        return {f: one(t.column(i)) for i, f in enumerate(t.schema.names)}

    def tiles(asked, batches):
        n = len(next(iter(asked.values())))
        for b in batches:
            rows = columns(b)
            for i in range(0, b.num_rows, step):
                part = {k: v[i : i + step] for k, v in rows.items()}
                for j in range(0, n, tile):
                    yield slice(j, min(j + tile, n)), part

    def result(asked, batches):
        import pyarrow as pa

        return [pa.array(c) for c in task(asked, tiles(asked, batches))]

    n = found[1]
    blocks = -(-n * row(queries) // block)
    if blocks <= 1:
        asked = columns(queries.toArrow())
        if not len(next(iter(asked.values()))):
            return fold(spark.createDataFrame([], schema))
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays(result(shared.value, (b for b in batches if b.num_rows)), names=names)

        return fold(gallery.mapInArrow(run, schema))

    other = -(-gallery.count() * row(gallery) // block)
    cell = lambda q, g: (q * other + g).alias("cell")
    number = lambda d, k: F.pmod(F.xxhash64(d.columns[0]), F.lit(k))
    left = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("_g")).select(*queries.columns, cell(number(queries, blocks), F.col("_g")))
    right = gallery.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_q")).select(*gallery.columns, cell(F.col("_q"), number(gallery, other)))

    def meet(q: pa.Table, g: pa.Table) -> pa.Table:
        import pyarrow as pa

        q, g = q.drop_columns(["cell"]), g.drop_columns(["cell"])
        if not q.num_rows or not g.num_rows:
            return pa.table([[]] * len(names), names=names).cast(empty)
        return pa.table(result(columns(q), g.to_batches(max_chunksize=step)), names=names)

    empty = spark.createDataFrame([], schema).toArrow().schema
    return fold(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, schema))


def top_k(gallery: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, digits: int = 6, block_bytes: int | None = None) -> DataFrame:
    """query_id, tile_id, sim, rk: each query's k most similar tiles, ties to the smaller tile_id.

    Similarities are dot products in double, rounded before ranking so that ties do not
    depend on summation order.
    """

    def task(asked, tiles):
        import numpy as np

        qid, qx = asked["query_id"], asked["qemb"]
        ids, sims = np.zeros((len(qid), k), np.int64), np.full((len(qid), k), -np.inf)
        for q, b in tiles:
            own = b["tile_id"]
            s = np.round(qx[q] @ b["emb"].T, digits)
            if exclude_self:
                s[qid[q][:, None] == own[None, :]] = -np.inf
            s, t = np.concatenate([sims[q], s], axis=1), np.concatenate([ids[q], np.broadcast_to(own, s.shape)], axis=1)
            order = np.lexsort((t, -s), axis=1)[:, :k]
            sims[q], ids[q] = np.take_along_axis(s, order, 1), np.take_along_axis(t, order, 1)
        ok = np.isfinite(sims)
        return qid[np.nonzero(ok)[0]], ids[ok], sims[ok]

    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "tile_id")
    best = lambda d: d.select("query_id", "tile_id", "sim").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    return against(gallery.select("tile_id", "emb"), queries.select("query_id", "qemb"), task, "query_id long, tile_id long, sim double", best, block_bytes)


def truth_ranks(gallery: DataFrame, queries: DataFrame, truth: DataFrame, radii: tuple[int, ...] = (), weights: list[float] | None = None, digits: int = 6, earth_m: float = 6_371_000.0, block_bytes: int | None = None) -> DataFrame:
    """part, query_id, gt_id, rank and rank_r<R>: how many tiles beat each query's true tile (ties to the smaller tile_id, the own tile out).

    Gallery: tile_id, emb; queries: query_id, qemb; truth: query_id, gt_id; queries
    without a truth give no row. rank_r<R> counts only tiles within R metres of the
    query's (qlat, qlon), by the gallery's lat and lon, and is -1 where the true tile
    itself lies farther. ``weights`` asks once for each blend weight a (``part``) of emb
    and a second vector, ``other`` and ``qother``: a * emb + (1 - a) * other, scaled to
    length 1; without weights the vectors are taken as they are and part is 0.
    """
    geo = ["lat", "lon"] if radii else []
    mixed = weights is not None
    sides = gallery.select("tile_id", "emb", *(["other"] if mixed else []), *geo)
    true = gallery.select(F.col("tile_id").alias("gt_id"), F.col("emb").alias("gemb"), *([F.col("other").alias("gother")] if mixed else []), *[F.col(c).alias(f"g{c}") for c in geo])
    asked_ = queries.select("query_id", "qemb", *(["qother"] if mixed else []), *[f"q{c}" for c in geo]).join(truth.select("query_id", "gt_id"), "query_id").join(true, "gt_id")
    names = ["rank", *[f"rank_r{r}" for r in radii]]

    def task(asked, tiles):
        import numpy as np

        def blend(x, other, a):
            if a is None:
                return x
            v = a * x + (1 - a) * other
            return v / (np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] + 1e-12)

        def metres(lat1, lon1, lat2, lon2):
            p, q = np.radians(lat1), np.radians(lat2)
            s = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
            return 2 * earth_m * np.arcsin(np.sqrt(np.clip(s, 0, 1)))

        qid, gt = asked["query_id"], asked["gt_id"]
        parts = weights if mixed else [None]
        qs = [blend(asked["qemb"], asked.get("qother"), a) for a in parts]
        gs = [np.round(np.einsum("ij,ij->i", q, blend(asked["gemb"], asked.get("gother"), a)), digits) for q, a in zip(qs, parts)]
        count = np.zeros((len(parts), 1 + len(radii), len(qid)), np.int64)
        for q, b in tiles:
            t = b["tile_id"][None, :]
            rest = (t != qid[q][:, None]) & (t != gt[q][:, None])
            if radii:
                d = metres(asked["qlat"][q][:, None], asked["qlon"][q][:, None], b["lat"][None, :], b["lon"][None, :])
            for p, a in enumerate(parts):
                s = np.round(qs[p][q] @ blend(b["emb"], b["other"] if mixed else None, a).T, digits)
                better = rest & ((s > gs[p][q][:, None]) | ((s == gs[p][q][:, None]) & (t < gt[q][:, None])))
                count[p, 0, q] += better.sum(axis=1)
                for r, m in enumerate(radii):
                    count[p, 1 + r, q] += (better & (d <= m)).sum(axis=1)
        if radii:
            own = metres(asked["qlat"], asked["qlon"], asked["glat"], asked["glon"])
            for r, m in enumerate(radii):
                # Large enough a negative that no task's sum becomes a count.
                count[:, 1 + r, own > m] = -(1 << 40)
        of = np.repeat(np.array([a if mixed else 0.0 for a in parts]), len(qid))
        return of, np.tile(qid, len(parts)), np.tile(gt, len(parts)), *count.transpose(1, 0, 2).reshape(1 + len(radii), -1)

    fold = lambda d: d.groupBy("part", "query_id", "gt_id").agg(*[F.sum(c).alias(c) for c in names])
    out = against(sides, asked_, task, "part double, query_id long, gt_id long, " + ", ".join(f"{c} long" for c in names), fold, block_bytes)
    return out.select("part", "query_id", "gt_id", *[F.greatest(F.col(c), F.lit(-1)).cast("long").alias(c) for c in names])


def histogram(gallery: DataFrame, queries: DataFrame, bins: int, digits: int = 6, block_bytes: int | None = None) -> DataFrame:
    """bin, same, n: similarities of all (query, other tile) pairs in equal bins over [-1, 1] (values outside in the end bins), by whether ``qlabel`` and ``label`` agree."""

    def task(asked, tiles):
        import numpy as np

        n = np.zeros((2, bins), np.int64)
        for q, b in tiles:
            s = np.round(asked["qemb"][q] @ b["emb"].T, digits)
            place = np.clip(np.floor((s + 1) * (bins / 2)), 0, bins - 1).astype(np.int64)
            other = asked["query_id"][q][:, None] != b["tile_id"][None, :]
            same = asked["qlabel"][q][:, None] == b["label"][None, :]
            for k in (0, 1):
                n[k] += np.bincount(place[other & (same == bool(k))], minlength=bins)
        k, i = np.nonzero(n)
        return i, k == 1, n[k, i]

    fold = lambda d: d.groupBy("bin", "same").agg(F.sum("n").alias("n"))
    return against(gallery.select("tile_id", "emb", "label"), queries.select("query_id", "qemb", "qlabel"), task, "bin long, same boolean, n long", fold, block_bytes)


def mutual(gallery: DataFrame, queries: DataFrame, digits: int = 6, block_bytes: int | None = None) -> DataFrame:
    """query_id, tile_id, sim: pairs that are each other's best (ties to the smaller id), a query's own tile left out."""

    def task(asked, tiles):
        import numpy as np

        qid, qx = asked["query_id"], asked["qemb"]
        order = np.argsort(qid, kind="stable")
        qid, qx = qid[order], qx[order]
        top, at = np.full(len(qid), -np.inf), np.zeros(len(qid), np.int64)
        rows = []
        for q, b in tiles:
            by_id = np.argsort(b["tile_id"], kind="stable")
            t, x = b["tile_id"][by_id], b["emb"][by_id]
            s = np.round(qx[q] @ x.T, digits)
            s[qid[q][:, None] == t[None, :]] = -np.inf
            # argmax takes the first of equal values, so the smaller id on either side.
            r, c = s.argmax(axis=1), s.argmax(axis=0)
            mine = s[np.arange(len(s)), r]
            new = (mine > top[q]) | ((mine == top[q]) & (t[r] < at[q]))
            top[q], at[q] = np.where(new, mine, top[q]), np.where(new, t[r], at[q])
            rows.append((np.ones(len(t), np.int32), qid[q][c], t, s[c, np.arange(len(t))]))
        rows.append((np.zeros(len(qid), np.int32), qid, at, top))
        out = [np.concatenate(z) for z in zip(*rows)]
        ok = np.isfinite(out[3])
        return [z[ok] for z in out]

    def fold(d):
        best = lambda k, o, side: d.filter(F.col("side") == side).groupBy(k).agg(F.max(F.struct("sim", (-F.col(o)).alias("o"))).alias("m")).select(F.lit(side).alias("side"), k, (-F.col("m.o")).alias(o), F.col("m.sim").alias("sim"))
        cols = ["side", "query_id", "tile_id", "sim"]
        return best("query_id", "tile_id", 0).select(cols).unionAll(best("tile_id", "query_id", 1).select(cols))

    d = against(gallery.select("tile_id", "emb"), queries.select("query_id", "qemb"), task, "side int, query_id long, tile_id long, sim double", fold, block_bytes)
    return d.filter("side = 0").drop("side").join(d.filter("side = 1").select("query_id", "tile_id"), ["query_id", "tile_id"])
