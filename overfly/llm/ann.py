"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's code is the signs of its randomly rotated components, packed into
64-bit words, with one correction scalar: the inner product of the rotated unit
vector and its code. A query is rotated too and cut to four bit planes, so its inner
product with a code is a few AND and POPCOUNT steps. The estimate has a known
spread; vectors whose upper bound reaches the query's fifth best exact score so
far are reranked on the original vectors in double precision.

Queries are broadcast in blocks of bounded size, one at a time, and every block meets
all rows where they lie, so vectors are never shuffled; each task keeps the best few of
each query. Where there are several blocks, a block's results are checkpointed and its
broadcast is destroyed before the next one is gathered, so the driver and each executor
hold one block however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, map_arrow
from .vectors import matrices, units, usable

#: Bits of a query's components; standard deviations of room; bytes of a query block.
PLANES, ROOM, BLOCK_BYTES = 4, 2.4, 32 << 20


def rotation(n: int, seed: int = 4) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + n).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of uint64 words."""
    n = -(-bits.shape[1] // 64) * 64
    wide = np.zeros((len(bits), n), dtype=bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, correction scalars) of unit vectors."""
    y = x @ turn
    return pack(y > 0), np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])


class Queries:
    """A block of unit query vectors of one length, rotated and cut to bit planes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.n = ids, units(x), x.shape[1]
        self.raw, self.norm = x, np.sqrt(np.einsum("ij,ij->i", x, x))
        self.turn = rotation(self.n)
        y = self.x @ self.turn
        self.low = y.min(axis=1)
        self.step = np.maximum((y.max(axis=1) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [pack((level >> k) & 1 == 1) for k in range(PLANES)]
        self.sum = self.low * self.n + self.step * level.sum(axis=1)

    def estimates(self, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, rows of the room above them), rows by queries."""
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
        inner = np.zeros((len(codes), len(self.ids)), np.float32)
        for k, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                inner += np.bitwise_count(codes[:, w, None] & plane[None, :, w]) * np.float32(1 << k)
        est = 2 * (inner * self.step.astype(np.float32) + ones[:, None] * self.low.astype(np.float32)) - self.sum.astype(np.float32)
        est /= (scalars * np.sqrt(self.n)).astype(np.float32)[:, None]
        code = np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / np.sqrt(max(self.n - 1, 1))
        cut = self.step[None, :] / np.sqrt(12) / scalars[:, None]
        return est, (ROOM * (code[:, None] + cut)).astype(np.float32)

    def exact(self, q: np.ndarray, rows: np.ndarray, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Cosines of pairs in double precision; equal vectors give equal bits."""
        out = np.empty(len(q))
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], rows[i : i + (1 << 16)]
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", self.raw[a], x[b]) / (self.norm[a] * norm[b])
        return out


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: Queries, k: int) -> None:
        self.q, self.k = queries, k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(len(queries.ids), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(z) for z in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        last = place[keep] == self.k - 1
        self.bar[self.query[last]] = self.score[last]

    def scan(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Estimate all pairs of this batch from codes, rerank those that may be among the best."""
        q = self.q
        codes, scalars = encode(units(x), q.turn)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        rows = max(64, (1 << 21) // max(1, len(q.ids)))
        for i in range(0, len(ids), rows):
            part = slice(i, i + rows)
            est, room = q.estimates(codes[part], scalars[part])
            est[ids[part, None] == q.ids[None, :]] = -np.inf  # the query's own row
            if np.isneginf(self.bar).any() or i == 0:
                top = np.argpartition(-est, min(self.k, len(est)) - 1, axis=0)[: self.k]
                self._rerank(np.tile(np.arange(len(q.ids)), len(top)), top.reshape(-1), est, ids[part], x[part], norm[part])
                est[top, np.arange(len(q.ids))[None, :]] = -np.inf
            # A tie with the bar may still win by its smaller id, so reaching it counts.
            r, c = np.nonzero((est + room >= self.bar[None, :]) & (est > -np.inf))
            self._rerank(c, r, est, ids[part], x[part], norm[part])

    def _rerank(self, c: np.ndarray, r: np.ndarray, est: np.ndarray, ids: np.ndarray, x: np.ndarray, norm: np.ndarray) -> None:
        ok = est[r, c] > -np.inf
        c, r = c[ok], r[ok]
        if len(c):
            score = self.q.exact(c, r, x, norm)
            good = score >= self.bar[c]
            self.add(c[good], ids[r[good]], score[good])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of ``vectors`` by cosine.

    Both have vec_id and embedding. Rows whose vector is null, empty, zero or
    holds null or non-finite components, and rows without an id, take part on neither
    side; vectors of another length than the query's are not compared. A row with
    the query's id is its own and no candidate; repeated rows under another id
    each count; a repeated query id asks once. Fewer candidates than k give fewer
    rows. Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, length = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    schema = "query_id long, vec_id long, score double"
    blocks = max(1, -(-n * 8 * (length or 1) // block_bytes))
    parts = []
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if rows.num_rows == 0:
            continue
        ids = np.asarray(rows.column("vec_id"))
        shared = spark.sparkContext.broadcast([(ids[at], x) for at, x in matrices(rows.column("embedding"))])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {x.shape[1]: Best(Queries(i, x), k) for i, x in shared.value}
            for batch in batches:
                own = np.asarray(batch.column(0))
                for at, x in matrices(batch.column(1)):
                    if x.shape[1] in best:
                        best[x.shape[1]].scan(own[at], x)
            for t in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(t.q.ids[t.query]), pa.array(t.id), pa.array(t.score)], names=["query_id", "vec_id", "score"])

        part = map_arrow(vectors, run, schema)
        if blocks > 1:
            part = checkpointed(_best(part, k).select("query_id", "vec_id", "score"))
            shared.destroy()
        parts.append(part)
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; tasks gave k each."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
