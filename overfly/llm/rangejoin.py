"""Near-duplicate vectors by an exact metric range join.

On the unit sphere cosine >= c means distance <= sqrt(2 - 2c) = e. Pivots from a
bounded sample cut space into cells of nearest pivot. A vector y can have a
neighbour in cell j only if it lies within e of the half space nearer to pivot j, and
(by the triangle inequality) if its distance to the pivot is within e of a home
row's. A cell's home rows are cut into rings by their distance to the pivot, and y is
copied as a guest to exactly the rings within reach, of its own cell and of cells
before it (a pair of two cells is found once, in the first of them, for both sides).
Cells join independently. A ring is dealt out as blocks of home rows by blocks of
guests, so neither a hot cell nor a wide boundary lands in one task. Equal vectors are
joined as one with their count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, ship
from .graph import components
from .vectors import matrices, units, usable

COSINE = 0.9
#: Rows of a home block and of a guest block; most pivots, and most rings of a cell.
HOME, GUEST, PIVOTS, RINGS = 8192, 16384, 1024, 64
#: Pivots of a cut are at least so far apart, so that rounding errors stay far below the slack of the bounds.
APART = 1e-3


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum(2 - 2 * (x @ p.T), 0)


def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, their distances): the unit vectors without those nearer than ``APART`` to one that is kept.

    Distances are norms of differences; a pivot's own is infinite.
    """
    kept: list[np.ndarray] = []
    for v in x:
        if not kept or np.linalg.norm(np.stack(kept) - v, axis=1).min() >= APART:
            kept.append(v)
    p = np.stack(kept)
    gap = np.stack([np.linalg.norm(p - v, axis=1) for v in p])
    np.fill_diagonal(gap, np.inf)
    return p, gap


def near_vectors(vectors: DataFrame, cosine: float = COSINE, home: int = HOME, guest: int = GUEST, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= ``cosine`` (double precision),
    component_id is the least vec_id reachable, itself included, kept marks vec_id =
    component_id. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different lengths are never linked.
    Repeated rows each count and each give a row; rows without an id take part
    but name no component: one of such rows alone has a null component_id and keeps
    all. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", usable(F.col("embedding")).alias("ok"))
    classes = checkpointed(rows.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")))
    n, named, top = classes.agg(F.count(F.lit(1)), F.count("rep"), F.max("rep")).first()
    top = -1 if top is None else top
    if named < n:
        # Classes without an id get keys above all ids, so that these are never a component's least where it has an id.
        classes = checkpointed(classes.withColumn("rep", F.coalesce("rep", F.lit(top + 1) + F.monotonically_increasing_id())))
    want = max(1, min(pivots, -(-n // home)))
    picked = classes.orderBy(F.xxhash64("rep", F.lit(7)), "rep").limit(want).select("embedding").toArrow()
    by_size = {x.shape[1]: spread(units(x)) for _, x in matrices(picked.column(0))} if picked.num_rows else {}
    # Cells are numbered through all vector lengths; a length without a pivot is one cell of its own.
    first, at = {}, 0
    for size, (p, _) in sorted(by_size.items()):
        first[size] = at
        at += len(p)
    model = spark.sparkContext.broadcast((by_size, first))
    fields = "rep long, m long, embedding array<double>, cell long, far double"

    def assign(batches):
        own, start = model.value
        for b in batches:
            rep, m = b.column(0), b.column(1)
            for rows_, raw in matrices(b.column(2)):
                size = raw.shape[1]
                x = units(raw)
                if size in own:
                    d = _squares(x, own[size][0])
                    cell, far = start[size] + d.argmin(axis=1), np.sqrt(d.min(axis=1))
                else:
                    cell, far = np.full(len(x), -size), np.zeros(len(x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(raw.reshape(-1)))
                take = pa.array(rows_)
                yield pa.RecordBatch.from_arrays([rep.take(take), m.take(take), lists, pa.array(cell.astype(np.int64)), pa.array(far)], names=["rep", "m", "embedding", "cell", "far"])

    placed = checkpointed(map_arrow(classes.select("rep", "m", F.col("embedding").cast("array<double>").alias("embedding")), assign, fields))
    # One row per cell (pivots and lengths at most) with quantiles of the distances: bounded.
    cuts = F.percentile_approx("far", F.array(*[F.lit(i / RINGS) for i in range(RINGS + 1)]), F.lit(1000)).alias("q")
    cells = {r["cell"]: (r["n"], r["lo"], r["hi"], r["q"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"), cuts).collect()}
    rings = Rings(cells, home)
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    #: Vectors travel as they were stored; single precision is exact for float arrays.
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64

    def visits(own, start, raw, cell, size):
        """The rings that each vector is copied to as a guest: (row, ring) pairs."""
        if size not in own:
            return rings.within(np.arange(len(raw)), np.full(len(raw), -size), np.zeros(len(raw)), reach)
        (p, gap), s = own[size], start[size]
        out = []
        for i in range(0, len(raw), 1024):
            x, mine = units(raw[i : i + 1024]), cell[i : i + 1024] - s
            d = _squares(x, p)
            near = (d - d[np.arange(len(x)), mine][:, None]) / (2 * gap[mine]) <= reach
            near[np.arange(len(x)), mine] = True
            near &= np.arange(len(p)) <= mine[:, None]
            r, c = np.nonzero(near)
            r, ring = rings.within(r, c + s, np.sqrt(d[r, c]), reach)
            out.append((r + i, ring))
        return tuple(np.concatenate(z) for z in zip(*out))

    def tally(batches):
        own, start = model.value
        many = np.zeros((len(rings.cell), 2), np.int64)
        for b in batches:
            cell, far = np.asarray(b.column(1)), np.asarray(b.column(2))
            many[:, 0] += np.bincount(rings.of(cell, far), minlength=len(many))
            for rows_, x in matrices(b.column(0)):
                many[:, 1] += np.bincount(visits(own, start, x, cell[rows_], x.shape[1])[1], minlength=len(many))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(many))), pa.array(many[:, 0]), pa.array(many[:, 1])], names=["ring", "h", "g"])

    blocks = np.zeros((len(rings.cell), 2), np.int64)
    for r in map_arrow(placed.select("embedding", "cell", "far"), tally, "ring long, h long, g long").groupBy("ring").agg(F.sum("h").alias("h"), F.sum("g").alias("g")).collect():
        blocks[r["ring"]] = -(-r["h"] // home), max(1, -(-r["g"] // guest))

    def deal(batches):
        own, start = model.value
        for b in batches:
            rep, m, cell, far = (np.asarray(b.column(i)) for i in (0, 1, 3, 4))
            mix = (rep * 2654435761) >> 7
            at_home = rings.of(cell, far)
            for rows_, x in matrices(b.column(2)):
                for is_home, (rr, ring) in ((True, (np.arange(len(x)), at_home[rows_])), (False, visits(own, start, x, cell[rows_], x.shape[1]))):
                    times = blocks[ring, 1 if is_home else 0]
                    i = np.repeat(np.arange(len(rr)), times)
                    k = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    g = rows_[rr[i]]
                    hb = mix[g] % blocks[ring[i], 0] if is_home else k
                    gb = k if is_home else (mix[g] // 8191) % blocks[ring[i], 1]
                    # 0: home, 1: guest from another cell, 2: guest of the cell itself.
                    role = np.zeros(len(i), np.int32) if is_home else np.where(rings.cell[ring[i]] == cell[g], 2, 1).astype(np.int32)
                    for a in range(0, len(i), 8192):
                        z = slice(a, a + 8192)
                        vec = pa.array([v.tobytes() for v in x[rr[i[z]]].astype(kind)], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(ring[i[z]]), pa.array(hb[z]), pa.array(gb[z]), pa.array(role[z]), pa.array(rep[g[z]]), pa.array(m[g[z]]), vec], names=["ring", "hb", "gb", "role", "rep", "m", "vec"])

    dealt = map_arrow(placed, deal, "ring long, hb long, gb long, role int, rep long, m long, vec binary")

    def join(t: pa.Table) -> pa.Table:
        role, rep, m = (np.asarray(t.column(c)) for c in ("role", "rep", "m"))
        x = units(np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).reshape(t.num_rows, -1).astype(np.float64))
        hs, gs = np.flatnonzero(role == 0), np.flatnonzero(role)
        here, there, (nodes, roots) = linked(x[hs], rep[hs], m[hs], x[gs], rep[gs], m[gs], cosine)
        there[role[gs] == 2] = 0
        ids, links = np.concatenate([rep[hs], rep[gs]]), np.concatenate([here, there])
        some = links > 0
        u = np.concatenate([ids[some], nodes])
        v = np.concatenate([ids[some], roots])
        k = np.concatenate([links[some], np.zeros(len(nodes), np.int64)])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "k": pa.array(k, pa.int64())})

    out = checkpointed(dealt.groupBy("ring", "hb", "gb").applyInArrow(join, "u long, v long, k long"))
    links = out.filter("k > 0").groupBy("u").agg(F.sum("k").alias("k"))
    roots = components(out.filter("u <> v").select("u", "v"))
    reps = classes.join(links, F.col("rep") == F.col("u"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    reps = reps.select(F.col("embedding").alias("_e"), "rep", (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("_k"), F.coalesce("root", "rep").alias("_root"))
    reps = reps.withColumn("_root", F.when(F.col("_root") <= top, F.col("_root")))
    d = rows.join(reps, F.when(F.col("ok"), F.col("embedding")) == F.col("_e"), "left")
    d = d.select("vec_id", F.coalesce("_k", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_root", "vec_id").alias("component_id"))
    return d.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class Rings:
    """Each cell's home rows by distance to the pivot, cut at quantiles into about one ring per home block."""

    def __init__(self, cells: dict, home: int) -> None:
        cell, lo, hi = [], [], []
        #: Cell to its first ring and number of rings.
        self.first: dict[int, tuple[int, int]] = {}
        for c in sorted(cells):
            n, least, most, q = cells[c]
            k = max(1, min(RINGS, -(-n // home)))
            inner = sorted({q[round(i * RINGS / k)] for i in range(1, k)} - {most})
            self.first[c] = (len(cell), len(inner) + 1)
            cell += [c] * (len(inner) + 1)
            lo += [least, *inner]
            hi += [*inner, most]
        self.cell, self.lo, self.hi = np.array(cell, np.int64), np.array(lo), np.array(hi)

    def _ranges(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first ring, number of rings) of each cell; one that has no home rows has none."""
        names, which = np.unique(cell, return_inverse=True)
        both = np.array([self.first.get(c, (0, 0)) for c in names.tolist()], np.int64).reshape(-1, 2)[which]
        return both[:, 0], both[:, 1]

    def of(self, cell: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The ring of each home row: the first whose outer distance is not below its own."""
        first, n = self._ranges(cell)
        ring = first.copy()
        for c in np.unique(cell):
            mine = cell == c
            a, k = self.first[c]
            ring[mine] = a + np.minimum(np.searchsorted(self.hi[a : a + k], far[mine]), k - 1)
        return ring

    def within(self, row: np.ndarray, cell: np.ndarray, d: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, ring) of all rings of these cells that a vector at distance d to the pivot may have neighbours in."""
        first, n = self._ranges(cell)
        i = np.repeat(np.arange(len(row)), n)
        ring = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (d[i] >= self.lo[ring] - reach) & (d[i] <= self.hi[ring] + reach)
        return row[i[ok]], ring[ok]


def linked(h: np.ndarray, hid: np.ndarray, hm: np.ndarray, g: np.ndarray, gid: np.ndarray, gm: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(rows linked to each home vector, to each guest, forest edges over the ids) of unit vectors.

    Single precision decides all but the pairs within 1e-4 of the bound; those are
    decided in double precision. A vector is no partner of its own id.
    """
    here, there = np.zeros(len(h), np.int64), np.zeros(len(g), np.int64)
    ids, place = np.unique(np.concatenate([hid, gid]), return_inverse=True)
    hp, gp = place[: len(h)], place[len(h) :]
    label = np.arange(len(ids))
    g32 = g.astype(np.float32)
    for i in range(0, len(h), 256):
        s = h[i : i + 256].astype(np.float32) @ g32.T
        r, c = np.nonzero(s > cosine - 1e-4)
        near = s[r, c] < cosine + 1e-4
        ok = ~near
        ok[near] = np.einsum("ij,ij->i", h[i + r[near]], g[c[near]]) >= cosine
        ok &= hid[i + r] != gid[c]
        r, c = r[ok], c[ok]
        there += np.bincount(c, hm[i + r], len(g)).astype(np.int64)
        for k, cols in zip(np.unique(r), np.split(c, np.flatnonzero(np.diff(r)) + 1)):
            here[i + k] = gm[cols].sum()
            roots = np.unique(np.append(label[gp[cols]], label[hp[i + k]]))
            if len(roots) > 1:
                label[np.isin(label, roots[1:])] = roots[0]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return here, there, (ids[moved], ids[label[moved]])


#: The same rows by all pairs of vectors of one length.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings
), u AS (
  SELECT rid, x, sqrt(list_inner_product(x, x)) AS n FROM d WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
), e AS (
  SELECT a.rid AS u, b.rid AS v FROM u a JOIN u b ON len(a.x) = len(b.x) AND a.rid <> b.rid WHERE list_inner_product(a.x, b.x)/(a.n*b.n) >= 0.9
), reach AS (
  SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.v FROM reach r JOIN e ON r.b = e.u
), least AS (
  SELECT a AS rid, min(o.vec_id) AS component_id FROM reach JOIN d o ON o.rid = b GROUP BY a
), k AS (
  SELECT u AS rid, count(*) AS n FROM e GROUP BY u
)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN least USING (rid) LEFT JOIN k USING (rid)
"""
