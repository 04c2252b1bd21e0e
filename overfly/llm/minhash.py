"""Near-duplicate documents by MinHash, banding and exact confirmation.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), many
   universal hash minima of it, their bands, and a 128-bit digest of the set.
2. Documents with equal sets form a class, one node of the graph; one of its documents gives the set.
3. In each band bucket all members are paired with the bucket's least member.
   Pairs that the sizes or signatures rule out go; the rest are confirmed on full sets.
4. Components of the confirmed links come from large-star and small-star steps.
5. Buckets that still hold members of different components are completed: pairs
   across components there are tested too, so a chain that avoids the bucket's
   least member is found as well. Pairs inside a component need no test, nor do
   those that the sizes and each set's own shingles (found in no other such
   document) rule out; that bound leaves few pairs in groups of copies with edits.

With 40 bands of 5 rows a pair at similarity 0.75 shares no bucket with
probability 2e-5, and less above. Buckets are never capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, WHITE, chunks, hash_spans, hash_windows, mix64, spans, stream64
from .common import checkpointed, looked_up, map_arrow, reclaim, ship, with_rank
from .graph import components

SHINGLE, BANDS, ROWS, PERCENT = 5, 40, 5, 75
#: Shingles hashed at a time, so that the block stays in the cache.
BLOCK = 2048
#: Buckets up to this many open members are joined directly; larger ones by blocks of so many members and so many shingles at most.
FEW, BUCKET_BLOCK, BLOCK_SHINGLES = 24, 512, 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    low = LOWER[data]
    begin, end, counts = spans(~WHITE[low], offsets)
    words = hash_spans(low, begin, end)
    full = hash_windows(words, width)
    short = {w: hash_windows(words, w) for w in range(1, width) if (counts == w).any()}
    at = 0
    for c in counts.tolist():
        yield np.unique(full[at : at + c - width + 1]) if c >= width else short[c][at : at + 1] if c else full[:0]
        at += c


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of a*x+b modulo 2**64 over x, for each (a, b)."""
    out = None
    for i in range(0, len(x), BLOCK):
        m = (x[None, i : i + BLOCK] * a[:, None] + b[:, None]).min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out


SKETCH = "doc_id long, th long, n_shingles long, h long, g long, bands array<long>, signature binary"


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, 128-bit set digest (h, g), band keys, and one byte of each minimum."""
    n = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = stream64(21, n) | np.uint64(1), stream64(22, n)
        salt = stream64(23, bands)
        step = stream64(24, rows) | np.uint64(1)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                sizes, h, g = [], [], []
                low = np.zeros((hi - lo, n), np.uint64)
                for i, s in enumerate(shingle_sets(data, offsets, shingle)):
                    sizes.append(len(s))
                    h.append(mix64(s).sum(dtype=np.uint64))
                    g.append(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    if len(s):
                        low[i] = minima(s, a, b)
                keys = mix64((low.reshape(-1, bands, rows) * step).sum(axis=2, dtype=np.uint64) + salt)
                keys[np.array(sizes) == 0] = 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
                marks = np.ascontiguousarray((low >> np.uint64(40)).astype(np.uint8))
                sig = pa.array([r.tobytes() for r in marks], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(g, np.uint64).view(np.int64)), lists, sig], names=["doc_id", "th", "n_shingles", "h", "g", "bands", "signature"])

    return map_arrow(_texts(docs), run, SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _agreement(percent: int, n: int) -> float:
    """How many of n minima agree at least in a pair at the similarity: four standard deviations below the mean."""
    j = percent / 100
    return n * j - 4.2 * (n * j * (1 - j)) ** 0.5


def _likely(pairs: DataFrame, reps: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs (u, v) whose sizes and signatures allow the similarity."""
    least = _agreement(percent, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, n) for k in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    side = lambda k: reps.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("signature").alias(f"s{k}"))
    d = pairs.join(side("v"), "v").join(side("u"), "u").filter(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    return map_arrow(d.select("u", "v", "su", "sv"), run, "u long, v long")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, again: bool) -> DataFrame:
    """(id, sorted set) of ``nodes`` (id, doc_id, th), whose texts are shuffled once; ``again`` says that rows of one (doc_id, th) may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in shingle_sets(data, offsets, shingle)], pa.binary())], names=["id", "set"])

    # Missing ids join as one more value; joins on plain equality, so that texts need no sort.
    key = lambda d: [F.coalesce(F.col(f"{d}doc_id"), F.lit(-1).cast("long")), F.col(f"{d}doc_id").isNull(), F.col(f"{d}th")]
    texts = _texts(docs)
    if again:
        texts = texts.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    side = nodes.select("id", F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"))
    on = [x == y for x, y in zip(key(""), key("_"))]
    return map_arrow(texts.join(side.hint("shuffle_hash"), on).select("id", "text"), run, "id long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["u", "v"])

    d = pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v").join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u")
    return map_arrow(d.select("u", "v", "su", "sv"), run, "u long, v long").distinct()


def _reach(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, most) of each set of ``ids``: its size and the largest size that a linked partner among ``ids`` can have.

    A link needs an intersection of at least percent/(100+percent) of both sizes. It
    cannot exceed c, the shingles of the set that any other set has too, so the
    partner's size is at most c*(100+percent)/percent - n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b.column(0), b.column(1)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                # The set's own tag is one more shingle that no other set has, so that every set comes out below.
                tag = mix64(x.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))
                h = np.append(x, mix64(tag)).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(tag, n).view(np.int64)), pa.array(np.full(n, i.as_py())), pa.array(np.full(n, n - 1))], names=["h", "tag", "id", "n"])

    own = sets.join(ids, "id", "left_semi")
    rows = map_arrow(own.select("id", "set"), run, "h long, tag long, id long, n long").groupBy("h").agg(F.min("tag").alias("tag"), F.max("tag").alias("z"), F.min("id").alias("id"), F.max("n").alias("n")).filter("tag = z")
    c = F.max("n") - (F.count(F.lit(1)) - 1)
    return rows.groupBy("id", "tag").agg(F.max("n").alias("n"), F.floor(c * (100 + percent) / percent - F.max("n") + 1e-6).cast("long").alias("most")).drop("tag")


def intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, as products of 0/1 matrices over their common values."""
    xv, yv = np.concatenate(xs), np.concatenate(ys)
    xr, yr = (np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (xs, ys))
    common = np.intersect1d(xv, yv)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(common):
        return out
    xi, yi = np.searchsorted(common, xv), np.searchsorted(common, yv)
    kx, ky = common[np.minimum(xi, len(common) - 1)] == xv, common[np.minimum(yi, len(common) - 1)] == yv
    for i in range(0, len(common), 4096):
        m = min(4096, len(common) - i)
        a, b = np.zeros((len(xs), m), np.float32), np.zeros((len(ys), m), np.float32)
        sx, sy = kx & (xi >= i) & (xi < i + m), ky & (yi >= i) & (yi < i + m)
        a[xr[sx], xi[sx] - i] = 1
        b[yr[sy], yi[sy] - i] = 1
        out += a @ b.T
    return out


def _blocks(large: DataFrame, percent: int) -> DataFrame:
    """(key, lo, hi, b, id, root, n, most): the members of large buckets, once for each pair of blocks that they meet in.

    Members are ordered by size inside their bucket and cut into blocks, so that most
    pairs of blocks are ruled out by what is known of a block: its sizes, the largest
    partner that a member can have, and its component if it holds only one.
    """
    d = with_rank(large, [F.col("key")], [F.col("n"), F.col("id")], "_rank")
    # A block holds one scale of sizes, so many members that its shingles are bounded; block numbers rise with the sizes.
    d = d.withColumn("_scale", F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("long"))
    rows = F.greatest(F.lit(1), F.least(F.lit(BUCKET_BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2.0), F.col("_scale")))))
    d = checkpointed(d.withColumn("b", F.shiftleft("_scale", 40) + F.floor(F.col("_rank") / rows)).drop("_rank", "_scale"))
    of = d.groupBy("key", "b").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("most").alias("most"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    side = lambda k: of.select("key", *[F.col(c).alias(f"{k}_{c}") for c in ("b", "n0", "n1", "most", "r0", "r1")])
    pairs = side("lo").join(side("hi"), "key").filter(f"lo_b <= hi_b AND {percent} * hi_n0 <= 100 * lo_n1 AND hi_n0 <= lo_most AND lo_n0 <= hi_most AND NOT (lo_r0 = hi_r1 AND lo_r1 = hi_r0)")
    pairs = pairs.select("key", F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi"))
    meets = pairs.select("key", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("b"))
    return d.join(meets, ["key", "b"]).select("key", "lo", "hi", "b", "id", "root", "n", "most")


def _across(small: DataFrame, large: DataFrame, sets: DataFrame, percent: int, n: int, bins: int) -> DataFrame:
    """(u, v, sure): pairs of different components that share a bucket.

    Rows have key, id, root, n, most; small buckets' rows have a signature too. Small
    buckets are binned and give likely pairs. Large ones are cut into blocks, two of
    which meet at a time, so that no task holds more than two; their pairs are decided
    on the full sets at once, and only links come out.
    """
    ship(small.sparkSession)
    none = F.lit(None).cast("binary")
    zero = F.lit(0).cast("long")
    few = small.select(F.pmod("key", F.lit(bins)).alias("bin"), F.lit(False).alias("big"), zero.alias("lo"), zero.alias("hi"), zero.alias("b"), "key", "id", "root", "n", "most", "signature", none.alias("set"))
    many = _blocks(large, percent).join(sets, "id").select(F.col("key").alias("bin"), F.lit(True).alias("big"), "lo", "hi", "b", "key", "id", "root", "n", "most", none.alias("signature"), "set")
    d = few.unionByName(many)
    least = _agreement(percent, n)

    def run(t: pa.Table) -> pa.Table:
        keys, b, lo, hi, ids, root, size, most = (np.asarray(t.column(k)) for k in ("key", "b", "lo", "hi", "id", "root", "n", "most"))
        big = t.column("big")[0].as_py()
        data = t.column("set" if big else "signature").to_pylist()
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(keys, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            x, y = part[b[part] == lo[0]], part[b[part] == hi[0]]
            on = (root[x, None] != root[None, y]) & (size[x, None] <= most[None, y]) & (size[None, y] <= most[x, None])
            if lo[0] == hi[0]:
                on &= ids[x, None] < ids[None, y]
            if not on.any():
                continue
            if big:
                sx, sy = ([np.frombuffer(data[i], np.uint64) for i in z] for z in (x, y))
                both = intersections(sx, sy)
                nx, ny = (np.array([len(v) for v in z], np.float32) for z in (sx, sy))
                on &= 100 * both >= percent * (nx[:, None] + ny[None, :] - both)
                r, c = np.nonzero(on)
            else:
                r, c = np.nonzero(on)
                sx, sy = (np.frombuffer(b"".join([data[i] for i in z]), np.uint8).reshape(-1, n) for z in (x, y))
                keep = (sx[r] == sy[c]).sum(axis=1) >= least
                r, c = r[keep], c[keep]
            us.append(np.minimum(ids[x[r]], ids[y[c]]))
            vs.append(np.maximum(ids[x[r]], ids[y[c]]))
        u = np.concatenate(us)
        return pa.table({"u": pa.array(u), "v": pa.array(np.concatenate(vs)), "sure": pa.array(np.full(len(u), big))})

    return d.groupBy("bin", "big", "lo", "hi").applyInArrow(run, "u long, v long, sure boolean")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their sets
    of distinct shingles (A-Z lower-cased; words outside blank and \\x09-\\x0D).
    component_id is the least doc_id reachable, itself included; kept marks doc_id =
    component_id. Null, empty and blank texts have no shingles and are linked with
    nothing; very long texts are read whole. Every row is a document: repeated rows each
    give a row, and rows of one doc_id with different texts may lie in different
    components. Rows without an id link like all others but name no component:
    component_id is null, and all are kept, where no document of the component has an
    id. An empty table gives no rows. Other columns are not read.

    Links are confirmed on full sets. A pair at the least similarity is missed with
    probability 2e-5 by the bands, and with 1e-5 by the signatures that choose which
    pairs of small buckets (up to ``FEW`` open members) are confirmed; pairs of larger
    buckets are all decided on full sets.
    """
    sk = checkpointed(sketches(docs, shingle, bands, rows))
    some = sk.filter("n_shingles > 0")
    # The document that stands for a class: of the least id, ids that are missing last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("of")
    classes = some.groupBy("h", "g").agg(first).select("h", "g", F.col("of.doc_id").alias("least"), F.col("of.th").alias("th"))
    classes, named = _numbered(checkpointed(classes))
    again = bool(some.groupBy("doc_id", "th").count().filter("count > 1").take(1))
    # Rows of one (doc_id, th) are equal texts: any of them gives the class its bands.
    own = classes.select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("least").alias("_least"), F.col("th").alias("_th"), "id")
    reps = some.join(own, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("th") == F.col("_th")))
    reps = reps.select("id", "n_shingles", "bands", "signature")
    if again or not named:
        reps = checkpointed(reps.groupBy("id").agg(*[F.first(c).alias(c) for c in reps.columns[1:]]))
        marks = reps.select("id", "n_shingles", "signature")
    else:
        # An id is its document's own, so the sketches themselves serve look-ups by id.
        marks = sk.select(F.col("doc_id").alias("id"), "n_shingles", "signature")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("z")).filter("c < z").select("key", "c")
    members = checkpointed(looked_up(keyed, shared, "key"))
    nodes = classes.select("id", F.col("least").alias("doc_id"), "th").join(members.select("id").distinct(), "id", "left_semi")
    sets = checkpointed(_sets(docs, nodes, shingle, again))
    reclaim(docs.sparkSession)
    stars = checkpointed(members.filter("c < id").select(F.col("c").alias("u"), F.col("id").alias("v")).distinct())
    links = checkpointed(_confirmed(_likely(stars, marks, percent, bands * rows), sets, percent))
    found = components(links)

    at = members.select("key", "id").join(found.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("many")).filter("lo < hi").select("key", "many")
    open_ = checkpointed(looked_up(at, mixed, "key"))
    # Members that no size could match go: nothing is linked to them beyond their component.
    open_ = checkpointed(open_.join(_reach(open_.select("id").distinct(), sets, percent), "id").filter("most > 0"))
    bins = max(64, open_.count() // 1000)
    small = open_.filter(f"many <= {FEW}").join(marks.select("id", "signature"), "id")
    large = open_.filter(f"many > {FEW}").select("key", "id", "root", "n", "most")
    more = checkpointed(_across(small, large, sets, percent, bands * rows, bins))
    rest = more.filter("NOT sure").select("u", "v").distinct().join(stars, ["u", "v"], "left_anti")
    if more.take(1):
        more = more.filter("sure").select("u", "v").union(_confirmed(rest, sets, percent))
        found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    d = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("h", "g", F.coalesce("root", "id").alias("root"))
    if not named:
        # Numbers follow the ids, missing ones last, so the root's own least id is the component's.
        d = looked_up(d, classes.select(F.col("id").alias("root"), "least"), "root").select("h", "g", F.col("least").alias("root"))
    d = sk.select("doc_id", "n_shingles", "h", "g").join(d, ["h", "g"], "left")
    d = d.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))
    return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """(classes with a unique ``id`` in the order of ``least``, missing ones last; whether that is ``least`` itself)."""
    n, named, distinct = classes.agg(F.count(F.lit(1)), F.count("least"), F.count_distinct("least")).first()
    if n == named == distinct:
        return classes.withColumn("id", F.col("least")), True
    order = [F.col("least").asc_nulls_last(), F.col("h"), F.col("g")]
    return checkpointed(with_rank(classes, [], order, "id")), False


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The documents with one of each near-duplicate group left: the row of the least doc_id.

    Where one doc_id has rows with different texts, or rows have no id, each
    (doc_id, text) is a document of its own: it goes only as a near duplicate, or as a
    repeat of an equal id and text. Ids that are missing come last.
    """
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    short = F.xxhash64("text")
    mixed = docs.groupBy("doc_id").agg(F.min(short).alias("lo"), F.max(short).alias("hi")).filter("doc_id IS NULL OR lo <> hi")
    if not mixed.take(1):
        kept = near_duplicates(docs, **kw).filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_ov_n"))
        kept = checkpointed(kept)
        reclaim(docs.sparkSession)
        return _rows_of(docs, kept)
    # Nodes are numbered in the order of (doc_id, text digest), so that the least node is one of the least doc_id.
    d = docs.withColumns({"_ov_id": F.col("doc_id").cast("long"), "_ov_digest": digest})
    nodes = with_rank(d.select(F.col("_ov_id").alias("_ov_i"), F.col("_ov_digest").alias("_ov_d")).distinct(), [], [F.col("_ov_i").asc_nulls_last(), F.col("_ov_d")], rank="_ov_node")
    same = F.col("_ov_id").eqNullSafe(F.col("_ov_i")) & (F.col("_ov_digest") == F.col("_ov_d"))
    d = checkpointed(d.join(nodes, same).drop("_ov_i", "_ov_d", "_ov_id", "_ov_digest").withColumnRenamed("doc_id", "_ov_own").withColumnRenamed("_ov_node", "doc_id"))
    kept = near_duplicates(d.select("doc_id", "text"), **kw).filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_ov_n"))
    return _rows_of(d, checkpointed(kept)).drop("doc_id").withColumnRenamed("_ov_own", "doc_id").select(*docs.columns)


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of each kept doc_id; the rows of one have equal texts."""
    out = docs.join(kept.select(F.col("doc_id").alias("_ov_k")).hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_ov_k")), "left_semi")
    # Only repeated ids need their rows compared; with none, no shuffle of texts is spent on it.
    again = kept.filter("_ov_n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_ov_r"))
    if not again.take(1):
        return out
    # Rows that differ in other columns alone: the least hash of the whole row decides, the same in every run.
    twice = out.join(again, F.col("doc_id") == F.col("_ov_r"), "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*out.columns), F.struct(F.xxhash64(*out.columns))).alias("_ov_row")).select("_ov_row.*")
    return out.join(again, F.col("doc_id") == F.col("_ov_r"), "left_anti").unionByName(twice)


#: The same rows by all pairs that share a shingle, and what is reachable over their links.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT rid, count(*) AS k FROM g GROUP BY rid
), c AS (
  SELECT a.rid AS u, b.rid AS v, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
), l AS (
  SELECT u, v FROM c JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * m >= 75 * (x.k + y.k - m)
), e AS (
  SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), reach AS (
  SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.v FROM reach r JOIN e ON r.b = e.u
), least AS (
  SELECT a AS rid, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.rid = b GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN least USING (rid) LEFT JOIN n USING (rid)
"""
