"""Similarity and Hamming search against brute force: both ways of meeting, copies, odd rows, groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from overfly.functions import vectors as V
from overfly.operators import consensus, fit, hamming, knn


@pytest.fixture(scope="module")
def sides(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(400, 8)), 3)
    x[100:140] = x[7]
    rows = [(i, [float(v) for v in x[i]], i % 5, 30.0 + i % 20 / 1000, 115.0 + i % 17 / 1000) for i in range(400)]
    odd = [(1000, None, 0, 30.0, 115.0), (1001, [1.0], 0, 30.0, 115.0), (1002, [None] * 8, 0, 30.0, 115.0), (1003, [float("nan")] * 8, 0, 30.0, 115.0), (1004, [], 0, 30.0, 115.0)]
    g = spark.createDataFrame(rows + odd, "tile_id long, emb array<double>, label long, lat double, lon double").repartition(4).cache()
    q = g.filter("tile_id % 4 = 0").select(F.col("tile_id").alias("query_id"), F.col("emb").alias("qemb"), F.col("label").alias("qlabel"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    return g, q, x


def rows(d):
    return sorted(map(tuple, d.collect()))


@pytest.mark.parametrize("block", [None, 2000])
def test_top_k_equals_brute_force_whatever_the_blocks(sides, block):
    g, q, x = sides
    s = np.round(x @ x.T, 6)
    want = []
    for i in range(0, 400, 4):
        best = sorted(((-s[i, j], j) for j in range(400) if j != i))[:3]
        want += [(i, j, -v, r + 1) for r, (v, j) in enumerate(best)]
    assert rows(knn.top_k(g, q, 3, block_bytes=block)) == sorted(want)


def test_grid_of_blocks_gives_the_same(sides):
    g, q, _ = sides
    truth = q.select("query_id", F.pmod(F.col("query_id") + 4, F.lit(400)).alias("gt_id")).filter("query_id < 400")
    for f in (
        lambda b: knn.truth_ranks(g, q, truth, (500, 2000), block_bytes=b),
        lambda b: knn.histogram(g, q, 12, block_bytes=b),
        lambda b: knn.mutual(g, q, block_bytes=b),
    ):
        assert rows(f(None)) == rows(f(1500))


def test_tiles_are_bounded_and_nothing_goes_through_the_driver(spark):
    """60,000 queries are met a tile at a time; past one block no frame is collected."""
    q = spark.range(60_000).select(F.col("id").alias("query_id"), F.array(F.col("id") % 7 * 1.0, F.lit(1.0)).alias("qemb"))
    g = spark.range(50).select(F.col("id").alias("tile_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("emb"))
    seen = spark.sparkContext.accumulator(0)

    def task(asked, tiles):
        import numpy as np

        out = np.zeros(len(asked["query_id"]), np.int64)
        for at, b in tiles:
            assert at.stop - at.start <= 1024 and len(b["tile_id"]) <= 1024
            out[at] += len(b["tile_id"])
        seen.add(1)
        return asked["query_id"], out

    met = lambda b: knn.against(g, q, task, "query_id long, n long", lambda d: d.groupBy("query_id").agg(F.sum("n").alias("n")), b)
    assert met(None).filter("n <> 50").count() == 0
    collected = type(q).toArrow
    frame = type(q)
    grid = met(1 << 17)
    try:
        frame.toArrow = lambda self: pytest.fail("a frame was collected")
        assert grid.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()[:] == (60_000, 50, 50)
    finally:
        frame.toArrow = collected


def test_empty_sides(spark, sides):
    g, q, _ = sides
    assert knn.top_k(g.filter("false"), q, 3).count() == 0 and knn.top_k(g, q.filter("false"), 3).count() == 0
    assert knn.mutual(g, q.filter("false")).count() == 0


def codes(seed=2, n=300, words=2):
    """Random codes, near copies, 80 exact copies of one, and codes that cannot take part."""
    r = random.Random(seed)
    base = [[r.getrandbits(64) - (1 << 63) for _ in range(words)] for _ in range(n)]
    for i in range(0, 60, 3):
        base[i + 1] = [w ^ (1 << r.randrange(60)) for w in base[i]]
    for i in range(200, 280):
        base[i] = base[5]
    out = [(i, c, ("a", "b", None)[i % 3]) for i, c in enumerate(base)]
    return out, [(900, None, "a"), (901, [1], "a"), (902, [None, 1], "b"), (None, [1, 2], "a")]


def brute(rows, asked, k, grouped):
    out = []
    for q, c, g in asked:
        d = sorted((sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(c, o)), i) for i, o, h in rows if i != q and (not grouped or g == h))
        out += [(q, i, n, r + 1) for r, (n, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, grouped, block", [(2, False, None), (2, True, None), (3, False, 4000)])
def test_hamming_equals_brute_force(spark, k, grouped, block):
    good, odd = codes()
    d = spark.createDataFrame(good + odd, "id long, code array<long>, pair string").repartition(3)
    q = d.filter("id % 2 = 0 OR id IS NULL").withColumnRenamed("id", "query_id")
    got = hamming.nearest(d, q, k, within="pair" if grouped else None, words=2, block_bytes=block)
    assert sorted((r["query_id"], r["id"], r["dist"], r["rk"]) for r in got.collect()) == brute(good, [g for g in good if g[0] % 2 == 0], k, grouped)


def test_hamming_near_codes_need_no_scan(spark, monkeypatch):
    """Where every query has near codes the look-ups settle all: the comparison with all codes is not reached."""
    r = random.Random(4)
    rows = []
    for i in range(0, 1200, 3):
        c = r.getrandbits(63)
        rows += [(i, [c]), (i + 1, [c ^ 1]), (i + 2, [c ^ 6])]
    d = spark.createDataFrame(rows, "id long, code array<long>")
    monkeypatch.setattr(hamming, "_scanned", lambda *a: pytest.fail("scanned"))
    got = {(x["query_id"], x["rk"]): x["dist"] for x in hamming.nearest(d, d.withColumnRenamed("id", "query_id")).collect()}
    assert len(got) == 2400 and all(got[i, 1] == 1 and got[i, 2] == 2 for i in range(0, 1200, 3))


def test_hamming_edges_and_packing(spark):
    d = spark.createDataFrame([(1, [3]), (2, [3])], "id long, code array<long>")
    q = d.withColumnRenamed("id", "query_id")
    assert rows(hamming.nearest(d, q)) == [(1, 2, 0, 1), (2, 1, 0, 1)]
    assert hamming.nearest(d.filter("false"), q).count() == 0 and hamming.nearest(d, q.filter("false")).count() == 0
    assert hamming.ratio(hamming.nearest(d, q), 0.75).count() == 0
    bits = [True, False, None] + [False] * 60 + [True, True]
    x = spark.createDataFrame([(bits,)], "b array<boolean>").select(hamming.packed(F.col("b")).alias("w")).first()["w"]
    assert x == [1 - (1 << 63), 1]


def test_vector_rows_cost_in_proportion_to_their_length(spark):
    """Eight times the numbers may cost twenty times at most (squares would be 64)."""
    import time

    def seconds(n, count):
        d = spark.range(count).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i + F.col("id"))).alias("a")).withColumn("b", F.reverse("a"))
        d = d.select(F.sum(V.ncc(F.col("a"), V.fuse(F.col("a"), F.col("b"), F.lit(0.8)))), F.sum(V.cosine(F.col("a"), V.fuse(F.col("a"), F.col("b"), F.lit(0.5)))))
        d.collect()
        t = time.time()
        d.collect()
        return time.time() - t

    assert seconds(512, 400) < 20 * max(seconds(64, 400), 0.05)


def planted(r, n, share, transform):
    """Correspondences of which ``share`` follow ``transform``, the better in confidence by and large, with half a pixel of noise."""
    p, k = r.uniform(0, 1000, (n, 2)), int(n * share)
    q = r.uniform(0, 1000, (n, 2))
    q[:k] = transform(p[:k]) + r.normal(0, 0.5, (k, 2))
    conf = np.clip(r.normal(np.where(np.arange(n) < k, 0.65, 0.4), 0.15), 0, 1)
    order = np.argsort(-conf, kind="stable")
    return p[order], q[order], conf[order], order < k


def projective(h):
    def f(p):
        w = p @ h[6:8] + 1
        return np.stack([p @ h[0:2] + h[2], p @ h[3:5] + h[5]], 1) / w[:, None]

    return f


def test_planted_pairs_of_fifteen_percent_inliers_are_solved():
    r = np.random.default_rng(8)
    solved = {"homography": 0, "similarity": 0}
    for i in range(100):
        h = np.array([0.9, 0.2, 30, -0.15, 1.1, 20, 1e-4, -5e-5]) * (1 + r.normal(0, 0.05, 8))
        p, q, _, true = planted(r, 200, 0.15, projective(h))
        _, inl, used = consensus.homography(p, q, 5.0, i)
        solved["homography"] += (inl & true).sum() >= 0.9 * true.sum()
        assert used <= consensus.MOST
        s = lambda x: x @ np.array([[0.8, 0.3], [-0.3, 0.8]]) + [40, -25]
        p, q, _, true = planted(r, 200, 0.15, s)
        m, inl, _ = consensus.similarity(p, q, 5.0, i)
        solved["similarity"] += (inl & true).sum() >= 0.95 * true.sum() and abs(m[0] - 0.8) < 0.02 and abs(m[1] - 0.3) < 0.02
    assert solved["homography"] >= 99 and solved["similarity"] >= 99


def test_search_stops_early_on_good_points_and_widens_its_pool():
    r = np.random.default_rng(3)
    p, q, _, _ = planted(r, 300, 0.9, lambda x: x + 5)
    assert consensus.similarity(p, q, 5.0, 1)[2] == consensus.BATCH
    pools = consensus.pool_sizes(300, 4, 5000)
    assert pools[0] == 4 and pools[-1] > 290 and (np.diff(pools) >= 0).all()
    s = consensus.draw(r, pools, 300, 4)
    assert all(len(set(x)) == 4 for x in s.tolist()) and (s.max(axis=1) < pools).all()


def test_consensus_is_the_same_in_any_partitioning(spark):
    r = np.random.default_rng(6)
    rows = []
    for pair in range(6):
        p, q, conf, _ = planted(r, 120, 0.4, lambda x: x * 1.1 + [3, 4])
        rows += [(pair, *map(float, (*p[i], *q[i])), float(conf[i]), i, 0, 0) for i in range(120)]
    rows += [(7, 1.0, None, 2.0, 2.0, 0.5, 1, 0, 0), (8, 1.0, 1.0, 2.0, 2.0, None, 1, 0, 0)]
    d = spark.createDataFrame(rows, "pair long, x0 double, y0 double, x1 double, y1 double, conf double, k1 long, k2 long, k3 long")
    a, b = (sorted(map(tuple, fit.ransac_similarity(d.repartition(k, "k1")).collect())) for k in (1, 7))
    assert a == b and [x[2] >= 48 for x in a] == [True] * 6 + [False]
    a, b = (sorted(map(str, fit.ransac_homography(d.repartition(k, "k1")).collect())) for k in (1, 7))
    assert a == b and len(a) >= 6 * 48


def test_rough_scores_leave_consensus_as_it_is(monkeypatch):
    """Scoring only models that may win gives the same transform, bit by bit, and scores few models exactly."""
    from overfly.operators import consensus

    plain, scored = consensus.search, []
    for seed in range(4):
        r = np.random.default_rng(seed)
        p = r.uniform(0, 1000, (300, 2))
        q = r.uniform(0, 1000, (300, 2))
        q[:45] = p[:45] * 1.1 + 3 + r.normal(0, 0.5, (45, 2))

        def counting(n, m, solve, residuals, *rest):
            return plain(n, m, solve, lambda h: scored.append(len(h)) or residuals(h), *rest)

        scored.clear()
        monkeypatch.setattr(consensus, "search", counting)
        h, inliers, used = consensus.homography(p, q, 5.0, seed)
        assert sum(scored) < used / 2
        monkeypatch.setattr(consensus, "search", lambda *a: plain(*a[:10]))
        again = consensus.homography(p, q, 5.0, seed)
        assert np.array_equal(h, again[0]) and np.array_equal(inliers, again[1]) and used == again[2]


@pytest.mark.parametrize("hot", [False, True])
def test_hamming_lookups_stay_in_proportion_to_the_index(spark, monkeypatch, hot):
    """Queries whose look-ups, or what these would meet, outnumber the index are compared in blocks instead; results are the same."""
    r = np.random.default_rng(3)
    codes = r.integers(-(1 << 63), (1 << 63) - 1, 4000)
    if hot:
        codes = codes & ~0xFFFF_FFFF
    g = spark.createDataFrame([(i, [int(c)]) for i, c in enumerate(codes)], "id long, code array<long>")
    radii, around = [], hamming.Parts.around
    monkeypatch.setattr(hamming.Parts, "around", lambda self, code, j, s: radii.append(s) or around(self, code, j, s))
    got = hamming.nearest(g, g.filter("id % 10 = 0").withColumnRenamed("id", "query_id"))
    found = {(x["query_id"], x["rk"]): (x["dist"], x["id"]) for x in got.collect()}
    assert max(radii) <= 1
    for q in range(0, 4000, 10):
        d = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).astype(int)
        best = sorted((d[i], i) for i in range(4000) if i != q)[:2]
        assert [found[q, 1], found[q, 2]] == best
