"""Formulas against hand-made expectations."""

import math

import pytest
from pyspark.sql import functions as F

from overfly import constants as K
from overfly.functions import geo, text
from overfly.functions import vectors as V
from overfly.operators import bands, calibrate, fit, recall, sampling, spatial


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(*v):
    return [F.lit(float(x)) for x in v]


def test_haversine(spark):
    a, b = one(spark, geo.haversine_m(*lit(30, 115, 30.001, 115.001)), geo.haversine_m(*lit(30, 115, 30, 115)))
    assert a == pytest.approx(147.096744, abs=1e-5) and b == 0


def test_gsd_and_default_k(spark):
    a, b = one(spark, geo.metres_per_px(F.lit(400.0), geo.footprint_k(F.lit("05"))), geo.footprint_k(F.lit("77")))
    assert a == pytest.approx(0.11416015625) and b == pytest.approx(1.75 * 2 * math.tan(math.radians(35)))


def test_corrected_yaw(spark):
    got = one(spark, *[geo.corrected_yaw(F.lit("08"), F.lit(float(y))) for y in (112, -80, 179, -179, 13.65)], geo.corrected_yaw(F.lit("zz"), F.lit(5.0)))
    assert list(got) == pytest.approx([88.6, -65.8, 155.6, -202.4, -9.75, 5.0])


@pytest.mark.parametrize(("n", "want"), [(738, (184, 74, 37, 443)), (590, (148, 59, 30, 353)), (10, (2, 1, 0, 7)), (2, (0, 0, 0, 2)), (1, (0, 0, 0, 1))])
def test_band_sizes(spark, n, want):
    d = spark.range(n).select(F.lit("01").alias("flight"), F.col("id").cast("string").alias("filename"), (F.col("id") * 1e-4).alias("lat"), F.lit(1.0).alias("lon"))
    got = {r["band"]: r["count"] for r in bands.with_band(d).groupBy("band").count().collect()}
    assert tuple(got.get(b, 0) for b in ("test", "val", "buffer", "train")) == want


def test_test_band_ignores_other_fractions(spark):
    d = spark.range(200).select(F.lit("01").alias("flight"), F.col("id").cast("string").alias("filename"), (F.col("id") * 7 % 200).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    sets = [{r[0] for r in bands.with_band(d, val=v, buffer=b).filter("band = 'test'").select("filename").collect()} for v, b in ((0.1, 0.05), (0.0, 0.0))]
    assert sets[0] == sets[1] and len(sets[0]) == 50


def test_tile_grid(spark):
    m = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0, 2500.0, 1024.0)], "map_id long, lt_lat double, lt_lon double, rb_lat double, rb_lon double, w double, h double")
    assert [r["x0"] for r in spatial.tile_grid(m).orderBy("tile_id").collect()] == [0, 512, 1024, 1476]
    with pytest.raises(Exception, match="smaller than a tile"):
        spatial.tile_grid(m.withColumn("w", F.lit(500.0))).collect()


def test_recall_policies(spark):
    d = spark.createDataFrame([(0,), (3,), (-1,), (None,), (12,)], "rank int")
    got = {p: d.agg(*[recall.recall(F.col("rank"), k, p).alias(f"k{k}") for k in (1, 5, 10)]).first() for p in ("exclude", "miss", "legacy")}
    assert list(got["exclude"]) == pytest.approx([100 / 3, 200 / 3, 200 / 3], abs=1e-5)
    assert list(got["miss"]) == pytest.approx([20, 40, 40]) and list(got["legacy"]) == pytest.approx([40, 60, 60])


def test_track_direction(spark):
    d = spark.createDataFrame([("a", 0, 30.0, 115.0), ("a", 1, 30.001, 115.0), ("a", 2, 30.001, 115.002), ("b", 0, 1.0, 1.0)], "flight string, seq int, lat double, lon double")
    got = [(r["te"], r["tn"]) for r in calibrate.track_direction(d, ["flight"]).orderBy("flight", "seq").collect()]
    assert [x for p in got for x in p] == pytest.approx([0, 1, 1, 0, 1, 0, 0, 1])


@pytest.mark.parametrize(("n", "k", "want"), [(10, 4, [0, 3, 6, 9]), (6, 4, [0, 2, 3, 5]), (3, 4, [0, 1, 2])])
def test_even_sample(spark, n, k, want):
    d = spark.range(n).select(F.lit("a").alias("flight"), F.col("id").alias("seq"))
    assert sorted(r["seq"] for r in sampling.even(d, k).collect()) == want


def test_clean_and_words(spark):
    texts = ["<think>x\ny</think> Dark green fields, red roof , river .", "straight road, darker, farmland", "redness near tan hills", "green", "", "  a  b "]
    got = one(spark, *[text.clean(F.lit(t)) for t in texts[:4]], *[text.word_count(F.lit(t)) for t in texts[4:]])
    assert list(got) == ["fields roof, river.", "straight road farmland", "redness near hills", "", 0, 2]


def test_prior_offsets_follow_the_key(spark):
    d = spark.createDataFrame([("01/01_0001.JPG",)], "key string")
    r = fit.gaussian_offsets(d, F.col("key"), K.PRIOR_SIGMA_M).select(F.crc32("key").alias("c"), "dx_m", "dy_m").first()
    assert r["c"] == 316758053 and (r["dx_m"], r["dy_m"]) == pytest.approx((-43.36838803, 150.65266494))


def test_vectors(spark):
    a, z = F.array(*lit(3, 4)), F.array(*lit(0, 0))
    got = one(spark, V.normalise(a), V.normalise(z), V.cosine(a, a), V.ncc(a, F.array(*lit(1, 2))), V.ncc(a, F.array(*lit(2, 2))))
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0, 0] and got[2] == pytest.approx(1) and got[3] == pytest.approx(1) and got[4] is None


def test_season(spark):
    assert list(one(spark, *[geo.season(F.lit(x)) for x in ("2020-01-05T10:00", "2020-06-30", "junk")])) == ["winter", "summer", ""]


def test_radius_join_equals_all_pairs(spark):
    d = spark.range(300).select(F.col("id").alias("i"), (F.lit(30.0) + F.col("id") * 7919 % 1009 / 1e5).alias("a"), (F.lit(115.0) + F.col("id") * 104729 % 997 / 1e5).alias("b"))
    e = d.select(F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("e"))
    near = {(r["i"], r["j"]) for r in spatial.radius_join(d, e, ("a", "b"), ("c", "e"), 200.0).collect()}
    rows = d.collect()

    def hav(p, q):
        s = math.sin(math.radians(q["a"] - p["a"]) / 2) ** 2 + math.cos(math.radians(p["a"])) * math.cos(math.radians(q["a"])) * math.sin(math.radians(q["b"] - p["b"]) / 2) ** 2
        return 2 * K.EARTH_M * math.asin(math.sqrt(s))

    assert near == {(p["i"], q["i"]) for p in rows for q in rows if hav(p, q) <= 200}


def test_greedy_dedup_gives_unique_cells(spark):
    rows = [(1, float(i * 5 % 97), float(i * 3 % 89), float(i * 7 % 83), float(i * 11 % 79), (i * 13 % 17) / 17, i, 0, 0) for i in range(200)]
    d = spark.createDataFrame(rows, "pair long, x0 double, y0 double, x1 double, y1 double, conf double, k1 long, k2 long, k3 long")
    got = fit.greedy_one_to_one(d).collect()
    for u, v in (("x0", "y0"), ("x1", "y1")):
        assert len({(r[u] // 8, r[v] // 8) for r in got}) == len(got)


def test_ransac_recovers_a_similarity(spark):
    rows = []
    for i in range(60):
        x, y = float(i * 37 % 101), float(i * 53 % 103)
        u, v = (0.8 * x - 0.1 * y + 5, 0.1 * x + 0.8 * y - 3) if i % 4 else (900.0 + i, -700.0 + 3 * i)
        rows.append((7, x, y, u, v, 1.0, i, 0, 0))
    d = spark.createDataFrame(rows, "pair long, x0 double, y0 double, x1 double, y1 double, conf double, k1 long, k2 long, k3 long")
    r = fit.ransac_similarity(d).first()
    assert r["inliers"] == 45 and (r["a"], r["b"], r["tx"], r["ty"]) == pytest.approx((0.8, 0.1, 5, -3))
    w = fit.weighted_similarity(d.filter("k1 % 4 <> 0"), ["pair"], F.lit(1.0)).first()
    assert (w["a"], w["b"], w["tx"], w["ty"]) == pytest.approx((0.8, 0.1, 5, -3))


def test_prior_moves_north_and_east(spark):
    """100 m east and 200 m north of (30, 115): 200/111320 degrees up, 100/(111320 cos 30) to the right."""
    la, lo = one(spark, *geo.shifted_gps(*lit(30, 115, 100, 200)))
    assert la == pytest.approx(30.00179662, abs=1e-8) and lo == pytest.approx(115.00103728, abs=1e-8)


def test_prior_in_pixels_goes_by_the_maps_middle(spark, monkeypatch):
    """A map from 60 to 20 degrees north: metres east become pixels at 40 degrees, wherever the frame is."""
    from overfly.plans import geometry as G

    frame = spark.createDataFrame([("01", "a", 7, 25.0, 115.5, 400.0, 0.0)], "flight string, filename string, seq long, lat double, lon double, height double, phi1 double")
    m = spark.createDataFrame([(0, 60.0, 115.0, 20.0, 116.0, 1000.0, 4000.0)], "map_id long, lt_lat double, lt_lon double, rb_lat double, rb_lon double, w double, h double")
    monkeypatch.setattr(G, "frames", lambda *a: frame)
    monkeypatch.setattr(G, "maps", lambda *a: m)
    r = G.shifted(spark, "").first()
    # dx = 7*13 % 161 - 80 = 11 m at 1000 px a degree; dy = 7*29 % 161 - 80 = -38 m at 100 px a degree.
    assert r["cx"] - r["px"] == pytest.approx(11 * 1000 / (111320 * math.cos(math.radians(40)))) and r["cy"] - r["py"] == pytest.approx(-38 * 100 / 111320)


def test_spread_choice_takes_the_earlier_of_equally_near_frames(spark):
    d = spark.createDataFrame([("a", i, i not in (5, 15)) for i in range(20)], "flight string, seq long, accepted boolean")
    got = [(r["slot"], r["seq"]) for r in fit.spread_choice(d, 2).orderBy("slot").collect()]
    assert got == [(0, 4), (1, 14)]
    few = spark.createDataFrame([("a", i, i in (1, 2)) for i in range(6)], "flight string, seq long, accepted boolean")
    assert [r["seq"] for r in fit.spread_choice(few, 4).orderBy("slot").collect()] == [1, 2]


def test_homography_consensus(spark):
    """Planted: 60 points through a transform with perspective, 20 elsewhere; the most confident inliers are kept."""
    h = [0.9, -0.1, 20.0, 0.12, 1.1, -15.0, 1e-4, -5e-5, 1.0]
    rows = []
    for i in range(80):
        x, y = float(i * 37 % 1009), float(i * 53 % 677)
        w = h[6] * x + h[7] * y + 1
        u, v = ((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w) if i % 4 else (float(i * 71 % 900), float(i * 91 % 600))
        rows.append((3, x, y, u, v, (i * 7 % 80) / 80, i, 0, 0))
    rows += [(4, 1.0, 2.0, 3.0, 4.0, 1.0, i, 0, 0) for i in range(3)] + [(5, 1.0, 2.0, 3.0, 4.0, 1.0, i, 0, 0) for i in range(9)]
    d = spark.createDataFrame(rows, "pair long, x0 double, y0 double, x1 double, y1 double, conf double, k1 long, k2 long, k3 long")
    got = fit.ransac_homography(d.repartition(3)).collect()
    assert {r["pair"] for r in got} == {3} and {r["k1"] for r in got} >= {i for i in range(80) if i % 4} and len(got) <= 62
    assert got[0]["h"] == pytest.approx(h, abs=1e-4)
    best = fit.ransac_homography(d, most=10).collect()
    inl = sorted(((-r["conf"], r["k1"]) for r in got))[:10]
    assert sorted((-r["conf"], r["k1"]) for r in best) == inl


def test_loop_back(spark):
    """A shift by one cell: cells come back unless they leave the real frame or land on cell 0's place."""
    shift = [F.lit(float(v)) for v in (1, 0, 8, 0, 1, 0, 0, 0, 1)]
    got = fit.looped_back(spark.range(1), shift, geo.inverse(shift), 32, 32, 8, (32, 24)).orderBy("i").collect()
    assert [(r["i"], r["j"]) for r in got] == [(r * 4 + c, r * 4 + c + 1) for r in range(3) for c in range(3) if (r, c) != (0, 0)]


def test_crop_offsets(spark):
    """Modes by zlib's CRC-32, offsets by NumPy's generator, shortened to the crop."""
    import zlib

    import numpy as np

    names = [f"01_{i:04d}.JPG" for i in range(60)]
    d = spark.createDataFrame([("01", n) for n in names], "flight string, filename string")
    got = {r["filename"]: r for r in fit.crop_offsets(d, "mix", 30, 80.0, F.lit(0.4), 40.0, 680.0).collect()}
    seen = set()
    for n in names:
        true = zlib.crc32(f"mix/01/{n}".encode()) % 100 < 30
        x, y = (0.0, 0.0) if true else np.random.default_rng(zlib.crc32(f"01/{n}".encode())).normal(0.0, 80.0, 2)
        s = min(1.0, 120.0 / max(math.hypot(x, y), 1e-9))
        assert got[n]["mode"] == ("true" if true else "jitter") and (got[n]["dx_m"], got[n]["dy_m"]) == pytest.approx((x * s, y * s))
        seen.add((true, s < 1))
    assert {(True, False), (False, True), (False, False)} <= seen
    assert {r["mode"] for r in fit.crop_offsets(d, "jitter", 30, 80.0, F.lit(0.4), 40.0, 680.0).collect()} == {"jitter"}


def test_radius_join_at_high_latitudes_and_over_the_date_line(spark):
    pts = [(i, 80 + i * 0.001, 20 + i * 0.01) for i in range(40)] + [(100, 10.0, 179.999), (101, 10.0, -179.999), (102, 89.9995, 0.0), (103, 89.9995, 180.0)]
    d = spark.createDataFrame(pts, "i long, a double, b double")
    e = d.select(F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("e"))

    def hav(p, q):
        s = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * K.EARTH_M * math.asin(math.sqrt(s))

    got = {(r["i"], r["j"]) for r in spatial.radius_join(d, e, ("a", "b"), ("c", "e"), 700.0).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if hav(p, q) <= 700}
    assert {(100, 101), (102, 103)} <= got


def test_ranked_equals_a_window(spark):
    """Places and running sums of groups of very different sizes, a null group among them."""
    from overfly.operators.store import ranked

    rows = [(("a" if i % 3 else "b") if i % 50 else None, i * 7919 % 2003, i % 5) for i in range(2003)]
    d = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = {(r["g"], r["o"]): (r["r"], r["s"]) for r in ranked(d, ["g"], [F.col("o")], "r", {"s": F.col("v")}).collect()}
    want = {}
    for g in ("a", "b", None):
        total = 0
        for k, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            total += v
            want[(g, o)] = (k, total)
    assert got == want
    assert ranked(d.limit(0), ["g"], [F.col("o")], "r").count() == 0


def test_steps_of_the_loop_are_written_once(spark):
    """The plan holds each transform once a row, not once for every use of a cell."""
    from overfly import registry

    plan = registry.queries()["loopback_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COS(") <= 60, plan.count("COS(")


def test_bands_deal_no_flight_to_one_task(spark):
    from overfly.operators.bands import with_band

    d = spark.range(300).selectExpr("CAST(id % 2 AS STRING) AS flight", "CAST(id AS STRING) AS filename", "id * 0.1 AS lat", "id * 0.2 AS lon")
    plan = with_band(d)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "SortMergeJoin" not in plan.split("Window")[0]
    assert dict(with_band(d).groupBy("band").count().collect()) == {"test": 76, "val": 30, "buffer": 16, "train": 178}
