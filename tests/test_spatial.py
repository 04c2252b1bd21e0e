"""Maps for points, neighbours along a track and quantiles, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from overfly.operators import spatial

MAP = "map_id long, lt_lat double, lt_lon double, rb_lat double, rb_lon double, w double, h double"


def brute(maps, lat, lon):
    x = (lon - maps[:, 2]) * (maps[:, 5] / (maps[:, 4] - maps[:, 2]))
    y = (maps[:, 1] - lat) * (maps[:, 6] / (maps[:, 1] - maps[:, 3]))
    w, h = maps[:, 5], maps[:, 6]
    hit = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    over = np.maximum(0, -x) + np.maximum(0, x - w) + np.maximum(0, -y) + np.maximum(0, y - h)
    best = min(range(len(maps)), key=lambda i: (not hit[i], 0.0 if hit[i] else over[i], maps[i, 0]))
    return int(maps[best, 0]), bool(hit[best])


@pytest.mark.parametrize("n", [1, 300, 100_000])
def test_map_for_point_equals_brute_force_for_any_number_of_maps(spark, n):
    r = np.random.default_rng(n)
    size = 10.0 ** r.uniform(-3, -1, n)
    lat, lon = r.uniform(-60, 60, n), r.uniform(-170, 170, n)
    if n > 1:
        lat[: n // 2], lon[: n // 2] = r.uniform(30, 31, n // 2), r.uniform(115, 116, n // 2)
    w = r.integers(100, 5000, n).astype(float)
    maps = np.stack([np.arange(n), lat + size, lon, lat, lon + size * r.uniform(0.5, 2, n), w, w * 2], 1)
    d = spark.createDataFrame([(int(m[0]), *map(float, m[1:])) for m in maps], MAP)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(29.9, 31.1, 150), r.uniform(114.9, 116.1, 150)))]
    points += [(900, -89.0, 179.0), (901, float(maps[0, 1]), float(maps[0, 2])), (902, float(maps[0, 3]), float(maps[0, 4]))]
    p = spark.createDataFrame([*points, (903, None, 1.0), (904, float("nan"), 1.0)], "id long, lat double, lon double")
    got = {x["id"]: x for x in spatial.map_for_point(p, d).collect()}
    assert len(got) == 155 and all(got[i]["map_id"] is None and got[i]["in_bounds"] is False for i in (903, 904))
    for i, a, b in points:
        assert (got[i]["map_id"], got[i]["in_bounds"]) == brute(maps, a, b), (i, a, b)
        assert 0 <= got[i]["px"] < got[i]["w"] and 0 <= got[i]["py"] < got[i]["h"]


def test_no_maps_and_no_points(spark):
    d = spark.createDataFrame([(1, 31.0, 115.0, 30.0, 116.0, 10.0, 10.0)], MAP)
    p = spark.createDataFrame([(1, 30.5, 115.5)], "id long, lat double, lon double")
    x = spatial.map_for_point(p, d.filter("false")).first()
    assert x["map_id"] is None and x["in_bounds"] is False
    assert spatial.map_for_point(p.filter("false"), d).count() == 0


@pytest.mark.parametrize("limit, cuts", [(1 << 17, 256), (10, 8)])
def test_exact_quantiles_whatever_a_task_may_gather(spark, limit, cuts):
    from overfly.operators import quantiles

    r = np.random.default_rng(limit)
    groups = {
        "ties": [5.0] * 300 + [7.0] * 10 + [1.0], "even": list(map(float, range(100))), "one": [3.5], "wide": [*map(float, 10.0 ** r.uniform(-300, 300, 150)), -1e308, 1e308],
        "near": [1.0 + i * 2e-16 for i in range(90)], None: [float(x) for x in r.normal(size=200)], "none": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None, float("nan")]]
    d = spark.createDataFrame(rows, "g string, v double").repartition(4)
    v = F.col("v")
    wanted = {"q0": (v, 0.0), "q25": (v, 0.25), "med": (v, 0.5), "q9": (v, 0.9), "q1": (v, 1.0), "neg": (-v, 0.5)}
    got = {x["g"]: x for x in quantiles.exact(d, ["g"], wanted, limit, cuts).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, x in got.items():
        for name, q in (("q0", 0.0), ("q25", 0.25), ("med", 0.5), ("q9", 0.9), ("q1", 1.0)):
            assert x[name] == pytest.approx(np.quantile(groups[g], q), rel=1e-12), (g, name)
        assert x["neg"] == pytest.approx(-np.quantile(groups[g], 0.5), rel=1e-12)


def planned(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_dealt_out_by_cell_and_meet_once(spark):
    """Neither side of a pair join is collected for a broadcast, whose tasks would be those that read the other side; five copies of a row do, not nine."""
    from overfly import registry

    plan = planned(registry.queries()["neg_mask_pairs"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    copies = next(x for x in plan.splitlines() if "explode(" in x)
    assert copies.count("struct(a") == 5
    d = spark.range(10).selectExpr("id AS i", "30.0 + id / 1e5 AS lat", "115.0 AS lon")
    e = d.toDF("j", "lat2", "lon2")
    assert "Broadcast" not in planned(spatial.radius_join(d, e, ("lat", "lon"), ("lat2", "lon2"), 50.0))


def haversine(p, q):
    a, b, c, d = np.radians([p[2], p[3], q[2], q[3]])
    return 2 * 6_371_000.0 * np.arcsin(np.sqrt(min(1.0, np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2)))


@pytest.mark.parametrize("radius, north, columns", [(300.0, 31.0, 1000), (700.0, 90.0, 1), (65 * 110_540.0, 0.0, 2), (55 * 110_540.0, 0.0, 3), (2e7, 0.0, 1)])
def test_pairs_of_one_table_equal_brute_force_for_any_number_of_columns(spark, radius, north, columns):
    r = np.random.default_rng(int(radius))
    if radius < 1000:
        places = [(30 + float(x), 115 + float(y)) for x, y in r.uniform(0, 0.02, (150, 2))] + [(30.0, 179.9995), (30.0, -179.9995), (30.0, -180.0)]
        places += [(89.9995, 0.0), (89.9995, 180.0), (-89.9995, 90.0)] if north == 90 else []
    else:
        places = [(0.0, float(y)) for y in r.uniform(-180, 180, 90)] + [(0.0, 180.0), (0.0, -180.0)]
    rows = [(i, "a" if i % 3 else "b", *p) for i, p in enumerate(places)]
    # Equal places, equal numbers, no key, no place.
    rows += [(900, "a", *places[1]), (901, "a", *places[1]), (901, "a", *places[1]), (902, None, *places[1]), (903, "a", None, None), (None, "a", *places[1])]
    around = round(360 / spatial.cell_size(radius * 1.0001, max(abs(p[0]) for p in places))[1])
    assert around >= columns if columns == 1000 else around == columns
    d = spark.createDataFrame(rows, "a long, flight string, b double, c double").repartition(5)
    got = sorted((x["a"], x["b"]) for x in spatial.radius_pairs(d, "a", ("b", "c"), radius, keys=("flight",)).collect())
    whole = [x for x in rows if None not in x]
    want = sorted((p[0], q[0]) for p in whole for q in whole if p[0] != q[0] and p[1] == q[1] and haversine(p, q) <= radius)
    assert got == want and len(want) > 200


def test_quantiles_neither_shuffle_nor_sketch_the_rows(spark, monkeypatch):
    """Passes add up counts and meet few intervals by broadcast; rows are not dealt out by group, and no sketch is made of them."""
    from overfly.operators import quantiles

    monkeypatch.setattr(quantiles.F, "percentile_approx", None)
    d = spark.range(2000).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v")
    got = quantiles.exact(d, ["g"], {"med": (F.col("v"), 0.5)}, limit=10)
    assert "BroadcastHashJoin" in planned(got) and "SortMergeJoin" not in planned(got)
    assert sorted(map(tuple, got.collect())) == [(0, 999.0), (1, 1000.0)]


def test_size_bins_keep_the_order(spark):
    from overfly.operators import quantiles

    r = np.random.default_rng(1)
    v = np.concatenate([10.0 ** r.uniform(-320, 308, 500), np.nextafter(np.exp(np.arange(-700, 700, 7.0)), 0), np.exp(np.arange(-700, 700, 7.0)), [0.0, 5e-324, 1.7976931348623157e308, np.inf]])
    v = np.sort(np.concatenate([v, -v]))
    bins = [x[0] for x in spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").orderBy("i").select(quantiles._size_bin(F.col("v"))).collect()]
    assert None not in bins and bins == sorted(bins) and bins[0] < bins[1] and bins[-1] > bins[-3]


def test_tracks_of_any_length_know_their_neighbours(spark):
    from overfly.operators.store import with_neighbours

    rows = [(g, i * 3, float(i)) for g, n in (("a", 500), ("b", 1), (None, 40), ("c", 2)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, at long, v double").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x = with_neighbours(d, ["g"], ["at"], ["v"])
        assert x.select("g", F.spark_partition_id().alias("p")).filter("g = 'a'").distinct().count() > 5
        size = {"a": 500, "b": 1, None: 40, "c": 2}
        got = x.collect()
        assert len(got) == 543
        for r in got:
            assert (r["before"]["v"] if r["before"] else None) == (r["v"] - 1 if r["v"] else None)
            assert (r["after"]["v"] if r["after"] else None) == (r["v"] + 1 if r["v"] < size[r["g"]] - 1 else None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
