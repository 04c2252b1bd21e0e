"""Every registered query of the engine against its DuckDB SQL, at the smallest scale."""

import hashlib
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from overfly import registry
from overfly.operators import accuracy as A
from overfly.plans.views import match_results

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in cols) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    want = ordered([tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)


def test_accuracy_rises_with_the_threshold(spark):
    r = A.accuracy(A.scored(match_results(spark, DATA)), ["method", "flight"]).collect()
    assert all(x["a5"] <= x["a10"] <= x["a15"] <= x["a20"] <= x["a25"] <= x["a30"] for x in r)


def test_box_stats_leaves_rows_where_they_lie(spark):
    """Quartiles go to the rows; no task gets all rows of a method."""
    plan = registry.queries()["box_stats"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_stream_equals_batch(spark, tmp_path):
    from overfly.streaming import running

    rows = A.scored(match_results(spark, DATA)).select("method", "flight", "filename", "skipped", "offset_m")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running.accuracy_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "cp"), "acc_stream")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("acc_stream").collect())) == sorted(map(tuple, running.accuracy_batch(rows).collect()))


def test_sources(spark, tmp_path):
    from overfly.sources import readers

    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "7.csv").write_text("filename,lat,lon,height,Phi1,date\na.JPG,30.5,115.5,400,,2020-01-01T00\nb.JPG,30.6,115.6,x,12,\n")
    r = readers.frame_csv(spark, str(tmp_path / "7" / "7.csv")).orderBy("seq").collect()
    assert [(x["flight"], x["filename"], x["height"], x["Phi1"]) for x in r] == [("07", "a.JPG", 400.0, 0.0), ("07", "b.JPG", None, 12.0)]
    at = readers.flight_paths("07", "data/")
    assert (at["map"], at["frames"], at["images"]) == ("data/07/satellite07.tif", "data/07/07.csv", "data/07/drone") and at["corners"].startswith("data/satellite_")
    (tmp_path / "m.csv").write_text("mapname,LT_lat_map,LT_lon_map,RB_lat_map,RB_lon_map,region,w,h\na.tif,2,1,1,2,r,10,20\n")
    with pytest.raises(KeyError):
        readers.map_csv(spark, str(tmp_path / "m.csv"), "b.tif")
    (tmp_path / "c.jsonl").write_text('{"flight":"01","filename":"a","caption":"x"}\nnot json\n{"flight":"01","filename":"a","caption":"y"}\n')
    assert [x["caption"] for x in readers.caption_json(spark, str(tmp_path / "c.jsonl")).collect()] == ["y"]
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    for kind in ("parquet", "json", "csv"):
        at = str(tmp_path / f"out_{kind}")
        assert readers.append_new(spark, new, at, ["k"], kind) == 3
        assert readers.append_new(spark, new.union(spark.createDataFrame([(3, "e")], "k int, v string")), at, ["k"], kind) == 1
        rows = spark.read.schema("k int, v string").options(header=kind == "csv").format(kind).load(at).collect()
        assert sorted((r["k"] or 0) for r in rows) == [0, 1, 2, 3]


def test_file_order_over_splits(spark, tmp_path):
    """Rows keep their file's order where files are cut into many splits; the later file and line win."""
    from overfly.sources import readers

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for f in ("01", "02"):
            (tmp_path / f).mkdir()
            (tmp_path / f / f"{f}.csv").write_text("filename,lat,lon,height,Phi1,date\n" + "".join(f"{f}_{i:04d}.JPG,{i},1,1,1,\n" for i in range(700)))
        d = readers.frame_csv(spark, str(tmp_path / "*" / "*.csv"))
        assert d.rdd.getNumPartitions() > 4
        got = d.collect()
        assert len(got) == 1400 and all(r["seq"] == r["lat"] and r["filename"] == f"{r['flight']}_{r['seq']:04d}.JPG" for r in got)
        for name in ("a", "b"):
            (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"flight":"01","filename":"x{i % 50}","caption":"{name}{i:04d}"}}\n' for i in range(400)))
        last = {r["filename"]: r["caption"] for r in readers.caption_json(spark, str(tmp_path / "*.jsonl")).collect()}
        assert last == {f"x{k}": f"b{350 + k:04d}" for k in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_guard_staging_registry_and_merge(spark, tmp_path):
    from overfly.sources import readers

    ok = spark.createDataFrame([(1, 1.75), (2, 1.75)], "i int, sf double")
    assert readers.guarded(ok, "sf", 1.75, "search factor").count() == 2
    for bad in (1.5, None):
        with pytest.raises(Exception, match="stale search factor"):
            readers.guarded(ok.union(spark.createDataFrame([(3, bad)], "i int, sf double")), "sf", 1.75, "search factor").collect()
    tars = [
        ("t/zz_5_lg.tar", ["visloc_lg_results.csv", "log"]), ("t/zz_9_lg.tar", ["a/visloc_lg_results.csv"]), ("t/zz_7_el.tar", ["visloc_el_ft_results.csv"]), ("t/zz_8_el.tar", ["visloc_other_results.csv"]),
        ("t/zz_6_two.tar", ["visloc_a_results.csv", "visloc_b_results.csv"]), ("t/odd.tar", ["visloc_q_results.csv"]), ("t/zz_4_none.tar", ["log"]),
    ]
    got = {r["variant"]: (r["job"], r["member"]) for r in readers.staged(spark.createDataFrame(tars, "path string, members array<string>")).collect()}
    assert got == {"lg": (9, "a/visloc_lg_results.csv"), "el_ft": (7, "visloc_el_ft_results.csv"), "el": (8, "visloc_other_results.csv")}
    reg = spark.createDataFrame([("a", "A", "full"), ("b", "B", "test"), ("c", "C", "full")], "method string, label string, band string")
    res = spark.createDataFrame([(m, "01", f, None, True) for m in "ab" for f in "xyz"] + [("a", "01", "w", True, True), ("b", "01", "x", None, False)], "method string, flight string, filename string, skipped boolean, gt_in_patch boolean")
    band = spark.createDataFrame([("01", "x", "test"), ("01", "y", "train"), ("01", "z", "test"), ("01", "w", "test")], "flight string, filename string, band string")
    rows = readers.registered(reg, res, band).collect()
    assert sorted((r["label"], r["filename"] or "", r["missing"]) for r in rows) == [("A", "x", False), ("A", "y", False), ("A", "z", False), ("B", "x", False), ("B", "z", False), ("C", "", True)]
    st = spark.createDataFrame([("02", 3, [5, 1]), ("01", 4, [9]), ("03", 1, None)], "flight string, n int, v array<int>")
    one = readers.merged(st, "flight").first()
    assert (one["n"], one["v"]) == (8, [9, 5, 1])
    g = spark.createDataFrame([(1, 2.0)], "tile_id long, v double")
    calls = []
    for _ in range(2):
        x = readers.built_once(spark, str(tmp_path / "g"), {"model": "m", "flight": "01"}, lambda: calls.append(1) or g)
        assert [(r["tile_id"], r["flight"]) for r in x.collect()] == [(1, "01")]
    assert calls == [1]


def test_truth_is_found_however_far(spark):
    """A query thousands of kilometres from every tile keeps its ground truth."""
    from overfly.operators import spatial

    tiles = spark.createDataFrame([(i, 30 + i * 1e-4, 115 + i * 1e-4) for i in range(50)] + [(99, -70.0, -179.99)], "tile_id long, tlat double, tlon double")
    asked = spark.createDataFrame([(7, 30.0007, 115.0007), (500, 31.5, 118.0), (501, -70.0, 179.99), (502, 80.0, 20.0)], "query_id long, qlat double, qlon double")
    got = {r["query_id"]: (r["tile_id"], r["dist_m"]) for r in spatial.nearest(asked, tiles, "query_id", ("qlat", "qlon"), ("tlat", "tlon"), "tile_id", other=F.col("query_id") != F.col("tile_id")).collect()}
    assert got[7][0] in (6, 8) and {k: got[k][0] for k in (500, 501, 502)} == {500: 49, 501: 99, 502: 49}
    assert got[501][1] < 1000 < 5e6 < got[502][1]


def test_alpha_sweep_ranks_the_whole_query_set(spark, duck):
    """R1, R3, R5 and R10 by blend weight, over every 10th tile; at weight 1 the ranks are those of gt_rank."""
    rows = {r["alpha"]: r.asDict() for r in registry.queries()["alpha_sweep"](spark, DATA).collect()}
    assert sorted(rows) == [0.5, 0.75, 1.0]
    n = duck.sql("select count(*) from embeddings where vec_id % 10 = 0").fetchall()[0][0]
    ranks = [r["gt_tile_rank"] for r in registry.queries()["gt_rank"](spark, DATA).collect()]
    assert all(r["n"] == n for r in rows.values()) and len(ranks) == n
    for k in (1, 3, 5, 10):
        assert rows[1.0][f"r{k}"] == pytest.approx(100 * sum(r < k for r in ranks) / n, abs=1e-5)


def nce_brute(ids, x, lat, lon):
    """(masked pairs, mean cross entropy with the diagonal as target) over batches of 256 ids."""
    import numpy as np

    total, masked = 0.0, 0
    for b in np.unique(ids // 256):
        k = np.flatnonzero(ids // 256 == b)
        for i in k:
            near = np.hypot((lon[k] - lon[i]) * 111320 * np.cos(np.radians((lat[k] + lat[i]) / 2)), (lat[k] - lat[i]) * 110540) <= 100
            masked += near.sum() - 1
            total += np.log(np.exp(10 * x[k] @ x[i])[~near | (k == i)].sum()) - 10 * x[i] @ x[i]
    return masked, total / len(ids)


def test_infonce_is_a_loss_over_all_rows(spark, duck):
    import numpy as np

    v = duck.sql("select vec_id, embedding from embeddings").fetchall()
    ids, x = np.array([r[0] for r in v]), np.array([r[1] for r in v], np.float64)
    want = nce_brute(ids, x, 30 + ids * 7919 % 100003 / 100003 * 0.04, 115 + ids * 104729 % 100003 / 100003 * 0.06)
    got = registry.queries()["infonce_loss"](spark, DATA).collect()[0]
    assert (got["n"], got["n_masked"]) == (len(ids), want[0])
    assert got["row_loss"] == got["col_loss"] == got["loss"] == pytest.approx(want[1], abs=2e-5)


def test_infonce_masks_near_pairs(spark):
    import numpy as np

    from overfly.plans import retrieval

    r = np.random.default_rng(5)
    ids, x = np.arange(300), r.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lat, lon = 30 + r.uniform(0, 0.01, 300), 115 + r.uniform(0, 0.01, 300)
    d = spark.createDataFrame([(int(i), float(a), float(b), v.tolist()) for i, a, b, v in zip(ids, lat, lon, x)], "tile_id long, lat double, lon double, emb array<double>")
    got, want = retrieval.info_nce(d).collect()[0], nce_brute(ids, x, lat, lon)
    assert got["n"] == 300 and got["n_masked"] == want[0] > 100
    assert got["loss"] == pytest.approx(want[1], abs=2e-5)


def python_clean(text):
    """The cleaning steps in plain Python, with blanks as what is stripped."""
    words = "dark light bright pale deep white black grey gray green brown red blue yellow orange golden tan beige silver reddish greenish brownish shadows?".split()
    t = re.sub("<think>.*?</think>", "", text, flags=re.DOTALL).strip(" ")
    t = re.sub(rf",?\s*\b(?:{'|'.join(words)})(?:er|est)?\b\s*,?", " ", t, flags=re.IGNORECASE)
    for pattern, to in ((r"\s+,", ","), (r",\s*,", ","), (r"\s{2,}", " "), (r"\s+\.", ".")):
        t = re.sub(pattern, to, t)
    return t.strip(" ").strip(",").strip(" ")


def test_every_caption_is_cleaned(spark, duck):
    """All languages, rows without one among them, against the steps in Python."""
    docs = duck.sql("select doc_id, text from documents").fetchall()
    texts = {i: f"<think>plan\nit</think> Dark green fields, {t}" if i % 7 == 0 else t for i, t in docs}
    want = {i: (len(c), hashlib.md5(c.encode()).hexdigest()) for i, t in texts.items() for c in [python_clean(t)]}
    got = {r["id"]: (r["n"], r["digest"]) for r in registry.queries()["caption_clean"](spark, DATA).collect()}
    assert len(got) > duck.sql("select * from documents where lang = 'en'").count("*").fetchall()[0][0]
    assert got == want


def test_clean_at_accented_letters(spark):
    from overfly.functions import text as T

    odd = ["éred fields, redé, red é", "une forêt red, größer tanö tan.", "Señales ñred_ red1 RED, light", "vert, darkest ü , lighter"]
    d = spark.createDataFrame(list(enumerate(odd)), "i int, caption string")
    assert {r["i"]: r["c"] for r in d.select("i", T.clean(F.col("caption")).alias("c")).collect()} == {i: python_clean(t) for i, t in enumerate(odd)}


def test_recall_curve_reaches_the_largest_rank(spark):
    """k are unique rounded log-spaced points up to the largest rank + 1, where recall is 100."""
    import numpy as np

    ranks = np.array([r["gt_tile_rank"] for r in registry.queries()["gt_rank"](spark, DATA).collect()])
    ks = np.unique(np.round(np.logspace(0, np.log10(ranks.max() + 1), 200)).astype(int))
    got = {r["k"]: r["recall"] for r in registry.queries()["recall_curve"](spark, DATA).collect()}
    assert sorted(got) == ks.tolist() and got[ks[-1]] == 100
    assert all(got[k] == pytest.approx(100 * (ranks < k).mean(), abs=1e-5) for k in ks)
