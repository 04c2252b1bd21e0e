"""Vector operators against brute force."""

import numpy as np
import pytest

from overfly.llm import ann, rangejoin

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, rank int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(7)
    x = r.standard_normal((500, 24)).astype(np.float32)
    x[100:160] = x[100] + r.normal(0, 0.12, (60, 24))
    x[200:240] = x[200]
    x[240] = 3 * x[200]
    return x


@pytest.fixture(scope="module")
def frame(spark, rows):
    odd = [(1000, None), (1050, []), (1100, [0.0] * 24), (1150, [float("nan")] * 24), (1200, [1.0, float("inf")] + [0.0] * 22), (1250, [1.0, None] + [0.0] * 22), (None, rows[3].tolist()), (1300, [1.0, 2.0])]
    data = [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(rows)] + [(i, v, 0, 1, 2) for i, v in odd]
    return spark.createDataFrame(data, SCHEMA).repartition(4).cache()


def units(x):
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def test_nearest(spark, frame, rows):
    u = units(rows)
    got = {}
    for r in ann.nearest(frame, frame.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 500, 50):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(500), key=lambda i: (-round(s[i], 12), i))[:5]
        have = sorted(got[q])
        assert [h[0] for h in have] == [1, 2, 3, 4, 5] and all(h[2] == pytest.approx(s[h[1]], abs=1e-12) for h in have)
        hits += len(set(want) & {h[1] for h in have})
    assert hits >= 45 and {h[1] for h in got[200]} == {201, 202, 203, 204, 205}
    assert set(got) == set(range(0, 500, 50))
    few = ann.nearest(frame.filter("vec_id < 3"), frame.filter("vec_id = 0"), 5).collect()
    assert [r["rank"] for r in few] == [1, 2]
    none = frame.filter("vec_id < -5")
    assert ann.nearest(none, none).count() == 0 and ann.nearest(frame, none).count() == 0
    blocks = ann.nearest(frame, frame.filter("vec_id % 50 = 0"), 5, block_bytes=600)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in blocks.collect()) == sorted((q, k, v) for q, h in got.items() for k, v, _ in h)


@pytest.mark.parametrize(("home", "guest"), [(8192, 16384), (40, 64)])
def test_range_join(frame, rows, home, guest):
    u = units(rows)
    on = u @ u.T >= 0.9
    label = np.arange(500)
    while True:
        new = np.array([label[on[i]].min() for i in range(500)])
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in rangejoin.near_vectors(frame, home=home, guest=guest).collect()}
    assert len(got) == 508
    for i in range(500):
        # The row without an id is a copy of row 3 and counts as its partner.
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (on[i].sum() - 1 + (i == 3), label[i], label[i] == i)
    for i in (1000, 1050, 1100, 1150, 1200, 1250, 1300):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert rangejoin.near_vectors(frame.filter("vec_id < -5")).count() == 0


def test_range_join_with_near_copies(spark):
    """Pivots that are near copies of each other (jitter 1e-6) lose no link."""
    r = np.random.default_rng(11)
    x = r.standard_normal((600, 24))
    x[:200] = x[0] + r.normal(0, 1e-6, (200, 24))
    x[200:400] = x[0] + r.normal(0, 0.09, (200, 24))
    x = x.astype(np.float32)
    u = units(x)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in rangejoin.near_vectors(d, home=10, guest=64).collect()}
    wrong = [i for i in range(600) if got[i] != links[i]]
    assert not wrong, (len(wrong), int(links.sum()), sum(got.values()))


def test_range_join_without_ids(spark):
    """Rows without an id link with near vectors, not only with equal ones."""
    v = [(5, [1.0, 0.0, 0.0]), (None, [1.0, 0.1, 0.0]), (9, [1.0, 0.2, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.1, 1.0]), (7, [0.0, 1.0, 0.0])]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in rangejoin.near_vectors(d, cosine=0.97).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (None, 2, 5, False), (9, 2, 5, False), (None, 1, None, True), (None, 1, None, True), (7, 0, 7, True)], key=str)
