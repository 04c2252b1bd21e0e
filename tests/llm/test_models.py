"""Models, curves and text primitives against plain recomputation; odd tables through every operator."""

import collections
import hashlib
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from overfly.llm import ann, arrays, bpe, langcrf, mixing, quality, rangejoin, sharding, substring, toxicity

from .test_text_ops import words

DATA = "/root/testdata/sf0.01"


def test_forward_backward_equals_all_paths():
    r = np.random.default_rng(1)
    n, t = 3, 5
    e = np.zeros((1, langcrf.CHAIN, n))
    e[0, :t] = r.normal(0, 2, (t, n))
    start, trans = r.normal(0, 1, n), r.normal(0, 1, (n, n))
    p, total = np.zeros((t, n)), 0.0
    for path in itertools.product(range(n), repeat=t):
        w = math.exp(start[path[0]] + sum(e[0, i, k] for i, k in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
        total += w
        for i, k in enumerate(path):
            p[i, k] += w
    got = langcrf.marginals(langcrf.forward_backward(e, np.array([t]), start, trans))[0, :t]
    assert got == pytest.approx(p / total, abs=1e-9)


def test_pooled_maxima_equal_a_loop():
    r = np.random.default_rng(2)
    counts = np.array([0, 1, 2, 3, 5, 9, 40])
    act = r.normal(0, 1, (counts.sum(), toxicity.FILTERS)).astype(np.float32)
    for width in (1, 2, 3):
        v, place = toxicity.argmaxima(act, counts, width)
        first = np.cumsum(counts) - counts
        for d, c in enumerate(counts):
            m = max(c - width + 1, 0)
            for q in range(toxicity.PARTS):
                lo, hi = m * q // toxicity.PARTS, m * (q + 1) // toxicity.PARTS
                for f in range(toxicity.FILTERS):
                    part = act[first[d] + lo : first[d] + hi, f]
                    assert v[d, q, f] == (max(part.max(), 0) if len(part) else 0)
                    if len(part) and part.max() > 0:
                        assert place[d, q, f] == first[d] + lo + part.argmax()


def test_training_beats_its_start():
    """Toxic is one word right before another; alone each of them says nothing, so log-odds of words cannot tell."""
    r = random.Random(3)
    texts, y = [], []
    for i in range(900):
        w = [r.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(40)]
        k = r.randrange(5, 30)
        a, b = ("crude", "remark")
        w[k], w[k + 1 if i % 3 == 0 else k + 5] = a, b
        texts.append(" ".join(w))
        y.append(float(i % 3 == 0))
    y = np.array(y)

    def auc(net):
        s, counts = toxicity.slots_of(texts[600:])
        z = toxicity.logits(net, net.projected(), s, counts)
        pos, neg = z[y[600:] == 1], z[y[600:] == 0]
        return float((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())

    start, trained = (toxicity.train(texts[:600].copy(), y[:600], ["en"] * 600, epochs=20, rate=x) for x in (0.0, 0.02))
    assert auc(trained) > max(0.9, auc(start) + 0.2), (auc(start), auc(trained))


def test_trees_equal_a_scalar_walk():
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    m = quality.grow(x, y, trees=20)
    got = m.score(x)
    for i in range(0, 500, 7):
        z = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            z += leaf[node - (2**quality.DEPTH - 1)]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))
    assert ((got > 0.5) == (y == 1)).mean() > 0.95


def test_document_statistics_by_hand():
    texts = ["One two, two two!\nOne", "", "x"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    s = [dict(zip(quality.NAMES, row)) for row in quality.statistics(data, at)]
    assert s[0]["log_words"] == pytest.approx(math.log1p(5)) and s[0]["distinct_words"] == pytest.approx(4 / 5) and s[0]["top_word"] == pytest.approx(2 / 5)
    assert s[0]["line_words"] == pytest.approx(2.5) and s[0]["share_bang"] == pytest.approx(1 / 21) and s[0]["share_upper"] == pytest.approx(2 / 21)
    assert not any(s[1].values()) and s[2]["word_bytes"] == 1


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(5)
    raw = b" ".join(bytes(r.choice(b"abcdef") for _ in range(r.choice([1, 3, 9, 200]))) for _ in range(400))
    data = np.frombuffer(raw, np.uint8)
    begin, end, _ = arrays.spans(~arrays.WHITE[data], np.array([0, len(data)]))
    want = arrays.hash_spans(data, begin, end)
    windows = arrays.hash_windows(want, 35)
    monkeypatch.setattr(arrays, "BLOCK", 64)
    assert (arrays.hash_spans(data, begin, end) == want).all() and (arrays.hash_windows(want, 35) == windows).all()
    same = collections.defaultdict(set)
    for h, a, b in zip(want.tolist(), begin, end):
        same[raw[a:b]].add(h)
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_a_very_long_text(spark):
    """Twenty megabytes in one text, with one word of a megabyte: hash tables stay small, results are whole."""
    word = "q" * (1 << 20)
    text = word + " " + " ".join(f"w{i % 50021}" for i in range(2_600_000))
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    assert len(raw) > 17 << 20
    begin, end, counts = arrays.spans(~arrays.WHITE[data], np.array([0, len(data)]))
    h = arrays.hash_spans(data, begin, end)
    assert counts[0] == 2_600_001 and len(np.unique(h)) == 50022 and h[1] == h[50022]
    assert len(arrays.BYTE_POWERS.up) <= 4 * arrays.BLOCK and all(len(p.up) <= 4 * arrays.BLOCK for p in arrays.WORD_POWERS)
    d = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.digests(d).collect()}
    assert got == {1: (2_600_001, 2_600_000), 2: (2, 0)}


def test_passages_of_rows_without_ids(spark):
    """Rows without an id, an id of -1 and ids with several texts: all like any other row."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcd") for _ in range(4))
    shared = [word() for _ in range(50)]
    rows = []
    for i in range(300):
        w = [word() for _ in range(r.randint(0, 60))] + (shared[: r.randint(30, 50)] if i % 3 == 0 else []) + [word() for _ in range(10)]
        rows.append(((None, -1, 7, i)[i % 4], " ".join(w)))
    rows += [rows[0], (None, None), (None, "")]
    count = collections.Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    d = spark.createDataFrame([(*x, "own") for x in rows], "doc_id long, text string, Kept string").repartition(4)
    assert sorted((tuple(x) for x in substring.digests(d).collect()), key=str) == sorted(want, key=str)
    assert substring.removals(d).columns == ["doc_id", "text", "n_words", "n_removed", "kept"]


def sources(n=800):
    r = random.Random(7)
    return [(i, "x" * r.randint(0, 500), r.choice(["en", "fr", None]), r.choice([f"https://same-prefix.example/{k}" for k in "abcdefghij"] + [None]), 9) for i in range(n)]


def test_shards_by_hand(spark):
    """Bins, curve and shards recomputed in Python; sources that share their first bytes are told apart, copies of a text go by their least ones."""
    rows = sources()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Shard int").repartition(3)
    got = {r["doc_id"]: r for r in sharding.shard_documents(d).collect()}

    def places(values):
        order = {v: float(i) for i, v in enumerate(sorted(set(values), key=lambda v: (v is not None, (v or "").encode())))}
        return [order[v] for v in values]

    def least(column):
        copies = {}
        for r in rows:
            copies.setdefault(r[1], []).append(r[column])
        return [min((v for v in copies[r[1]] if v is not None), key=str.encode, default=None) for r in rows]

    dims = [places(least(3)), places(least(2)), [float(len(r[1]) + 1) for r in rows]]
    bins = []
    for v in dims:
        s = sorted(v)
        cuts = [s[math.ceil(i / 16 * len(s)) - 1] for i in range(1, 16)]
        bins.append([sum(x > c for c in cuts) for x in v])
    assert len(set(bins[0])) >= 9
    for i, r in enumerate(rows):
        assert got[r[0]]["curve"] == sharding.hilbert_index([b[i] for b in bins], 4)
    order = sorted(got.values(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in order) and len(order) == len(rows)
    n = len(rows)
    for rank, r in enumerate(order):
        assert r["shard"] == rank * 16 // n and r["slot"] == rank - math.ceil(r["shard"] * n / 16)


def test_shards_can_be_skipped(spark):
    """A reader of one source, or of one language and a narrow range of sizes, opens far fewer shards than in random order."""
    rows = sources()
    by = {r[0]: r for r in rows}
    got = sharding.shard_documents(spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")).collect()

    def opened(want, shard):
        return len({shard[i] for i, r in by.items() if want(r)})

    mine = {r["doc_id"]: r["shard"] for r in got}
    rnd = dict(zip(by, random.Random(1).sample(list(mine.values()), len(mine))))
    for want, most in ((lambda r: r[3] == "https://same-prefix.example/c", 0.67), (lambda r: r[2] == "fr" and 100 <= len(r[1]) < 150, 0.8)):
        assert opened(want, mine) <= most * opened(want, rnd), (opened(want, mine), opened(want, rnd))


@pytest.mark.parametrize("kind", ["clustered", "flat"])
def test_code_search_recall(spark, kind):
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 48))
    if kind == "clustered":
        x = r.standard_normal((40, 48))[r.integers(0, 40, 3000)] + 0.3 * x
    x = x.astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    assert recall(ann.nearest(d, d.filter("vec_id % 50 = 0"), 5), np.arange(3000), x) >= 0.97


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_code_search_recall_on_all_given_queries(spark):
    d = spark.read.parquet(f"{DATA}/embeddings.parquet")
    t = d.select("vec_id", "embedding").toArrow()
    ids = np.asarray(t.column(0))
    x = np.array(t.column(1).to_pylist(), np.float32)
    assert recall(ann.nearest(d, d.filter("vec_id % 50 = 0"), 5), ids, x) >= 0.97


def recall(found, ids, x):
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = u @ u[k]
        s[k] = -9
        best = np.sort(s)[-5]
        # Ties with the fifth score are as good as it.
        hits += sum(s[np.flatnonzero(ids == i)[0]] >= best - 1e-12 for i in got[ids[k]])
        total += 5
    return hits / total


def test_copies_of_clustered_vectors_do_not_grow(spark):
    """Rings and cells keep the guests of a vector few where vectors cluster, at any number of them."""
    r = np.random.default_rng(9)
    centres = r.standard_normal((60, 24))
    for n in (1500, 6000):
        x = (centres[r.integers(0, 60, n)] + r.normal(0, 0.1, (n, 24))).astype(np.float32)
        u = x.astype(np.float64)
        u /= np.sqrt((u * u).sum(axis=1))[:, None]
        want = (u @ u.T >= 0.9).sum(axis=1) - 1
        d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
        got = {q["vec_id"]: q["n_links"] for q in rangejoin.near_vectors(d, home=100, guest=200).collect()}
        assert all(got[i] == want[i] for i in range(n))


def odd_table(spark):
    """Nulls, empty, blank and letterless texts, repeated rows, repeated and missing ids, and columns named like the operators' own."""
    base = "the house and the garden with a long wall stand by the river where people walk every evening in summer and talk about the news of the day"
    rows = [(1, base), (1, base), (2, None), (3, ""), (4, " \t "), (None, base + " again"), (None, None), (5, "12 -- ?"), (6, base + " " + base), (7, "une maison et le jardin avec des élèves")]
    more = (0.125, "zz", 77, 78, "mine", "ids", "dec", 5, 6, 7, 8, 9)
    names = ["score double", "lang_pred string", "n_words long", "n_removed long", "Kept string", "ids string", "decoded string", "predicted int", "stats int", "copies int", "size int", "target int"]
    data = [(i, t, "fr" if i == 7 else ("en", "en", None)[k % 3], ("s0", None)[k % 2], None if t is None else len(t), *more) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(names)), len(rows)


def test_operators_on_an_odd_table(spark):
    P = pytest.importorskip("public_tokenizers")
    d, n = odd_table(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] * 2, "doc_id long, quality int, toxic int")
    path = P.path("byte_bpe_50k.json")
    net, trees, model = toxicity.fit(d, labels), quality.fit(d, labels), langcrf.fit(d)
    for out in (
        lambda x: toxicity.classify(x, net), lambda x: quality.classify(x, trees), lambda x: quality.with_statistics(x), lambda x: langcrf.identify(x, model),
        lambda x: substring.removals(x), lambda x: bpe.encode(x, path, decoded=True), lambda x: bpe.decode(bpe.encode(x, path), path),
    ):
        got = out(d)
        assert got.count() == n and len({c.lower() for c in got.columns}) == len(got.columns)
        assert got.select("doc_id", "n_chars", "source").exceptAll(d.select("doc_id", "n_chars", "source")).count() == 0
        assert out(d.limit(0)).count() == 0
    dec = {r["text"]: r["decoded"] for r in bpe.encode(d, path, decoded=True).collect()}
    assert all((k or "") == v for k, v in dec.items())
    taken = mixing.take(d)
    assert taken.columns == d.columns and mixing.take(d.limit(0)).count() == 0 and taken.filter("Kept <> 'mine' OR size <> 8").count() == 0
    assert sorted(map(str, taken.collect())) == sorted(map(str, mixing.take(d.repartition(3)).collect()))


def test_pipeline_stages_on_an_odd_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d, n = odd_table(spark)
    own = ["score", "lang_pred", "n_words", "n_removed", "Kept", "ids", "decoded", "predicted", "copies", "size", "target"]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and stage(spark, d.limit(0), "").count() == 0
        rows = out.collect()
        assert rows and all(tuple(r[c] for c in own) == (0.125, "zz", 77, 78, "mine", "ids", "dec", 5, 7, 8, 9) for r in rows)
    kept = pipeline.near_dedup(spark, d, "").collect()
    # Twice the same text is near to it; so is one more word without an id.
    assert [r["doc_id"] for r in kept if r["text"] and "house" in r["text"]] == [1]
    assert len(kept) == 7
    last = pipeline.encode(spark, d, "")
    assert last.count() == n and last.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and pipeline.encode(spark, d.limit(0), "").count() == 0


def test_long_texts_are_learned_from(spark):
    """A language that has only long texts is learned; a repeated row is drawn once."""
    long_ = " ".join(["zug", "haus", "und", "wasser"] * 12_000)
    rows = [(i, "the house and the river " * 5, "en") for i in range(60)] + [(100 + i, long_ + f" {i}", "de") for i in range(4)] + [(None, "ein haus", "xx")] * 300
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langcrf.sample(d)
    assert {g for _, g in got} == {"en", "de", "xx"} and sum(g == "xx" for _, g in got) == 1
    assert {g for _, g in langcrf.sample(d, most_bytes=3000)} == {"en", "de", "xx"}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(104)], "doc_id long, quality int, toxic int")
    from overfly.llm.labelled import training_rows

    twice = d.union(d.withColumn("text", F.concat("text", F.lit(" more"))))
    many = training_rows(twice.select("doc_id", "text", "lang"), labels, "toxic", 50, 1 << 20).collect()
    assert len(many) == len({r["doc_id"] for r in many}) <= 50
