"""Document operators against brute force, on planted edge cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from overfly.llm import bpe, langcrf, minhash, mixing, quality, sharding, substring, toxicity
from overfly.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, score double, ids string, target int, copies int, _id int, _k int, root int"


def corpus(seed=3, n=120):
    """Copies, near copies, shared passages, repeated lines, null, empty, blank, one-word and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \t\n ", "one", "One two", None, "a b c d", "A B C D", "x " * 90, "é ü z " * 50]
    base = [word() for _ in range(150)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = list(base)
            for _ in range(r.randint(0, 7)):
                w[r.randrange(len(w))] = word()
        elif kind == 1:
            w = [word() for _ in range(30)] + passage[: r.randint(30, 60)] + [word() for _ in range(30)]
        elif kind == 2:
            w = list(base)
        else:
            w = [word() for _ in range(r.randint(1, 200))]
        texts.append((" ", "\n", "  ")[i % 3].join(w))
    texts.append(" ".join(word() for _ in range(20_000)))
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1", None, "s0", "s0")[i % 5], None, "k", 1, 0.5, "z", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall((t or "").encode())


def test_substring_equals_brute_force(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
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
    got = sorted(tuple(r) for r in substring.digests(docs).collect())
    assert got == sorted(want) and sum(x[2] for x in got) > 1000
    out = substring.removals(docs)
    assert set(out.columns) == {*docs.columns, "n_words", "n_removed"} and substring.digests(empty).count() == 0


def near_brute(rows):
    sets = []
    for _, t in rows:
        w = words((t or "").encode().lower().decode() if t else t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates_equal_brute_force(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == near_brute(rows)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {d for d, _, _, k in got if k}


def test_large_buckets_are_decided_by_blocks(spark, monkeypatch):
    """Near copies around the bound, with every bucket treated as a large one in tiny blocks."""
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in r.sample(range(100), r.randint(0, 8)):
            w[k] = f"e{r.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    got = sorted((tuple(x) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == near_brute(rows)


def test_near_duplicates_without_ids_and_of_repeated_ids(spark):
    """Each row is a document: a missing id links like others, an id with two texts has two nodes."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda w: " ".join([*w[:20], "other", *w[21:]])
    rows = [(1, " ".join(a)), (None, near(a)), (3, " ".join(b)), (5, near(a)), (5, near(b)), (None, "all of this is alone here"), (None, "all of this is alone here"), (None, None), (7, ""), (5, near(b))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in minhash.near_duplicates(d).collect()), key=str)
    assert got == near_brute(rows)
    kept = sorted((tuple(x) for x in minhash.keep_one(d).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[5], rows[7], rows[8]], key=str)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_bpe_equals_the_library(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(2)
    bits = ["a", "é", "'s", "'", "'re", " ", "  ", "\n", " ", "　", "1", ".", "%", "<|endoftext|>", "<|end", "日本", "😀", "Q", "x'll", "\r\n", "\u0085", "\x1c", "§"]
    odd = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    d = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(list(enumerate(odd, 10_000)), "doc_id long, text string"))
    texts = {x["doc_id"]: x["text"] or "" for x in d.collect()}
    for x in bpe.encode(d, path, decoded=True).collect():
        want = tok.encode(texts[x["doc_id"]], add_special_tokens=False).ids
        assert list(x["ids"]) == want and x["decoded"] == tok.decode(want, skip_special_tokens=False)
    x = bpe.decode(bpe.encode(d, path), path).filter("doc_id = 20").first()
    assert x["decoded"] == texts[20]
    assert bpe.digests(empty, path).count() == 0


def test_sharding_laws(docs, empty):
    got = sharding.shard_documents(docs).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x["shard"]].append(x["slot"])
    assert len(got) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    texts = {x["doc_id"]: x["text"] or "" for x in docs.collect()}
    assert all(x["size"] == len(texts[x["doc_id"]].encode()) + 1 and x["text_crc32"] == zlib.crc32(texts[x["doc_id"]].encode()) for x in got)
    again = {(x["doc_id"], x["shard"], x["slot"]) for x in sharding.shard_documents(docs.repartition(2)).collect()}
    assert again == {(x["doc_id"], x["shard"], x["slot"]) for x in got}
    assert sharding.shard_documents(empty).count() == 0
    small = docs.filter("doc_id < 100")
    sizes = collections.Counter()
    for x in sharding.shard_documents(small, shards=4, law="bytes").collect():
        sizes[x["shard"]] += x["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(texts[i].encode()) + 1 for i in range(100))


@pytest.mark.parametrize(("bits", "dims"), [(4, 2), (4, 3)])
def test_hilbert_curve_steps_to_neighbours(bits, dims):
    cells = {}
    for c in range(1 << bits * dims):
        xs = [c >> bits * k & (1 << bits) - 1 for k in range(dims)]
        cells[sharding.hilbert_index(xs, bits)] = xs
    assert sorted(cells) == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(len(cells) - 1))


def test_mixing(docs, empty):
    rows = mixing.mix_documents(docs).collect()
    size = collections.Counter()
    for x in docs.collect():
        size[x["source"]] += len(words(x["text"]))
    # The rule by hand: share the total by weight, cap, share the excess among the open ones until none is above.
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {s: 0.0 for s in size}, 1.5 * sum(size.values()), set(size)
    while left > 1e-9 and open_:
        w, share = sum(weight[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s] / w
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                open_.discard(s)
    source = {x["doc_id"]: x["source"] for x in docs.collect()}
    for x in rows:
        assert x["target"] == pytest.approx(target[source[x["doc_id"]]]) and 0 <= x["taken"] <= 2 * x["size"] and x["taken"] == x["copies"] * x["size"]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_documents(docs.repartition(3)).collect()))
    assert mixing.mix_documents(empty).count() == 0
    out = mixing.take(docs)
    assert out.columns == docs.columns and out.count() == sum(x["copies"] for x in rows)


def test_language(spark, docs, empty):
    def line(i, lang):
        r = random.Random(i)
        return " ".join(r.choice({"en": ["the", "and", "ing", "house", "with"], "fr": ["le", "où", "élève", "avec", "des"]}[lang]) for _ in range(40))

    rows = [(i, line(i, lang), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]
    odd = [(900, None, "en"), (901, "", "fr"), (902, "123 -- ?", None), (903, "— “”", "en"), (904, rows[0][1], None)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langcrf.predict(d).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and got[904]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert langcrf.predict(empty).count() == 0
    # Code-switched text: words follow their own language.
    m = langcrf.train([t for _, t, _ in rows], [g for _, _, g in rows], steps=30)
    import numpy as np

    mixed = ("the house and with ing " * 4 + "le élève avec des où " * 4).encode()
    shares, n = m.shares(np.frombuffer(mixed, np.uint8), np.array([0, len(mixed)]))
    assert shares[0] == pytest.approx([20, 20], abs=3) and n[0] == 40


@pytest.mark.parametrize(("predict", "label", "bar"), [(toxicity.predict, "toxic", 0.5), (quality.predict, "quality", 0.3)])
def test_classifiers(spark, empty, predict, label, bar):
    r = random.Random(4)
    good = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(good) for _ in range(60)]
        y = int(i % 5 == 0) if label == "toxic" else int(i % 4 != 0)
        if (label == "toxic") == bool(y):
            for k in r.sample(range(60), 6):
                w[k] = r.choice(["vile", "foul"]) if label == "toxic" else "###$$$"
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, y, y))
    odd = [(1000, None, "en", "s"), (1001, "", None, None), (1002, "?", "en", "s")]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in predict(d, lab).collect()}
    assert len(got) == 403 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= bar) for x in got.values())
    held = [i for i, _, _ in labels if got[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.95 * len(held)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert predict(empty, none).count() == 0 and predict(d, none).count() == 403
    # Labels of held-out rows, languages and sources change nothing.
    other = predict(d.withColumns({"source": F.lit("t")}), lab.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 0).otherwise(F.col(label))))
    assert {x["doc_id"]: x["score"] for x in other.collect()} == {i: x["score"] for i, x in got.items()}


def test_every_language_is_learned(spark):
    """Forty languages of words of their own: none is left out, however few rows each gets."""
    r = random.Random(4)
    # Each language has its own words.
    vocab = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{r.choice('aeiou')}{chr(97 + r.randrange(26))}{j}x" for j in range(8)] for k in range(40)}
    vocab = {g: [w.translate(str.maketrans("0123456789", "qwrtzpsdfg")) for w in v] for g, v in vocab.items()}
    rows = [(40 * i + k, " ".join(r.choice(vocab[g]) for _ in range(30)), g) for k, g in enumerate(sorted(vocab)) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {g for _, g in langcrf.sample(d)} == set(vocab)
    assert {g for _, g in langcrf.sample(d, most_rows=40)} == set(vocab) and len(langcrf.sample(d, most_rows=40)) == 40
    true = {i: g for i, _, g in rows}
    got = langcrf.predict(d).filter("held_out").collect()
    right = sum(x["lang_pred"] == true[x["doc_id"]] for x in got)
    assert len(got) > 60 and right >= 0.95 * len(got), (right, len(got))


def test_keep_one_with_repeated_and_missing_ids(spark):
    """Different texts of one id all stay, near copies and equal rows go, also without an id."""
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, e = text(), text(), text(), text()
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, a + " more"), (4, c), (None, c + " more"), (None, e), (None, e + " more"), (5, text())]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in minhash.keep_one(d).collect()]
    assert len(got) == 5 and {(1, a), (1, b), (4, c), rows[-1]} < set(got)
    assert [x for x in got if x[0] is None][0][1] in (e, e + " more")


def test_the_model_is_trained_outside_the_driver(spark, monkeypatch):
    """Only the model comes to the driver, and it is the one that the same rows give there."""
    import os

    import numpy as np

    d = spark.createDataFrame([(i, "the house and the river" if i % 2 else "le chat avec des amis", ("fr", "en")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    rows, real, driver = langcrf.sample(d), langcrf.train, os.getpid()

    def train(texts, langs):
        assert os.getpid() != driver
        return real(texts, langs)

    monkeypatch.setattr(langcrf, "train", train)
    got, want = langcrf.fit(d), real([t for t, _ in rows], [g for _, g in rows])
    assert got.labels == want.labels and all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("grams", "lexicon", "entries", "weight", "start", "trans"))
    assert langcrf.fit(d.limit(0)) is None


def test_components_read_edges_in_few_tasks(spark, monkeypatch):
    """Edges of many small partitions are read once; each step after that starts from a checkpoint, with one read for both directions."""
    from overfly.llm import graph

    plans, large, small = [], graph.large_star, graph.small_star

    def seen(step):
        def run(e):
            plans.append((e._jdf.queryExecution().executedPlan().toString(), e.rdd.getNumPartitions()))
            return step(e)

        return run

    monkeypatch.setattr(graph, "large_star", seen(large))
    monkeypatch.setattr(graph, "small_star", seen(small))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long").repartition(50)
    assert {(x["node"], x["root"]) for x in graph.components(edges).collect()} == {(i, 0) for i in range(41)}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plans and all("Exchange" not in p and "Join" not in p and k <= n for p, k in plans)
    assert "Union" not in large(edges)._jdf.queryExecution().executedPlan().toString()
