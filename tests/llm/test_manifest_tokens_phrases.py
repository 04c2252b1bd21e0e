"""Merkle manifest, token counts and phrase collocations against brute force, on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from overfly.llm import collocations, merkle, sharding, tokencount, vocab
from overfly.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, idx long, path string, key string, shard int, bucket int, n long, phrase string, rank int, root string"
EXTRA = ("l", "t", 1, "p", "k", 2, 3, 4, "ph", 5, "r")


def corpus(n=150, seed=1):
    r = random.Random(seed)
    words = ["of", "the", "The", "sea", "Über", "naïve", "it's", "x1", "’n", "DON'T", "10,000", "—", "a-b", "日本", "<|endoftext|>"]
    odd = [
        None, "", " \t\n", ".", "one", "İstanbul ΣΊΣΥΦΟΣ ὈΔΥΣΣΕΎΣ", "éà ́x ﬁ Å K", "a<|endoftext|>b<|startoftext|><|endoftext|> <|start", "a b c\x1cd\x85e​f",
        "'s't 're''ll we'LL 'd's", "😀😀 ½² ١٢٣ ǅ", "\x00\x01\x7f", "w" * 5000, "the sea. of the sea; the\rsea\x0bthe sea",
    ]
    texts = odd + [" ".join(r.choice(words) + r.choice(["", "", ",", ".", "!\n"]) for _ in range(r.randint(1, 60))) for _ in range(n)]
    texts.append(" ".join(r.choice(words) for _ in range(30_000)))
    rows = [(i, t, ("en", "fr", None, "de", "en", "en")[i % 6], ("s", None)[i % 2], None if i % 7 == 0 else i, *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "the sea of it", "en", "s", 3, *EXTRA), (None, None, None, None, None, *EXTRA), (20, "another text of id 20", "en", "s", 1, *EXTRA)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- manifest ----------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(field, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append((level[run:i], level[i + 1 : run + 8]))
        i //= 8
    return out


def manifest(rows):
    groups = collections.defaultdict(list)
    for d in rows:
        groups[d["lang"]].append(d)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        trees[g] = tree([leaf(d, d["text"]) for d in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, d in enumerate(groups[g]):
            own, steps = trees[g][0][i], siblings(trees[g], i) + siblings(top, k)
            text = d["text"]
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            fold = leaf(d, text)
            for a, b in steps:
                fold = h(*a, fold, *b)
            out.append((d["doc_id"], own, trees[g][-1][0], top[-1][0], h(*[x for a, b in steps for x in (*a, *b)]), fold, fold == top[-1][0]))
    return out


def plain(rows):
    return sorted(map(str, rows))


def test_manifest_equals_brute_force(docs, empty):
    got = [tuple(r) for r in merkle.verify_documents(docs).collect()]
    want = manifest(docs.collect())
    assert plain(got) == plain(want)
    assert {x[6] for x in got} == {True, False} and len({x[3] for x in got}) == 1
    assert merkle.verify_documents(empty).count() == 0
    one = docs.filter("doc_id = 5")
    assert plain(map(tuple, merkle.verify_documents(one).collect())) == plain(manifest(one.collect()))
    some = docs.filter("lang = 'en' AND doc_id < 60").repartition(9)
    assert plain(map(tuple, merkle.verify_documents(some).collect())) == plain(manifest(some.collect()))


def test_nodes_are_the_same_however_fragments_lie(spark):
    n = 700
    digests = [h(str(i)) for i in range(n)]
    want = {(k + 1, i): x for k, level in enumerate(tree(digests)[1:]) for i, x in enumerate(level)}
    rows = [("t", i, n, d) for i, d in enumerate(digests)]
    for parts in (1, 3, 40):
        random.Random(parts).shuffle(rows)
        d = spark.createDataFrame(rows, "tree string, idx long, n long, digest string").repartition(parts)
        got = [(r["level"], r["idx"], r["digest"]) for r in merkle.grow(d).collect()]
        assert len(got) == len(want) and {(a, b): c for a, b, c in got} == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(2, 8), st.integers(0, 2**32))
def test_merging_forests_is_associative_and_commutative(n, arity, seed):
    r = random.Random(seed)
    digests = [h(str(i)) for i in range(n)]
    parts = [[] for _ in range(3)]
    for i in r.sample(range(n), n):
        parts[r.randrange(3)].append(i)

    def grown(order):
        made, forests = [], []
        for p in order:
            f = merkle.Forest(arity)
            for i in parts[p]:
                made += f.add(("t", 0, i, n, digests[i]))
            forests.append(f)
        return made, forests

    results = []
    for order, left in (((0, 1, 2), True), ((0, 1, 2), False), ((2, 0, 1), True)):
        made, (a, b, c) = grown(order)
        if left:
            made += a.merge(b)
            made += a.merge(c)
        else:
            made += b.merge(c)
            made += a.merge(b)
        made += a.merge(merkle.Forest(arity))
        assert not a.open
        results.append(sorted(made))
    assert results[0] == results[1] == results[2]


# --- tokens ------------------------------------------------------------------------------


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_equal_the_librarys(docs, empty):
    path = vocabulary("word_bpe_49k.json")
    rows = docs.collect()
    want = sorted((str(d["doc_id"]), len((d["text"] or "").encode()), n, n > 2048) for d, n in zip(rows, library([d["text"] for d in rows])))
    assert sorted((str(r[0]), *r[1:]) for r in tokencount.limits(docs, path).collect()) == want
    # Many small generations and buckets.
    got = tokencount.count_tokens(docs, path, buckets=3, words=5, text=300)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == [(a, c) for a, _, c, _ in want]
    assert tokencount.limits(empty, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=40))
def test_words_are_read_as_the_library_reads_texts(text):
    r = tokencount.reader(vocabulary("word_bpe_49k.json"))
    n = sum(r.pieces(p) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()) for p in r.pretokens(w))
    assert n == library([text])[0]


def test_equal_hashes_do_not_mix_words(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    want = vocab.distinct_spans(data, starts, ends)
    monkeypatch.setattr(vocab, "hash_spans", lambda d, s, e: np.zeros(len(s), np.uint64))
    got = vocab.distinct_spans(data, starts, ends)
    assert got[0] == want[0] == [b"aa", b"bb", b"cc"] and got[1].tolist() == want[1].tolist() == [0, 1, 0, 2]


# --- phrases -----------------------------------------------------------------------------


def phrases(rows, least, longest, hides, top):
    f, n = collections.Counter(), collections.Counter()
    for d in rows:
        lang = "und" if d["lang"] is None else d["lang"]
        text = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (d["text"] or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = collections.defaultdict(list)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    hidden = collections.Counter()
    for (g, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                hidden[g, p[i : i + m]] = max(hidden[g, p[i : i + m]], a)
    for (g, p), a in cand.items():
        if 100 * hidden[g, p] >= hides * a and hidden[g, p]:
            continue
        score, _, lo, hi = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out[g].append((-score, -a, b" ".join(p), lo, hi))
    return sorted((g, r + 1, x[2].decode(), -x[1], x[3], x[4], n[g], -x[0]) for g, xs in out.items() for r, x in enumerate(sorted(xs)[:top]))


@pytest.mark.parametrize("least, longest, hides, top, shard", [(30, 4, 80, 2000, 4 << 20), (4, 4, 80, 50, 2000), (2, 2, 80, 10**6, 300), (3, 5, 50, 10**6, 5000)])
def test_collocations_equal_brute_force(docs, least, longest, hides, top, shard):
    some = docs if longest < 5 else docs.filter("length(text) < 5000")
    got = collocations.collocations(some, least, longest, hides, top, shard=shard, batch=shard // 8, buckets=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(some.collect(), least, longest, hides, top)
    assert sorted(map(tuple, got.collect())) == want and want


def test_buckets_follow_the_input(docs, empty, monkeypatch):
    """A bucket holds the strings of a bounded stretch of text, whatever the number of shuffle partitions; results stay."""
    some = docs.filter("length(text) < 2000")
    size = some.selectExpr("sum(octet_length(text))").first()[0]
    want = sorted(map(tuple, collocations.collocations(some, 3, buckets=2).collect()))
    monkeypatch.setattr(vocab, "BUCKET", 200)
    assert vocab.buckets_of(some) == -(-size // 200) > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert vocab.buckets_of(empty) == int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, collocations.collocations(some, 3).collect())) == want and want


def test_tasks_hold_few_shards_and_one_bucket(spark, monkeypatch, tmp_path):
    """Neither few shuffle partitions nor long tables make a task hold many shards: lines are spread over as many partitions as there
    are buckets, a row is one compressed value, and readers' batches end with a small row group. Buckets are not put together."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(collocations, "removed", lambda *a: None)
    monkeypatch.setattr(collocations, "shared_folder", lambda s: str(tmp_path))
    monkeypatch.setitem(collocations.__dict__.get("GROUPS", {}), "parquet.block.size", 1 << 12)
    rows = [(f"w{i % 7} w{i % 11} x{i} y{i % 13} w{i % 7} " * 8, "en") for i in range(3000)]
    d = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        collocations.counts(d, shard=5000, buckets=40)[2].count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {n: [g for f in tmp_path.glob(f"*/{n}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in [[m.row_group(i) for i in range(m.num_row_groups)]]] for n in ("shards", "lines")}
    lines = [sum(g.num_rows for g in f) for f in groups["lines"]]
    assert sum(lines) > 50 and max(lines) < sum(lines) / 5
    for f in (*groups["shards"], *groups["lines"]):
        # A row more than the bound at most, besides what each column needs anyway.
        assert all(g.total_byte_size < 4 * (1 << 12) or g.num_rows == 1 for g in f)
    kept = spark.createDataFrame([(0, k, "en", [1], [1], f"w{k}") for k in range(60)], vocab.ROW)
    dealt = vocab.gathered(kept, 60).groupBy(F.spark_partition_id()).agg(F.count_distinct("bucket").alias("n"))
    assert [x["n"] for x in dealt.collect()] == [1] * 60
    x = np.array([[3, 0, 1], [1 << 40, 5, 6]])
    assert np.array_equal(collocations.unsqueezed(collocations.squeezed(x)), x)


def test_no_phrases(empty, docs):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.filter("text IS NULL OR length(text) < 2")).count() == 0


def test_a_full_pair_table_costs_no_exactness(docs):
    """With a table of 64 bits nearly every pair passes; the phrases stay the same."""
    some = docs.filter("length(text) < 2000")
    want = sorted(map(tuple, collocations.collocations(some, 3).collect()))
    assert sorted(map(tuple, collocations.collocations(some, 3, table_bits=64).collect())) == want and want


def test_bitmaps_shift_and_count():
    r = np.random.default_rng(2)
    words = r.integers(0, 6, 500)
    positions = np.cumsum(1 + (r.random(500) < 0.2))
    maps = collocations.Bitmaps(words, positions)
    for w in range(6):
        _, byte, bits = maps.of(w, w + 1)
        at = sorted(int(b) * 8 + k for b, x in zip(byte, bits) for k in range(8) if x >> k & 1)
        assert at == sorted(positions[words == w].tolist())
    place = dict(zip(positions.tolist(), words.tolist()))
    want = collections.Counter((place[p], place[p + 1]) for p in place if p + 1 in place)
    got = collections.Counter()
    for rows, n in collocations.phrases(words, positions, 2):
        got.update(dict(zip(map(tuple, rows.tolist()), n.tolist())))
    assert got == want


# --- shards ------------------------------------------------------------------------------


def test_equal_texts_are_split_by_shard_ends_only(spark):
    """A group of copies from many sources lies on one stretch: 15 ends can split 15 groups at most."""
    rows = [(i, f"text {i % 150}", ("en", "fr", None)[i % 3], f"s{i * 7 % 11}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.shard_documents(d).select("text_crc32", "shard").distinct().groupBy("text_crc32").count()
    assert got.agg(F.sum(F.col("count") - 1)).first()[0] <= 15
