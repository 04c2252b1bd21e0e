"""Language identification by a linear-chain conditional random field over words.

Every word gets a score for each language from byte n-grams of the word with its
ends marked (the n-grams that touch an end are its affixes) and from a lexicon of
training words; learned transitions tie neighbours together. Forward-backward gives
each word's language distribution, so a text that switches languages is labelled
word by word; a document's language is the one with the largest expected share
of words. Chains are runs of at most 64 words of one document.

Trained in NumPy by one task from a bounded sample; scoring is one pass over
Arrow batches without a shuffle, and whole texts are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, chunks, hash_spans, mix64, spans
from .common import extended, map_arrow

#: Words of a chain; bits of the n-gram table; n-gram sizes in bytes, end marks included.
CHAIN, BITS, GRAMS = 64, 16, (2, 3, 4, 5)

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals of UTF-8 in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
    return out


def gram_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table slots of the n-grams of each word with its ends marked, number per word)."""
    size = end - begin + 2
    first = np.cumsum(size) - size
    buf = np.full(int(size.sum()), 1, np.uint8)
    place = np.arange(len(buf)) - np.repeat(first, size)
    inner = (place > 0) & (place < np.repeat(size, size) - 1)
    buf[inner] = data[(np.repeat(begin, size) + place - 1)[inner]]
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(size, size) - place
    ids, rows = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + buf[at + k]
        ids.append((mix64(code) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(word[at])
    ids, rows = np.concatenate(ids), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return ids[order], np.bincount(rows, minlength=len(size))


def chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of each chain over texts of so many words."""
    n = -(-counts // CHAIN)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(counts) - counts, n) + k * CHAIN
    return first, np.minimum(np.repeat(counts, n) - k * CHAIN, CHAIN)


@dataclass
class Chain:
    """Forward and backward messages of a batch of chains."""

    alpha: np.ndarray
    beta: np.ndarray
    factor: np.ndarray
    live: np.ndarray


def forward_backward(emission: np.ndarray, length: np.ndarray, start: np.ndarray, trans: np.ndarray) -> Chain:
    """emission: (chains, CHAIN, labels) scores; messages are normalised at each step."""
    s, t, _ = emission.shape
    live = np.arange(t)[None, :] < length[:, None]
    factor = np.exp(emission - emission.max(axis=2, keepdims=True)) + 1e-30
    factor[~live] = 1.0
    alpha, beta = np.empty_like(factor), np.ones_like(factor)
    move = np.exp(trans)
    a = np.exp(start)[None, :] * factor[:, 0]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ move) * factor[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (factor[:, i + 1] * beta[:, i + 1]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(live[:, i + 1, None], b, 1.0)
    return Chain(alpha, beta, factor, live)


def marginals(c: Chain) -> np.ndarray:
    p = c.alpha * c.beta
    return p / p.sum(axis=2, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    trans: np.ndarray

    def emissions(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of words (spans of ``data``) for each label."""
        ids, counts = gram_ids(data, begin, end)
        out = np.add.reduceat(self.grams[ids], np.cumsum(counts) - counts, axis=0)
        return out + self.entries[find(self.lexicon, hashes)] * self.weight

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected words of each label per text, words per text)."""
        low = lower(data)
        begin, end, counts = spans(LETTER[low], offsets)
        out = np.zeros((len(counts), len(self.labels)))
        if len(begin):
            hashes, at, which = np.unique(hash_spans(low, begin, end), return_index=True, return_inverse=True)
            e = self.emissions(low, begin[at], end[at], hashes)[which]
            first, length = chains(counts)
            text = np.repeat(np.arange(len(counts)), -(-counts // CHAIN))
            # As many chains at a time as take the memory of 4096 with 32 labels.
            some = min(4096, max(1, 4096 * 32 // len(self.labels)))
            for i in range(0, len(first), some):
                f, n = first[i : i + some], length[i : i + some]
                place = np.minimum(f[:, None] + np.arange(CHAIN), len(e) - 1)
                c = forward_backward(e[place], n, self.start, self.trans)
                np.add.at(out, text[i : i + some], (marginals(c) * c.live[:, :, None]).sum(axis=1))
        return out, counts


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """1 + the place of each value in the sorted table, 0 where it is absent."""
    if not len(table):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at + 1, 0)


def train(texts: list[str], langs: list[str], steps: int = 60, lexicon: int = 50_000, rate: float = 0.3, decay: float = 1e-3, seed: int = 9) -> Model:
    """Maximum conditional likelihood with Adam on whole texts, whose words all carry the text's language."""
    labels = sorted(set(langs))
    n = len(labels)
    raw = [t.encode() for t in texts]
    data = lower(np.frombuffer(b"".join(raw), np.uint8))
    begin, end, counts = spans(LETTER[data], np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    model = Model(labels, np.zeros((1 << BITS, n), np.float32), np.zeros(0, np.uint64), np.zeros((1, n), np.float32), np.full(n, 0.2, np.float32), np.zeros(n), np.zeros((n, n)))
    if not len(begin):
        return model
    gold = np.repeat([labels.index(x) for x in langs], counts)
    hashes, at, which = np.unique(hash_spans(data, begin, end), return_index=True, return_inverse=True)
    seen = np.zeros((len(hashes), n))
    np.add.at(seen, (which, gold), 1)
    # The lexicon: the most frequent training words that came twice at least, with smoothed log shares of the languages.
    total = seen.sum(axis=1)
    keep = np.sort(np.argsort(-total, kind="stable")[:lexicon])
    keep = keep[total[keep] >= 2]
    share = np.log((seen[keep] + 0.5) / (total[keep, None] + 0.5 * n))
    model.lexicon, model.entries = hashes[keep], np.concatenate([np.zeros((1, n)), share - share.mean(axis=1, keepdims=True)]).astype(np.float32)
    entry = model.entries[find(model.lexicon, hashes)]

    ids, per = gram_ids(data, begin[at], end[at])
    word = np.repeat(np.arange(len(per)), per)
    first, length = chains(counts)
    place = np.minimum(first[:, None] + np.arange(CHAIN), len(which) - 1)
    live = np.arange(CHAIN)[None, :] < length[:, None]
    target = np.eye(n)[gold]
    # Each language weighs the same, whatever its share of the sample.
    balance = (len(gold) / (n * np.bincount(gold, minlength=n).clip(1)))[gold[first]]
    params = {"grams": model.grams.astype(np.float64), "weight": model.weight.astype(np.float64), "start": model.start, "trans": model.trans}
    m1, m2 = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}
    rng = np.random.default_rng(seed)
    batch = 1024
    for step in range(1, steps + 1):
        pick = rng.permutation(len(first))[:batch]
        used = np.unique(which[place[pick]][live[pick]])
        slot = np.zeros(len(per), np.int64)
        slot[used] = np.arange(len(used))
        mine = np.zeros(len(per), dtype=bool)
        mine[used] = True
        sel = mine[word]
        gi, gw = ids[sel], slot[word[sel]]
        scores = np.stack([np.bincount(gw, params["grams"][gi, k], len(used)) for k in range(n)], axis=1) + entry[used] * params["weight"]
        e = scores[slot[which[place[pick]]]]
        c = forward_backward(e, length[pick], params["start"], params["trans"])
        w = balance[pick][:, None, None] / live[pick].sum()
        d = (marginals(c) - target[place[pick]]) * c.live[:, :, None] * w
        by_word = np.zeros((len(used), n))
        np.add.at(by_word, slot[which[place[pick]]].reshape(-1), d.reshape(-1, n))
        move = np.exp(params["trans"])
        # Expected less seen transitions as matrix products: no array of chains by words by labels squared.
        left, right = c.alpha[:, :-1].reshape(-1, n), (c.factor[:, 1:] * c.beta[:, 1:]).reshape(-1, n)
        each = (c.live[:, 1:] * w[..., 0]).reshape(-1, 1)
        held = target[place[pick]]
        pair = move * (left.T @ (right * (each / ((left @ move) * right).sum(axis=1, keepdims=True))))
        pair -= held[:, :-1].reshape(-1, n).T @ (held[:, 1:].reshape(-1, n) * each)
        grad = {
            "grams": np.stack([np.bincount(gi, by_word[gw, k], 1 << BITS) for k in range(n)], axis=1),
            "weight": (by_word * entry[used]).sum(axis=0),
            "start": d[:, 0].sum(axis=0),
            "trans": pair,
        }
        for k, g in grad.items():
            g = g + decay * params[k] * (0.02 if k == "grams" else 1)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            params[k] = params[k] - rate / (1 + 4 * step / steps) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    model.grams, model.weight = params["grams"].astype(np.float32), params["weight"].astype(np.float32)
    model.start, model.trans = params["start"], params["trans"]
    return model


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def drawn_rows(docs: DataFrame, per_lang: int = 200, most_rows: int = 2400, most_bytes: int = 16 << 20) -> DataFrame | None:
    """Training rows (lang, draw, text), None if there are none: about ``per_lang`` documents of each language, fewer each if that makes more than ``most_rows``
    or more than ``most_bytes`` of text, but one of each at least.

    Drawn by a hash of id and text from all training rows (not held out, lang not null,
    some text), whatever their length: a language takes documents in the order of the
    draw while they fit in its share of the bytes, and if none fits its shortest drawn
    one. Equal rows are drawn once. Bounded by the number of languages, whatever the
    input's size.
    """
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 30))
    rows = docs.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(draw.alias("draw"), "lang", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min("draw").alias("least")).collect()
    if not counts:
        return None
    per_lang, room = max(1, min(per_lang, most_rows // len(counts))), most_bytes // len(counts)
    # A language's least draw is always below its share, so that none goes without a row.
    shares = {r["lang"]: max(r["least"] + 1, min(1 << 30, int((1 << 30) * 1.1 * per_lang / r["count"]))) for r in counts}
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("lang")]
    drawn = rows.filter(F.col("draw") < share)
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in drawn.groupBy("lang", "draw").agg(F.min(F.octet_length("text")).alias("size")).collect():
        sizes.setdefault(r["lang"], []).append((r["draw"], r["size"]))
    picked = []
    for lang, pairs in sizes.items():
        left, own = room, []
        for k, size in sorted(pairs):
            if len(own) < per_lang and size <= left:
                left -= size
                own.append((lang, k))
        picked += own or [(lang, min(pairs, key=lambda p: (p[1], p[0]))[0])]
    chosen = docs.sparkSession.createDataFrame(picked, "_lang string, _draw long")
    return drawn.join(F.broadcast(chosen), (F.col("lang") == F.col("_lang")) & (F.col("draw") == F.col("_draw"))).groupBy("lang", "draw").agg(F.min_by("text", F.octet_length("text")).alias("text"))


def _ordered(rows: list[dict]) -> list[tuple[str, str]]:
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["draw"], r["lang"]))]


def sample(docs: DataFrame, **kw) -> list[tuple[str, str]]:
    """The training rows (text, lang) of ``drawn_rows`` in the order of the draw."""
    rows = drawn_rows(docs, **kw)
    return [] if rows is None else _ordered([r.asDict() for r in rows.collect()])


def fit(docs: DataFrame, **kw) -> Model | None:
    """A model of the documents' languages; None without training rows.

    One task trains it: the sample is bounded, and only the model comes to the driver, whose
    memory the training's n-grams and messages would fill.
    """
    rows = drawn_rows(docs, **kw)
    if rows is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ordered([r for b in batches for r in b.to_pylist()])
        if own:
            model = train([t for t, _ in own], [g for _, g in own])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = map_arrow(rows.coalesce(1), run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def has_letter(data: np.ndarray) -> bool:
    if ((data | 32) - np.uint8(97) < 26).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and score (the language's expected share of the words) to each document.

    lang_pred is ``und`` with score 0 where the text is null, empty or without a
    letter, or where there is no model. Only the text is looked at. Ties go to the
    first language in code point order. Other columns pass through; ones named
    lang_pred or score are replaced; repeated rows are repeated.
    """
    docs = docs.drop("lang_pred", "score")
    schema = extended(docs, lang_pred="string", score="double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(batch.schema.get_field_index("text"))):
                n = hi - lo
                ok = np.array([has_letter(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], dtype=bool) if m else np.zeros(n, dtype=bool)
                langs, scores = ["und"] * n, np.zeros(n)
                if ok.any():
                    shares, counts = m.shares(data, offsets)
                    best = shares.argmax(axis=1)
                    scores = np.where(ok, np.clip(shares[np.arange(n), best] / np.maximum(counts, 1), 0, 1), 0.0)
                    langs = [m.labels[k] if f else "und" for k, f in zip(best, ok)]
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return map_arrow(docs, run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of whole documents, by a model learned from the rows that aren't held out."""
    d = identify(docs.select("doc_id", "text"), fit(docs))
    return d.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
