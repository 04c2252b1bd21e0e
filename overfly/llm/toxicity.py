"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of a hashed embedding of the word and one of its first
bytes. Filters of widths 1 to 3 run over the words; each filter's maxima over the
quarters of a text, sorted, feed one logistic unit, so both a single hit and its
repetition count. Training (NumPy, driver, bounded sample) sends gradients only
through the maxima. Decision thresholds are calibrated for each language as read off
the text itself by a hashed word profile, and folded into the score, so 0.5 is the bar
everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, hash_spans, ramp, spans
from .common import extended, give_back, map_arrow
from .labelled import training_rows
from .langcrf import LETTER, held_out, lower

BITS, DIM, FILTERS, WIDTHS, PARTS, PREFIX = 16, 12, 8, (1, 2, 3), 4, 6
SLOTS = 1 << BITS
MOST, MOST_BYTES = 4000, 24 << 20
#: Bytes of text scored at a time.
CHUNK = 1 << 19


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((word slot, prefix slot) of each letter run, counts per text)."""
    low = lower(data)
    begin, end, counts = spans(LETTER[low], offsets)
    if not len(begin):
        return np.zeros((0, 2), np.int64), counts
    top = np.uint64(64 - BITS)
    word = (hash_spans(low, begin, end) >> top).astype(np.int64)
    start = (hash_spans(low, begin, np.minimum(begin + PREFIX, end)) >> top).astype(np.int64)
    return np.stack([word, start + SLOTS], axis=1), counts


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: float
    langs: list[str]
    profile: np.ndarray
    shift: np.ndarray

    def projected(self) -> np.ndarray:
        """The table times every filter row: (2 * SLOTS, rows of all widths * FILTERS)."""
        return np.concatenate([self.table @ f[j] for f in self.filters for j in range(len(f))], axis=1).astype(np.float32)


def maxima(act: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted maxima, their places) over each text's quarters: (texts, PARTS, FILTERS).

    act: activations by first word; windows that leave their text count as -inf and
    an empty quarter as 0.
    """
    n = len(counts)
    first = np.cumsum(counts) - counts
    value = np.zeros((n, PARTS, act.shape[1]), act.dtype)
    place = np.full((n, PARTS, act.shape[1]), -1)
    usable = np.maximum(counts - width + 1, 0)
    edge = (usable[:, None] * np.arange(PARTS + 1)) // PARTS
    lo, hi = (first[:, None] + edge[:, :-1]).reshape(-1), (first[:, None] + edge[:, 1:]).reshape(-1)
    full = np.flatnonzero(hi > lo)
    if len(full):
        # Segments with gaps between them: every second boundary ends one.
        cuts = np.stack([lo[full], hi[full]], axis=1).reshape(-1)
        padded = np.concatenate([act, np.full((1, act.shape[1]), -np.inf, act.dtype)])
        best = np.maximum.reduceat(padded, cuts, axis=0)[::2]
        value.reshape(-1, act.shape[1])[full] = np.maximum(best, 0)
        place.reshape(-1, act.shape[1])[full] = lo[full][:, None]
    return value, place


def pooled(net: Net, table: np.ndarray, s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, widths * PARTS * FILTERS): each filter's quarter maxima, largest first."""
    if not len(s):
        return np.zeros((len(counts), len(WIDTHS) * PARTS * FILTERS), np.float32)
    rows = table[s[:, 0]] + table[s[:, 1]]
    out, col = [], 0
    for w in WIDTHS:
        act = rows[:, col : col + FILTERS].copy()
        for j in range(1, w):
            if len(act) > j:
                act[:-j] += rows[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
        col += w * FILTERS
        v = maxima(act, counts, w)[0]
        out.append(-np.sort(-v, axis=1))
    return np.concatenate([v.reshape(len(counts), -1) for v in out], axis=1)


def language(net: Net, s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of the language whose word profile fits best."""
    out, first = np.zeros((len(counts), len(net.langs))), np.cumsum(counts) - counts
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(net.profile[s[:, 0]], first[some], axis=0)
    return out.argmax(axis=1)


def logits(net: Net, table: np.ndarray, s: np.ndarray, counts: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """One number per text; about ``most`` words at a time."""
    ends = np.cumsum(counts)
    out, lo = [np.zeros(0)], 0
    while lo < len(counts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        out.append(pooled(net, table, s[base : ends[hi - 1]], counts[lo:hi]) @ net.out + net.bias)
        lo = hi
    return np.concatenate(out)


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``slots`` of a list of texts, a chunk of bytes at a time."""
    parts = [slots(data, offsets) for _, _, data, offsets in chunks(pa.array(texts, pa.string()), CHUNK)]
    if not parts:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([p[1] for p in parts])


def train(texts: list[str], y: np.ndarray, langs: list[str], epochs: int | None = None, batch: int = 64, rate: float = 0.02, seed: int = 1) -> Net:
    """Adam on logistic loss; a fifth of the rows is kept for the thresholds."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs)) or ["und"]
    net = Net(np.zeros((2 * SLOTS, DIM), np.float32), [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * PARTS * FILTERS), -2.0, names, np.zeros((SLOTS, len(names)), np.float32), np.zeros(len(names)))
    for f in net.filters:
        f[:, 0, : FILTERS // 2] += 0.5
    s, counts = slots_of(texts)
    if not len(s) or y.min() == y.max():
        net.bias = 4.0 if len(y) and y.min() == 1 else -4.0
        return net
    texts.clear()
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    kind = np.array([names.index(x) for x in langs])
    seen = np.zeros((SLOTS, len(names)))
    np.add.at(seen, (s[:, 0], kind[doc]), 1)
    net.profile = np.log((seen + 0.1) / (seen.sum(axis=0) + 0.1 * SLOTS)).astype(np.float32)
    calib = rng.random(len(y)) < 0.2
    learn = np.flatnonzero(~calib)
    # Document frequencies by class give the first component and say which slots are learned at all.
    freq = np.zeros((2 * SLOTS, 2))
    for k in (0, 1):
        pair = np.unique(doc.astype(np.int64) * (2 * SLOTS) + s[:, k])
        d, slot = pair // (2 * SLOTS), pair % (2 * SLOTS)
        keep = ~calib[d]
        np.add.at(freq, (slot[keep], y[d[keep]].astype(int)), 1)
    n1, n0 = y[learn].sum(), (1 - y[learn]).sum()
    odds = np.log((freq[:, 1] + 0.5) / (n1 + 1)) - np.log((freq[:, 0] + 0.5) / (n0 + 1))
    live = freq.sum(axis=1) >= 3
    # Slots seen mostly in one class are sure in proportion to how often they were seen.
    net.table[:, 0] = np.where(live, np.clip(odds * np.minimum(1, freq.sum(axis=1) / 8), -3, 3) / 3, 0)
    net.table[live, 1:] = rng.normal(0, 0.05, (int(live.sum()), DIM - 1))
    net.out.reshape(len(WIDTHS), PARTS, FILTERS)[:, :, : FILTERS // 2] = 0.1
    params = {"table": net.table, "out": net.out, "bias": np.array([net.bias]), **{f"f{i}": f for i, f in enumerate(net.filters)}}
    m1 = {k: np.zeros(v.shape) for k, v in params.items() if k != "table"}
    m2 = {k: np.zeros(v.shape) for k, v in params.items() if k != "table"}
    sq = np.full(2 * SLOTS, 1e-4)
    weight = np.where(y == 1, np.clip(n0 / max(n1, 1), 1, 4), 1.0)
    step = 0
    epochs = epochs or int(np.clip(20_000 // len(learn), 5, 25))
    for epoch in range(epochs):
        order = rng.permutation(learn)
        for i in range(0, len(order), batch):
            step += 1
            docs_ = order[i : i + batch]
            c = counts[docs_]
            at = np.repeat(first[docs_], c) + ramp(c)
            ss = s[at]
            emb = net.table[ss[:, 0]] + net.table[ss[:, 1]]
            feats, keep = [], []
            for w, f in zip(WIDTHS, net.filters):
                f = f.astype(np.float32)
                act = emb @ f[0]
                for j in range(1, w):
                    if len(act) > j:
                        act[:-j] += emb[j:] @ f[j]
                v, p = argmaxima(act, c, w)
                rank = np.argsort(-v, axis=1, kind="stable")
                feats.append(np.take_along_axis(v, rank, axis=1))
                keep.append((np.take_along_axis(p, rank, axis=1), np.take_along_axis(v, rank, axis=1) > 0))
            x = np.stack(feats, axis=1).reshape(len(docs_), -1)
            z = x @ net.out + net.bias
            err = (1 / (1 + np.exp(-z)) - y[docs_]) * weight[docs_] / len(docs_)
            back = (err[:, None] * net.out[None, :]).reshape(len(docs_), len(WIDTHS), PARTS, FILTERS)
            grad = {"out": x.T @ err + 1e-4 * net.out, "bias": np.array([err.sum()])}
            gslot, gvec = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, net.filters)):
                p, on = keep[k]
                d, q, fi = np.nonzero(on)
                pos, g = p[d, q, fi], back[d, k, q, fi]
                gf = np.zeros_like(f)
                for j in range(w):
                    at_filter = np.zeros((FILTERS, len(pos)))
                    at_filter[fi, np.arange(len(pos))] = g
                    gf[j] = (at_filter @ emb[pos + j]).T
                    ge = g[:, None] * f[j][:, fi].T
                    for col in (0, 1):
                        gslot.append(ss[pos + j, col])
                        gvec.append(ge)
                grad[f"f{k}"] = gf + 1e-4 * f
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                new = rate / (1 + 3 * epoch / epochs) * 0.3 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
                if k == "bias":
                    net.bias = float(net.bias - new[0])
                else:
                    params[k] -= new
            gslot, gvec = np.concatenate(gslot), np.concatenate(gvec)
            u, inv = np.unique(gslot, return_inverse=True)
            total = np.stack([np.bincount(inv, gvec[:, k], len(u)) for k in range(DIM)], axis=1)
            ok = live[u]
            u, total = u[ok], total[ok]
            sq[u] += (total**2).mean(axis=1)
            net.table[u] -= (rate * total / np.sqrt(sq[u])[:, None]).astype(np.float32)
    table = net.projected()
    z = logits(net, table, s, counts)
    net.shift = thresholds(z[calib], y[calib], language(net, s, counts)[calib], len(names))
    return net


def argmaxima(act: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``maxima``, with the first place of each maximum."""
    v, lo = maxima(act, counts, width)
    n, f = len(counts), act.shape[1]
    first = np.cumsum(counts) - counts
    usable = np.maximum(counts - width + 1, 0)
    edge = (usable[:, None] * np.arange(PARTS + 1)) // PARTS
    size = np.diff(edge, axis=1)
    seg = np.repeat(np.arange(n * PARTS), size.reshape(-1))
    at = np.repeat((first[:, None] + edge[:, :-1]).reshape(-1), size.reshape(-1)) + ramp(size.reshape(-1))
    hit = act[at] >= v.reshape(-1, f)[seg]
    r, c = np.nonzero(hit)
    place = np.full((n * PARTS, f), -1)
    place[seg[r[::-1]], c[::-1]] = at[r[::-1]]
    return v, place.reshape(n, PARTS, f)


def thresholds(z: np.ndarray, y: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """The logit of each language that serves F1 about best on the calibration rows; few positives take all languages' logit."""

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        z, y = z[order], y[order]
        tp = np.cumsum(y)
        f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
        # Among cuts that serve F1 almost alike, the one that catches most.
        k = np.flatnonzero(f1 >= 0.99 * f1.max())[-1]
        return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)

    every = best(z, y) if y.sum() >= 3 else 0.0
    return np.array([best(z[kind == k], y[kind == k]) if y[kind == k].sum() >= 12 else every for k in range(n)])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> Net:
    """A net learned from at most ``most`` labelled rows, of ``most_bytes`` of text together, that aren't held out.

    The training rows' ``lang`` shapes the profiles by which a text's language is told for
    its threshold; a score itself reads nothing but the text.
    """
    rows = training_rows(docs.select("doc_id", "text", "lang"), labels, "toxic", most, most_bytes).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"), "_y").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    net = train([r["text"] for r in rows], np.array([r["_y"] for r in rows], dtype=np.float64), [r["lang"] for r in rows])
    del rows
    give_back()
    return net


def classify(docs: DataFrame, net: Net) -> DataFrame:
    """Add score and predicted (score >= 0.5) to each document, from its text alone.

    Null, empty and letterless texts get the score of no hit; other columns pass
    through, ones of these names are replaced; repeated rows are repeated.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((net, net.projected()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(b.schema.get_field_index("text")), CHUNK):
                s, counts = slots(data, offsets)
                z = logits(m, table, s, counts) - (m.shift[language(m, s, counts)] if len(s) else m.shift.mean())
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return map_arrow(docs, run, extended(docs, score="double", predicted="int"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of whole documents."""
    d = classify(docs.select("doc_id", "text"), fit(docs, labels))
    return d.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
