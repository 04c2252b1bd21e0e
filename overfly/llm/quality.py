"""Quality classification by histogram gradient-boosted trees over document statistics.

The trees are grown in NumPy on the driver from the statistics (not the texts) of a
bounded sample, level by level on 64 quantile bins, and flattened into arrays that
a whole batch walks down at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, WHITE, chunks, hash_spans, hash_windows, ramp, spans
from .common import extended, map_arrow
from .labelled import training_rows
from .langcrf import held_out

BINS, DEPTH, TREES, RATE, MOST = 64, 4, 80, 0.15, 20_000

KIND = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "pipe": b"|",
    "symbol": b"#$%&*+=<>^~\\", "markup": b"{}[]()", "quote": b"\"'`", "slash": b"/:@_-;", "white": b"\x09\x0a\x0b\x0c\x0d\x20", "line": b"\n",
}
MASKS = np.zeros((len(KIND), 256), dtype=np.float32)
for _i, _chars in enumerate(KIND.values()):
    MASKS[_i, list(_chars)] = 1

NAMES = [
    "log_bytes", "log_words", *[f"share_{k}" for k in KIND], "share_wide", "word_bytes", "word_spread", "line_words", "distinct_words",
    "distinct_pairs", "distinct_lines", "top_word", "same_as_last", "short_words", "long_words", "symbol_ends", "upper_words",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text; an empty text has zeros."""
    size = np.diff(offsets)
    n = len(size)

    def summed(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[first + counts] - sums[first]

    per = lambda v, w: v / np.maximum(w, 1)
    begin, end, counts = spans(~WHITE[data], offsets)
    first = np.cumsum(counts) - counts
    low = LOWER[data]
    words = hash_spans(low, begin, end) if len(begin) else np.zeros(0, np.uint64)
    width = (end - begin).astype(np.float64)
    lb, le, lines = spans(data != 10, offsets)
    line = hash_spans(data, lb, le) if len(lb) else np.zeros(0, np.uint64)
    lf = np.cumsum(lines) - lines
    out = [np.log1p(size), np.log1p(counts)]
    out += [per(summed(m[data], offsets[:-1], size), size) for m in MASKS]
    out.append(per(summed(data >= 128, offsets[:-1], size), size))
    mean = per(summed(width, first, counts), counts)
    out += [mean, np.sqrt(np.maximum(per(summed(width**2, first, counts), counts) - mean**2, 0)), per(counts, lines)]
    distinct, top, pairs, unique_lines = (np.zeros(n) for _ in range(4))
    two = hash_windows(words, 2)
    for i in range(n):
        c, f = counts[i], first[i]
        if c:
            k = np.unique(words[f : f + c], return_counts=True)[1]
            distinct[i], top[i] = len(k) / c, k.max() / c
            pairs[i] = len(np.unique(two[f : f + c - 1])) / (c - 1) if c > 1 else 1
        if lines[i]:
            unique_lines[i] = len(np.unique(line[lf[i] : lf[i] + lines[i]])) / lines[i]
    out += [distinct, pairs, unique_lines, top]
    again = np.zeros(len(words))
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (ramp(counts)[1:] > 0)
    out += [per(summed(again, first, counts), counts), per(summed(width <= 2, first, counts), counts), per(summed(width >= 12, first, counts), counts)]
    odd, upper = MASKS[list(KIND).index("symbol")], MASKS[0]
    last = odd[data[end - 1]] if len(end) else np.zeros(0)
    caps = upper[data[begin]] * upper[data[np.minimum(begin + 1, end - 1)]] if len(begin) else np.zeros(0)
    out += [per(summed(last, first, counts), counts), per(summed(caps, first, counts), counts)]
    return np.stack(out, axis=1).astype(np.float64)


@dataclass
class Trees:
    """Complete binary trees in heap order: node i's children are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            z += v[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Boost logistic loss with second-order steps."""
    n, d = x.shape
    prior = np.clip(y.mean(), 0.01, 0.99) if n else 0.5
    model = Trees(float(np.log(prior / (1 - prior))), np.zeros((trees, 2**DEPTH - 1), np.int64), np.full((trees, 2**DEPTH - 1), np.inf), np.zeros((trees, 2**DEPTH)))
    if n == 0:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    z = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            at, many = 2**level - 1, 2**level
            local = node - at
            best = np.full(many, 1e-6)
            for j in range(d):
                key = local * BINS + bins[:, j]
                gs = np.bincount(key, g, many * BINS).reshape(many, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, many * BINS).reshape(many, BINS).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(hs < least) | (ha - hs < least)] = -1
                cut = gain[:, : len(edges[j])].argmax(axis=1) if len(edges[j]) else np.zeros(many, np.int64)
                found = gain[np.arange(many), cut] if len(edges[j]) else np.full(many, -1.0)
                better = found > best
                best[better] = found[better]
                model.feature[t, at : at + many][better] = j
                if better.any():
                    model.threshold[t, at : at + many][better] = edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.threshold[t][node])
        local = node - (2**DEPTH - 1)
        step = -rate * np.bincount(local, g, 2**DEPTH) / (np.bincount(local, h, 2**DEPTH) + l2)
        model.leaf[t] = step
        z += step[local]
    return model


def with_statistics(docs: DataFrame) -> DataFrame:
    """Add ``stats array<double>``; null texts count as empty."""
    docs = docs.drop("stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(b.schema.get_field_index("text"))):
                x = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.reshape(-1)))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "stats"])

    return map_arrow(docs, run, extended(docs, stats="array<double>"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Trees:
    """Trees learned from at most ``most`` labelled rows that aren't held out; only their statistics reach the driver."""
    rows = training_rows(docs.select("doc_id", "text"), labels, "quality", most)
    got = with_statistics(rows).select("_y", "stats").toArrow()
    y = np.asarray(got.column("_y")).astype(np.float64)
    x = np.array(got.column("stats").to_pylist(), dtype=np.float64).reshape(len(y), len(NAMES))
    order = np.lexsort((*x.T, y))
    return grow(x[order], y[order])


def classify(docs: DataFrame, model: Trees, bar: float = 0.3) -> DataFrame:
    """Add score and predicted (score >= ``bar``) to each document, from its text alone.

    Null and empty texts are scored by their zero statistics; other columns pass
    through, ones of these names are replaced; repeated rows are repeated.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(b.schema.get_field_index("text"))):
                s = shared.value.score(statistics(data, offsets))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= bar).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return map_arrow(docs, run, extended(docs, score="double", predicted="int"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of whole documents."""
    d = classify(docs.select("doc_id", "text"), fit(docs, labels))
    return d.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
