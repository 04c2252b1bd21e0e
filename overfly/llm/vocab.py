"""Vocabularies of shards: strings numbered by first appearance, and their way to where all copies of a string meet.

As rows of their own, a corpus's words cost several times the disk of its text. Here the
words of one shard (and group) that fall into one bucket by their hash travel as one row,
joined by line feeds, with their slots as ascending steps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import hash_spans, ramp

ROW = "shard long, bucket int, tag string, slots array<int>, counts array<long>, words string"
NAMES = [f.split()[0] for f in ROW.split(", ")]


#: Bytes of text, on average, whose strings a bucket holds.
BUCKET = 16 << 20


def buckets_of(texts: DataFrame, column: str = "text") -> int:
    """As many buckets as the session has shuffle partitions, and more where a bucket would hold the strings of over ``BUCKET`` bytes.

    A task holds what is distinct in its bucket, so a fixed number would let its memory grow
    with the input. One pass over the texts adds up their bytes.
    """
    n = texts.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))


def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct byte strings of spans by first appearance, each span's index among them)."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    raw = data.tobytes()
    _, first, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    like = first[which]
    same = np.array_equal(size, size[like])
    if same:
        at = ramp(size)
        same = np.array_equal(data[np.repeat(starts, size) + at], data[np.repeat(starts[like], size) + at])
    if not same:
        # Two strings of one hash: go by the strings themselves.
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())])
        return list(seen), which
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [raw[a:b] for a, b in zip(starts[first[order]].tolist(), ends[first[order]].tolist())], place[which]


def steps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each list's first value, then the steps to the next: small numbers, which compress."""
    out = np.diff(values, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    out[first] = values[first]
    return out


def unstepped(deltas: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(deltas)
    first = np.cumsum(counts) - counts
    return total - np.repeat(np.concatenate([[0], total])[first], counts)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    """A list column of these values, so many to a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values).cast(kind))


def flat_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values joined, number per row) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.asarray(column.flatten()).astype(np.int64), np.asarray(column.value_lengths()).astype(np.int64)


def rows(shard: int, tags: list[str], words: list[str], counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A shard's vocabulary as ``ROW``s: one per tag and bucket. Words hold no line feed; slots are places in ``words``."""
    names = sorted(set(tags))
    code = {t: i for i, t in enumerate(names)}
    place = np.fromiter((bucket(w, buckets) for w in words), np.int64, len(words))
    cell = place * len(names) + np.fromiter((code[t] for t in tags), np.int64, len(tags))
    order = np.argsort(cell, kind="stable")
    which, size = np.unique(cell, return_counts=True)
    ends = np.cumsum(size)
    joined = ["\n".join([words[i] for i in order[e - c : e].tolist()]) for e, c in zip(ends, size)]
    columns = [
        pa.array([shard] * len(which), pa.int64()), pa.array(which // len(names), pa.int32()), pa.array([names[i] for i in (which % len(names)).tolist()], pa.string()),
        lists(steps(order, size), size), lists(counts[order], size, pa.int64()), pa.array(joined, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def gathered(vocabulary: DataFrame, buckets: int) -> DataFrame:
    """``ROW``s dealt out so that all copies of a word are in one partition."""
    return by_bucket(vocabulary.select(*NAMES), buckets)


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """A partition for each ``bucket``: dealt out by a hash of the number, some tasks would get five or six and others none."""
    return rows.repartitionById(buckets, F.col("bucket"))
