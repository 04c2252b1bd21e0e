"""Removal of passages that occur more than once: seed and extend.

Seeds are winnowed anchors: of each 35-word window the k-word gram with the least
hash. Equal windows have equal anchors, so a window whose anchor occurs once in
the corpus cannot repeat. Only windows around repeated anchors are extended: the
anchor's occurrences are joined through the digests of the windows that hold it,
for every extent to the left and right at once, and a maximal repeat is a run of
windows found that way. No pairs of occurrences are formed, so a passage
that a third of the documents share costs one row per occurrence.

What travels is counted from the other end: of both anchors and windows the ones
that occur *once* are kept, since those are exact after one partial aggregation
and need no join back to their occurrences.

Windows are compared by 128-bit digests. A row is known by 88 bits: a hash of its
doc_id and text and 24 bits of another hash of the text, so rows without an id and
repeated ids with different texts stay apart. Rows with equal id and text need no telling
apart: nothing that they hold occurs once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import WHITE, chunks, hash_spans, hash_windows, mix64, ramp, spans
from .common import checkpointed, extended, map_arrow

#: Words of a repeat, and of an anchor.
LENGTH, ANCHOR = 35, 12


def owners(words: np.ndarray, counts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, first word of its anchor, hash of each k-gram) over the flat word sequence.

    A window's anchor is its k-gram of least hash, the rightmost of equal ones:
    a function of the window's words alone.
    """
    grams = hash_windows(words, anchor)
    starts = np.flatnonzero(ramp(counts) + length <= np.repeat(counts, counts))
    if not len(starts):
        return starts, starts, grams
    n = len(grams)
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | (low - (np.arange(n, dtype=np.uint64) & low))
    width = length - anchor + 1
    best, have = key, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: n - width + 1], best[width - have : n - have + 1])
    at = best[starts] & low
    place = starts + ((low - at).astype(np.int64) - starts) % (1 << 24)
    return starts, place, grams


class Texts:
    """Words, windows and anchors of one chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> None:
        self.data = data
        self.begin, self.end, self.counts = spans(~WHITE[data], offsets)
        self.words = hash_spans(data, self.begin, self.end)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.starts, self.place, self.grams = owners(self.words, self.counts, length, anchor)

    def loc(self, at: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Word position inside the text and the text's tag in one number."""
        row = self.row[at]
        return ((at - self.first[row]) << 24) | tag[row]


def _tag(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_ov_id", F.xxhash64("doc_id", "text")).withColumn("_ov_tag", F.xxhash64(F.lit(2), "text").bitwiseAND(F.lit(0xFFFFFF)))


def removals(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Add n_words, n_removed and kept (the words left, joined by one space) to each document.

    Words are runs outside blank and \\x09-\\x0D, unchanged. A word goes if a window
    of ``length`` words that covers it occurs at another place too, in the same
    document or another; all windows are judged on the input. Null and empty texts
    have no words and keep the empty text; texts under ``length`` words keep all;
    a repeated row counts as another place; ids that are missing or repeat do no harm;
    an empty table gives no rows. Other columns pass through; ones of the new names, in
    any case, are replaced.
    """
    d = _keyed(docs.drop("n_words", "n_removed", "kept"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = np.asarray(b.column(0)), _tag(b.column(1))
            for lo, hi, data, offsets in chunks(b.column(2)):
                t = Texts(data, offsets, length, anchor)
                at = np.unique(t.place)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(t.grams[at].view(np.int64)), pa.array(ids[lo:hi][t.row[at]]), pa.array(t.loc(at, tags[lo:hi]))], names=["h", "id", "loc"])

    seeds = map_arrow(d.select("_ov_id", "_ov_tag", "text"), anchors, "h long, id long, loc long")
    once = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("loc").alias("loc")).filter("n = 1")
    lonely = checkpointed(_per_text(once, "_ov_a"))
    d = d.join(lonely.hint("shuffle_hash"), ["_ov_id", "_ov_tag"], "left")  # no sort of texts

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda k: b.column(b.schema.get_field_index(k))  # noqa: E731, B023
            ids, tags, lists = np.asarray(col("_ov_id")), _tag(col("_ov_tag")), col("_ov_a")
            for lo, hi, data, offsets in chunks(col("text")):
                t = Texts(data, offsets, length, anchor)
                at = t.starts[~_listed(t, t.place, lists, lo, hi)]
                if len(at):
                    one, two = hash_windows(t.words, length), hash_windows(mix64(t.words), length, 1)
                    for i in range(0, len(at), 1 << 17):
                        a = at[i : i + (1 << 17)]
                        yield pa.RecordBatch.from_arrays([pa.array(one[a].view(np.int64)), pa.array(two[a].view(np.int64)), pa.array(ids[lo:hi][t.row[a]]), pa.array(t.loc(a, tags[lo:hi]))], names=["h", "g", "id", "loc"])

    spread = map_arrow(d, windows, "h long, g long, id long, loc long")
    once = spread.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("loc").alias("loc")).filter("n = 1")
    d = d.join(_per_text(once, "_ov_w").hint("shuffle_hash"), ["_ov_id", "_ov_tag"], "left")
    keep = [f for f in docs.schema.fieldNames() if f.lower() not in ("n_words", "n_removed", "kept")]
    schema = extended(docs.select(*keep), n_words="long", n_removed="long", kept="string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda k: b.column(b.schema.get_field_index(k))  # noqa: E731, B023
            for lo, hi, data, offsets in chunks(col("text")):
                t = Texts(data, offsets, length, anchor)
                seeded = t.starts[~_listed(t, t.place, col("_ov_a"), lo, hi)]
                repeat = seeded[~_listed(t, seeded, col("_ov_w"), lo, hi)]
                step = np.zeros(len(t.words) + 1, np.int64)
                step[repeat] += 1
                step[repeat + length] -= 1
                stay = np.cumsum(step)[:-1] == 0
                counts = np.diff(np.concatenate([[0], np.cumsum(stay)])[t.first])
                part = b.slice(lo, hi - lo)
                new = [pa.array(t.counts), pa.array(t.counts - counts), joined(data, t.begin[stay], t.end[stay], counts)]
                yield pa.RecordBatch.from_arrays([*[part.column(b.schema.get_field_index(k)) for k in keep], *new], names=schema.fieldNames())

    return map_arrow(d, cut, schema)


def _per_text(once: DataFrame, name: str) -> DataFrame:
    """The places of a text in one row; no group is larger than its text."""
    d = once.select(F.col("id").alias("_ov_id"), F.col("loc").bitwiseAND(F.lit(0xFFFFFF)).alias("_ov_tag"), F.shiftright("loc", 24).cast("int").alias("p"))
    return d.groupBy("_ov_id", "_ov_tag").agg(F.collect_list("p").alias(name))


def _listed(t: Texts, at: np.ndarray, lists: pa.Array, lo: int, hi: int) -> np.ndarray:
    """Which of the flat word places are in their text's list."""
    part = lists.slice(lo, hi - lo)
    mark = np.zeros(len(t.words) + 1, dtype=bool)
    sizes = np.asarray(part.value_lengths().fill_null(0))
    mark[np.asarray(part.flatten()) + np.repeat(t.first[:-1], sizes)] = True
    return mark[at]


def joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Per text its spans' bytes joined by one space."""
    # Each span is copied with one more byte, which becomes the blank after it.
    wide = end - begin + 1
    total = int(wide.sum())
    if total == 0:
        return pa.array([""] * len(counts), pa.string())
    src = np.repeat(begin - (np.cumsum(wide) - wide), wide) + np.arange(total)
    out = np.append(data, np.uint8(32))[src]
    after = np.cumsum(wide)
    out[after - 1] = 32
    last = np.concatenate([[0], np.cumsum(counts)])
    drop = np.ones(total, dtype=bool)
    full = counts > 0
    drop[after[last[1:][full] - 1] - 1] = False
    out = out[drop]
    sums = np.concatenate([[0], after])[last] - np.concatenate([[0], np.cumsum(full)])
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(sums.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of whole texts."""
    d = removals(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: The same rows by plain windows: every 35 words as one string, counted over all documents.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), x AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (
  SELECT rid, i, count(*) OVER (PARTITION BY win) AS n FROM x
), gone AS (
  SELECT DISTINCT rid, i + k AS p FROM r, range(35) t(k) WHERE n > 1
), word AS (
  SELECT rid, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT rid, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
