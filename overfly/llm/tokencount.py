"""Tokens per document, counted by distinct pre-token; ids are never made.

A BPE vocabulary reads each pre-token on its own, so a text's token count is the sum,
over its distinct pre-tokens, of frequency times pieces. Three steps:

1. Each task turns its texts into pre-token frequencies. Words between white space are
   normalised and split once per distinct word; a document keeps (slot, frequency) pairs
   over its generation's vocabulary. A generation is a stretch of a task's documents that
   ends when its vocabulary or its texts reach a bound.
2. Vocabularies travel by the pre-token's hash bucket, a bucket's words of one generation
   in one row, and each distinct pre-token's pieces are counted once, where all its copies
   meet.
3. The counts go back to their generations, meet the documents' frequencies and are summed.

Style: Arrow and NumPy. As rows of their own, vocabulary words would take several times
the disk: corpora with many rare words repeat few of them. Memory is bounded by a text, a
generation, and a bucket's distinct words. What is needed twice is written to the shared
folder once, so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .arrays import WHITE, chunks, ramp, spans
from .common import checkpointed, map_arrow, removed, shared_folder, ship
from .vocab import distinct_spans, flat_lists, lists, steps, unstepped

#: Bytes of text handled at a time.
CHUNK = 1 << 20
#: Pre-tokens, and bytes of text, after which a generation ends.
WORDS, TEXT = 200_000, 16 << 20
#: Contract value: tokens beyond which a document is over its limit.
LIMIT = 2048


def unicode_free(spec: dict) -> str | None:
    """The splitting pattern, if printable ASCII needs no more than lower-casing before it; else None."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
    matches = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
    return split["pattern"].get("Regex") if plain and matches else None


class Reader:
    """Pre-tokens of white-space words, and pieces of pre-tokens, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        kinds = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if kinds != ["Split", "ByteLevel"] or spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]:
            raise ValueError("only vocabularies that split by a pattern, without white space in pre-tokens, and map bytes are known")
        if any(a["normalized"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in added):
            raise ValueError("added tokens must be plain strings without white space")
        if not unicode_free(spec):
            raise ValueError("white space must not be part of a pre-token")
        self.normal, self.pre, self.model = t.normalizer, t.pre_tokenizer, t.model
        self.ascii, self.split = regex.compile(rb"[\x21-\x7E]+"), regex.compile(unicode_free(spec))
        #: Longer strings first, as the library takes the longest that starts leftmost.
        by_size = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, by_size)) + ")") if by_size else None

    def pretokens(self, word: bytes) -> list[str]:
        """Pre-tokens of a word, bytes as the vocabulary's characters; special strings stand for themselves after a blank."""
        text = word.decode("utf-8", "replace")
        parts = self.special.split(text) if self.special else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(" " + part)
            elif self.ascii.fullmatch(part.encode()):
                out += self.split.findall(part.lower())
            elif part:
                out += [p for p, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def pieces(self, pretoken: str) -> int:
        return 1 if pretoken[0] == " " else len(self.model.tokenize(pretoken))


_READERS: dict[str, Reader] = {}


def reader(path: str) -> Reader:
    """One reader per Python worker and vocabulary."""
    if path not in _READERS:
        _READERS[path] = Reader(path)
    return _READERS[path]


class Generation:
    """The vocabulary of a stretch of documents."""

    def __init__(self, pretokens: Callable[[bytes], list[str]], most_words: int, most_text: int) -> None:
        self.split, self.text, self.most_words, self.most_text = pretokens, 0, most_words, most_text
        self.slots: dict[str, int] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def full(self) -> bool:
        return len(self.slots) > self.most_words or len(self.words) > 2 * self.most_words or self.text > self.most_text

    def of(self, word: bytes) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            slots = self.slots
            found = self.words[word] = tuple([slots.setdefault(p, len(slots)) for p in self.split(word)])
        return found

    def frequencies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs per text, slots, frequencies); a text's slots ascend."""
        self.text += len(data)
        starts, ends, per = spans(~WHITE[data], offsets)
        words, which = distinct_spans(data, starts, ends)
        texts = np.repeat(np.arange(len(per)), per)
        pairs, n = np.unique(texts * max(len(words), 1) + which, return_counts=True)
        text, word = np.divmod(pairs, max(len(words), 1))
        lists = [self.of(w) for w in words]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
        counts = size[word]
        slot = flat[np.repeat((np.cumsum(size) - size)[word], counts) + ramp(counts)]
        wide = max(len(self.slots), 1)
        code, inverse = np.unique(np.repeat(text, counts) * wide + slot, return_inverse=True)
        freq = np.bincount(inverse, weights=np.repeat(n, counts), minlength=len(code)).astype(np.int64)
        return np.bincount(code // wide, minlength=len(per)), code % wide, freq


def _read(docs: DataFrame, path: str, key: str, buckets: int, words: int, text: int) -> DataFrame:
    """Documents (shard, key, n_bytes, pairs, freqs) and vocabularies (``vocab.ROW``) in one table; a shard is a generation."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{vocab.ROW}, key {kind}, n_bytes long, pairs array<int>, freqs array<int>"
    own = ["key", "n_bytes", "pairs", "freqs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(path)
        now, number, key_type = None, TaskContext.get().partitionId() << 32, None

        def vocabulary() -> pa.RecordBatch:
            own_words = list(now.slots)
            b = vocab.rows(number, [""] * len(own_words), own_words, np.zeros(len(own_words), np.int64), buckets)
            kinds = [key_type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, k) for k in kinds]], names=[*vocab.NAMES, *own])

        for b in batches:
            keys, texts = b.column(0), b.column(1)
            key_type = keys.type
            for lo, hi, data, offsets in chunks(texts, min(CHUNK, text)):
                if now is None or now.full():
                    if now is not None and now.slots:
                        yield vocabulary()
                    now, number = Generation(r.pretokens, words, text), number + 1
                counts, slots, freqs = now.frequencies(data, offsets)
                m = hi - lo
                none = [pa.nulls(m, k) for k in (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * m, pa.int64()), *none, keys.slice(lo, m), pa.array(np.diff(offsets), pa.int64()), lists(steps(slots, counts), counts), lists(freqs, counts)],
                    names=[*vocab.NAMES, *own],
                )
        if now is not None and now.slots:
            yield vocabulary()

    return map_arrow(docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), run, schema)


def _pieces(words: DataFrame, path: str) -> DataFrame:
    """(shard, slots, pieces) of vocabulary rows; a partition holds all copies of its pre-tokens and counts each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = reader(path).pieces, {}
        for b in batches:
            out = []
            for joined in b.column(2).to_pylist():
                found = []
                for w in joined.split("\n"):
                    n = known.get(w)
                    if n is None:
                        n = known[w] = count(w)
                    found.append(n)
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["shard", "slots", "pieces"])

    return map_arrow(words.select("shard", "slots", "words"), run, "shard long, slots array<int>, pieces array<int>")


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", buckets: int | None = None, words: int = WORDS, text: int = TEXT) -> DataFrame:
    """``key``, n_bytes (UTF-8) and n_tokens of each row's ``text``, as the library's encode without added tokens has them.

    Null and empty texts have no bytes and no tokens. Texts are read whole, however long;
    special strings in a text count as one token each. Rows keep their number: repeated
    rows, null keys and equal keys with other texts each get their own row. An empty table
    gives none. Other columns are not looked at. ``buckets`` (default: the session's
    shuffle partitions, more for large inputs) deal the vocabularies; ``words`` and ``text`` bound a generation.
    """
    spark = docs.sparkSession
    buckets = buckets or vocab.buckets_of(docs)
    at = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    try:
        _read(docs, path, key, buckets, words, text).write.option("compression", "zstd").parquet(at)
        both = spark.read.parquet(at)
        found = _pieces(vocab.gathered(both.filter("bucket IS NOT NULL"), buckets), path)
        rows = both.filter("bucket IS NULL").select("shard", "key", "n_bytes", "pairs", "freqs")
        kind = docs.schema[key].dataType.simpleString()
        ship(spark)

        def total(docs: pa.Table, replies: pa.Table) -> pa.Table:
            where = unstepped(*flat_lists(replies.column("slots"))) if replies.num_rows else np.zeros(0, np.int64)
            pieces = np.zeros(len(where), np.int64)
            if len(where):
                pieces[where] = flat_lists(replies.column("pieces"))[0]
            deltas, counts = flat_lists(docs.column("pairs"))
            freqs, _ = flat_lists(docs.column("freqs"))
            sums = np.concatenate([[0], np.cumsum(pieces[unstepped(deltas, counts)] * freqs)])
            ends = np.cumsum(counts)
            return pa.table({"key": docs.column("key"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(sums[ends] - sums[ends - counts], pa.int64())})

        out = rows.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(total, f"key {kind}, n_bytes long, n_tokens long")
        return checkpointed(out.withColumnRenamed("key", key))
    finally:
        removed(spark, at)


def limits(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of whole texts; see ``count_tokens``."""
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
