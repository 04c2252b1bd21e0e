"""Phrase collocation mining with compressed position bitmaps.

A shard is a run of texts. Its words stand on one line of positions, pieces a position
apart, so nothing that moves by one place gets from one piece into the next. Each word
has a bitmap of its positions, compressed to the bytes that are not zero. A phrase's bitmap
marks where it ends: shifted by one place and ANDed with a word's bitmap it is the bitmap of
the phrase that this word extends, and the popcount is how often the shard holds that.
Phrases are extended depth-first, a batch of first words at a time, so memory is bounded by
a batch. Popcounts are summed over shards.

What can no longer reach the least count is not extended: words by their exact counts
(words that pass get ids, the others leave gaps), pairs by a bit table of a fixed size that
all counted pairs set. The table may let pairs pass that it should not, which costs work
and no exactness, as all phrases are counted and filtered in the end.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocab
from .arrays import LOWER, chunks, flat, mix64, ramp, spans
from .common import checkpointed, map_arrow, removed, shared_folder, ship
from .vocab import distinct_spans, flat_lists, unstepped

#: Contract values: least count, words of the longest phrase, share that a longer phrase needs to hide a shorter one, phrases a language.
LEAST, LONGEST, HIDES_PERCENT, TOP = 30, 4, 80, 2000
SCALE = 2_000_000
#: Bytes of text in a shard (one longer text forms its own).
SHARD = 4 << 20
#: Non-zero bytes of first words' bitmaps that are extended at a time.
BATCH = 1 << 15
#: How tables of shards are written. Readers hold a batch of thousands of rows, but never over the end of a row group, and
#: writers hold a group: groups are of some 8 MB, however few rows that is.
GROUPS = {"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
#: Bits of the pair table: 16 MB.
TABLE_BITS = 1 << 27

BLANK, BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09]] = True
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


# --- bitmaps -----------------------------------------------------------------------------


class Bitmaps:
    """The position bitmaps of all words of a shard: for each byte of the line, the words in it and their bits."""

    def __init__(self, words: np.ndarray, positions: np.ndarray) -> None:
        self.count = int(words.max()) + 1 if len(words) else 0
        place, bit = positions >> 3, np.left_shift(1, positions & 7)
        cells = int(place[-1]) + 2 if len(place) else 1
        code, which = np.unique(place * self.count + words, return_inverse=True)
        #: Ordered by byte, then word.
        self.byte, self.word = np.divmod(code, max(self.count, 1))
        self.bits = np.bincount(which, weights=bit, minlength=len(code)).astype(np.uint8)
        self.first = np.searchsorted(self.byte, np.arange(cells + 1))
        self.by_word = np.argsort(self.word, kind="stable")
        self.word_at = np.searchsorted(self.word[self.by_word], np.arange(self.count + 1))

    def of(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, byte, bits) of the bitmaps of words lo to hi - 1, word by word."""
        i = self.by_word[self.word_at[lo] : self.word_at[hi]]
        return self.word[i], self.byte[i], self.bits[i]

    def extended(self, owner: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, word, byte, bits): the owners' bitmaps shifted by one and ANDed with every word's; empty results left out."""
        up, carry = (bits << 1).astype(np.uint8), bits >> 7
        over = np.flatnonzero(carry)
        owner, byte, bits = np.concatenate([owner, owner[over]]), np.concatenate([byte, byte[over] + 1]), np.concatenate([up, carry[over]])
        some = bits != 0
        owner, byte, bits = owner[some], byte[some], bits[some]
        counts = self.first[byte + 1] - self.first[byte]
        at = np.repeat(self.first[byte], counts) + ramp(counts)
        both = self.bits[at] & np.repeat(bits, counts)
        hit = np.flatnonzero(both)
        at = at[hit]
        return np.repeat(owner, counts)[hit], self.word[at], self.byte[at], both[hit]


def grouped(phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, popcounts) of distinct phrases, and (index, byte, bits) of their bitmaps with what fell on one byte united."""
    if not len(phrase):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint8)
    order = np.lexsort((byte, phrase))
    phrase, byte, bits = phrase[order], byte[order], bits[order]
    new = np.append(True, (phrase[1:] != phrase[:-1]) | (byte[1:] != byte[:-1]))
    start = np.flatnonzero(new)
    phrase, byte, bits = phrase[start], byte[start], np.bitwise_or.reduceat(bits, start)
    codes, index = np.unique(phrase, return_inverse=True)
    return codes, np.bincount(index, weights=np.bitwise_count(bits), minlength=len(codes)).astype(np.int64), index, byte, bits


def pair_hash(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A pair's bit in a table of ``bits`` bits (a power of two)."""
    with np.errstate(over="ignore"):
        return mix64(mix64(a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + b.astype(np.uint64)) & np.uint64(bits - 1)


def phrases(line: np.ndarray, positions: np.ndarray, longest: int, table: np.ndarray | None = None, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word ids, popcounts) of the phrases of 2 words, or with a table of 3 to ``longest`` words whose pairs the table holds.

    ``line`` has the id of the word on each of the ascending ``positions``. Word ids come
    as rows of ``longest`` numbers, filled up with -1.
    """
    ids, words = np.unique(line, return_inverse=True)
    maps = Bitmaps(words, positions)
    sizes = np.diff(maps.word_at)
    # First words by batches of so many bytes; one word may be more.
    ends = np.cumsum(sizes)
    lo = 0
    while lo < maps.count:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + batch, "right")))
        owner, byte, bits = maps.of(lo, hi)
        yield from _deeper(maps, ids, np.arange(lo, hi)[:, None], owner - lo, byte, bits, longest, table, batch)
        lo = hi


def _deeper(maps: Bitmaps, ids: np.ndarray, prefix: np.ndarray, owner: np.ndarray, byte: np.ndarray, bits: np.ndarray, longest: int, table: np.ndarray | None, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Extend phrases (``prefix``: rows of word places, with bitmaps of ``owner`` rows) by one word, and go on with what that gives."""
    depth = prefix.shape[1]
    owner, word, byte, bits = maps.extended(owner, byte, bits)
    if table is not None and len(owner):
        h = pair_hash(ids[prefix[owner, -1]], ids[word], 8 * len(table))
        ok = np.flatnonzero(table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1)
        owner, word, byte, bits = owner[ok], word[ok], byte[ok], bits[ok]
    codes, n, index, byte, bits = grouped(owner * max(maps.count, 1) + word, byte, bits)
    if not len(codes):
        return
    own, word = np.divmod(codes, maps.count)
    prefix = np.concatenate([prefix[own], word[:, None]], axis=1)
    if table is None or depth >= 2:
        rows = np.full((len(prefix), longest), -1, np.int64)
        rows[:, : depth + 1] = ids[prefix]
        yield rows, n
    if table is None or depth + 1 == longest:
        return
    # Depth first: a part of the phrases goes all the way before the next.
    ends = np.cumsum(np.bincount(index, minlength=len(prefix)))
    lo = 0
    while lo < len(prefix):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + batch, "right")))
        part = slice(before, int(ends[hi - 1]))
        yield from _deeper(maps, ids, prefix[lo:hi], index[part] - lo, byte[part], bits[part], longest, table, batch)
        lo = hi


# --- shards ------------------------------------------------------------------------------


def shard_words(langs: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(langs and words of the vocabulary, index of each word of the line, its position): texts lower-cased and split into pieces and words."""
    data = LOWER[data]
    gap = BREAK[data]
    starts, ends, per = spans(~(gap | BLANK[data]), offsets)
    # A position is left empty before each text and after each run of separators.
    breaks = np.concatenate([[0], np.cumsum(gap)])[starts]
    text = np.repeat(np.arange(len(per)), per)
    apart = np.append(False, (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]))[: len(starts)]
    positions = np.arange(len(starts)) + np.cumsum(apart)
    words, which = distinct_spans(data, starts, ends)
    names = sorted(set(langs))
    code = {x: i for i, x in enumerate(names)}
    lang = np.array([code[x] for x in langs], np.int64)[text]
    codes, index = np.unique(which * max(len(names), 1) + lang, return_inverse=True)
    codes = codes.tolist()
    return [names[c % len(names)] for c in codes], [words[c // len(names)].decode("utf-8", "replace") for c in codes], index, positions


def squeezed(x: np.ndarray) -> bytes:
    """Two rows of numbers, compressed: shuffles compress rows less well than this, and a batch of rows is small in the JVM."""
    narrow = x.max(initial=0) < 1 << 31
    return struct.pack("<?q", narrow, x.shape[1]) + pa.compress(np.ascontiguousarray(x, np.int32 if narrow else np.int64), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes) -> np.ndarray:
    narrow, n = struct.unpack("<?q", raw[:9])
    kind = np.dtype(np.int32 if narrow else np.int64)
    return np.frombuffer(pa.decompress(raw[9:], decompressed_size=2 * n * kind.itemsize, codec="zstd"), kind).reshape(2, n)


def _shards(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """Lines (steps from word to word and places in the vocabulary, compressed) and vocabularies (``vocab.ROW``, the tag being the language) in one table."""
    schema = f"{vocab.ROW}, line binary"
    names = [*vocab.NAMES, "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, langs, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            data, offsets = flat(pa.chunked_array(texts, pa.string()))
            tags, words, index, positions = shard_words(langs, data, offsets)
            if not len(words):
                return
            line = squeezed(np.stack([np.diff(positions, prepend=0), index]))
            none = [pa.nulls(1, k) for k in (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *none, pa.array([line], pa.binary())], names=names)
            b = vocab.rows(number, tags, words, np.bincount(index, minlength=len(words)), buckets)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], names=names)

        for b in batches:
            lang = b.column(0).to_pylist()
            for lo, hi, data, _ in chunks(b.column(1), size):
                if texts and held + len(data) > size:
                    yield from shard()
                    number, langs, texts, held = number + 1, [], [], 0
                langs += lang[lo:hi]
                texts.append(b.column(1).slice(lo, hi - lo))
                held += len(data)
        if texts:
            yield from shard()

    return map_arrow(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), run, schema)


def _named(words: DataFrame, least: int, buckets: int) -> DataFrame:
    """Words that occur ``least`` times or more get an id: rows (shard, slots, ids) that answer the shards, and rows (tag, word, id, a).

    Rows (tag, n) carry the sum of all counts of a tag in a partition, the rare words' too.
    A partition holds all copies of its words and, until it has read them all, its rows.
    """
    schema = "shard long, slots array<int>, ids array<long>, tag string, word string, id long, a long, n long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[str, int]] = {}
        every: dict[str, int] = {}
        held = []
        for b in batches:
            held.append(b)
            counts, size = flat_lists(b.column(4))
            ends = np.cumsum(size).tolist()
            counts = counts.tolist()
            for tag, joined, lo, hi in zip(b.column(2).to_pylist(), b.column(5).to_pylist(), [0, *ends], ends):
                every[tag] = every.get(tag, 0) + sum(counts[lo:hi])
                own = total.setdefault(tag, {})
                for w, n in zip(joined.split("\n"), counts[lo:hi]):
                    own[w] = own.get(w, 0) + n
        often = {tag: [(w, n) for w, n in own.items() if n >= least] for tag, own in total.items()}
        total.clear()
        ids: dict[str, dict[str, int]] = {tag: {} for tag in often}
        used: dict[int, int] = {}
        for tag, own in often.items():
            for w, _ in own:
                bucket = vocab.bucket(w, buckets)
                ids[tag][w] = used.get(bucket, 0) * buckets + bucket
                used[bucket] = used.get(bucket, 0) + 1

        def out(**columns) -> pa.RecordBatch:
            m = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(m, k) for c, k in zip(names, KINDS)], names=names)

        for tag, own in often.items():
            for i in range(0, len(own), 10_000):
                some = own[i : i + 10_000]
                yield out(tag=[tag] * len(some), word=[w for w, _ in some], id=[ids[tag][w] for w, _ in some], a=[n for _, n in some])
        yield out(tag=list(every), n=list(every.values()))
        often.clear()
        for b in held:
            deltas, size = flat_lists(b.column(3))
            slots = unstepped(deltas, size)
            at = 0
            shard, places, found = [], [], []
            for s, tag, joined in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(5).to_pylist()):
                mine = np.array([ids[tag].get(w, -1) for w in joined.split("\n")], np.int64)
                ok = mine >= 0
                shard.append(s)
                places.append(np.diff(slots[at : at + len(mine)][ok], prepend=0).astype(np.int32))
                found.append(mine[ok])
                at += len(mine)
            yield out(shard=shard, slots=places, ids=found)

    KINDS = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return map_arrow(vocab.gathered(words, buckets), run, schema)


def _lines(shards: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """(line): each shard's words that have an id, by the step to their position from the one before, compressed.

    There are as many partitions as buckets, so the shards in one do not grow with the input.
    """
    ship(shards.sparkSession)

    def run(line: pa.Table, answer: pa.Table) -> pa.Table:
        kept = []
        if line.num_rows and answer.num_rows:
            moves, places = unsqueezed(line.column("line")[0].as_py())
            slots = unstepped(*flat_lists(answer.column("slots")))
            known = np.full(int(max(places.max(), slots.max() if len(slots) else 0)) + 1, -1, np.int64)
            known[slots] = flat_lists(answer.column("ids"))[0]
            line_ids = known[places]
            ok = line_ids >= 0
            positions = np.cumsum(moves.astype(np.int64))[ok]
            kept = [squeezed(np.stack([np.diff(positions, prepend=0), line_ids[ok]]))]
        return pa.table({"line": pa.array(kept, pa.binary())})

    shards, answers = (d.repartition(buckets, "shard") for d in (shards, answers))
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, "line binary")


def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    start = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
    return rows[start], np.add.reduceat(n, start) if len(start) else n


def packed(rows: np.ndarray, n: np.ndarray) -> bytes:
    """Phrases in order and their counts, column by column and compressed: a few bytes a phrase."""
    table = np.concatenate([rows, n[:, None]], axis=1).T.copy()
    table[0] = np.diff(table[0], prepend=0)
    narrow = table.max(initial=0) < 1 << 31
    return struct.pack("<?q", narrow, table.shape[1]) + pa.compress(table.astype(np.int32 if narrow else np.int64), codec="zstd", asbytes=True)


def unpacked(raw: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    narrow, m = struct.unpack("<?q", raw[:9])
    kind = np.dtype(np.int32 if narrow else np.int64)
    table = np.frombuffer(pa.decompress(raw[9:], decompressed_size=(columns + 1) * m * kind.itemsize, codec="zstd"), kind).reshape(columns + 1, m).astype(np.int64)
    table[0] = np.cumsum(table[0])
    return table[:-1].T, table[-1]


def _counted(lines: DataFrame, longest: int, batch: int, buckets: int, least: int, table=None) -> DataFrame:
    """(w1 .. w<longest>, a): popcounts of phrases summed over shards, of those that reach ``least``.

    A shard's phrases travel packed by the bucket of their hash; a partition holds the
    distinct phrases of one bucket, and the number of buckets follows the input (``vocab.buckets_of``).
    """
    words = [f"w{i + 1}" for i in range(longest)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value if table is not None else None
        for b in batches:
            for raw in b.column(0):
                moves, ids = unsqueezed(raw.as_py()).astype(np.int64)
                positions = np.cumsum(moves)
                if not len(positions):
                    continue
                found = list(phrases(ids, positions - positions[0], longest, bits, batch))
                if not found:
                    continue
                rows, n = (np.concatenate(x) for x in zip(*found))
                h = np.zeros(len(rows), np.uint64)
                with np.errstate(over="ignore"):
                    for w in rows.T:
                        h = mix64(h + w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((*rows.T[::-1], bucket))
                which, size = np.unique(bucket, return_counts=True)
                ends = np.cumsum(size).tolist()
                blobs = [packed(rows[order[e - c : e]], n[order[e - c : e]]) for e, c in zip(ends, size.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "phrases"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = np.zeros((0, longest), np.int64), np.zeros(0, np.int64)
        new, held = [], 0
        for b in batches:
            for raw in b.column(1).to_pylist():
                new.append(unpacked(raw, longest))
                held += len(new[-1][1])
                if held > max(1 << 18, len(n)):
                    rows, n = summed(*(np.concatenate(x) for x in zip((rows, n), *new)))
                    new, held = [], 0
        if new:
            rows, n = summed(*(np.concatenate(x) for x in zip((rows, n), *new)))
        keep = n >= least
        rows, n = rows[keep], n[keep]
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(longest)], pa.array(n)], names=[*words, "a"])

    d = map_arrow(lines.select("line"), find, "bucket int, phrases binary")
    return map_arrow(vocab.by_bucket(d, buckets), total, ", ".join(f"{w} long" for w in words) + ", a long")


def _pair_table(pairs: DataFrame, size: int) -> np.ndarray:
    """The table of pairs (w1, w2): ``size`` bits whatever their number. A row for each 64 bits comes to the driver, 2**21 at most as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = pair_hash(np.asarray(b.column(0)), np.asarray(b.column(1)), size)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), h & np.uint64(63)).view(np.int64))], names=["at", "bits"])

    rows = map_arrow(pairs.select("w1", "w2"), run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[np.asarray(rows.column("at"))] = np.asarray(rows.column("bits"))
    return out.view(np.uint8)


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int | None = None, shard: int = SHARD, batch: int = BATCH, table_bits: int = TABLE_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (id, lang, word, a) and (w1 .. w<longest>, a): words of each language, and words and phrases that occur ``least`` times or more.

    Phrases hold the ids of their words, filled up with -1. ``shard``, ``batch`` and
    ``table_bits`` bound memory and change no row.
    """
    spark = docs.sparkSession
    buckets = buckets or vocab.buckets_of(docs)
    at = f"{shared_folder(spark)}/collocations-{uuid.uuid4().hex}"
    words = [f"w{i + 1}" for i in range(longest)]

    def stored(d: DataFrame, name: str) -> DataFrame:
        d.write.options(**GROUPS).parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    try:
        shards = stored(_shards(docs, buckets, shard), "shards")
        named = stored(_named(shards.filter("bucket IS NOT NULL"), least, buckets), "named")
        total = checkpointed(named.filter("n IS NOT NULL").groupBy(F.col("tag").alias("lang")).agg(F.sum("n").alias("n")))
        often = checkpointed(named.filter("id IS NOT NULL").select("id", F.col("tag").alias("lang"), "word", "a"))
        lines = stored(_lines(shards.filter("bucket IS NULL").select("shard", "line"), named.filter("shard IS NOT NULL").select("shard", "slots", "ids"), buckets), "lines")
        for name in ("shards", "named"):
            removed(spark, f"{at}/{name}")
        pairs = checkpointed(_counted(lines, 2, batch, buckets, least))
        found = pairs.select("w1", "w2", *[F.lit(-1).cast("long").alias(w) for w in words[2:]], "a")
        if longest > 2:
            table = spark.sparkContext.broadcast(_pair_table(pairs, table_bits))
            longer = checkpointed(_counted(lines, longest, batch, buckets, least, table))
            table.destroy()
            found = found.unionByName(longer)
    finally:
        removed(spark, at)
    return total, often, found


# --- phrases by score --------------------------------------------------------------------


def _packed(words: list[Column], longest: int) -> list[Column]:
    return [*words, *[F.lit(-1).cast("long")] * (longest - len(words))]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, hides: int = HIDES_PERCENT, top: int = TOP, **bounds: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    A phrase's score is floor(2000000 a / (l + r)) at the cut where that is least (ties to
    the earlier cut); it goes where a longer phrase that holds it occurs at least
    ``hides`` percent as often. Null texts are empty, null langs ``und``; repeated rows
    count each; pieces and words without letters count like others. An empty table
    gives no rows. Products are decimals, so no count overflows them. ``bounds``: see ``counts``.
    """
    total, often, found = counts(docs, least, longest, **bounds)
    ws = [f"w{i + 1}" for i in range(longest)]
    found = checkpointed(found.withColumn("size", sum((F.col(w) >= 0).cast("int") for w in ws)))
    # What any part of a phrase counts: words and phrases by the same key.
    parts = often.select(F.array(*_packed([F.col("id")], longest)).alias("key"), "a").unionAll(found.select(F.array(*ws).alias("key"), "a"))
    part = lambda lo, hi: F.array(*_packed([F.col(w) for w in ws[lo:hi]], longest))
    cut = []
    for size in range(2, longest + 1):
        for k in range(1, size):
            cut.append(F.when(F.col("size") == size, F.struct(F.lit(k).alias("k"), part(0, k).alias("left"), part(k, size).alias("right"))))
    cuts = found.select(*ws, "size", "a", F.explode(F.filter(F.array(*cut), lambda c: c.isNotNull())).alias("c")).select(*ws, "size", "a", "c.*")
    for side, count in (("left", "l"), ("right", "r")):
        p = parts.select(F.col("key").alias(f"_{side}"), F.col("a").alias(count))
        cuts = cuts.join(p, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    big = "decimal(20,0)"
    score = F.expr(f"(CAST(a AS {big}) * CAST({SCALE} AS {big})) div (CAST(l AS {big}) + CAST(r AS {big}))")
    scored = cuts.withColumn("score", score).groupBy(*ws, "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    scored = scored.select(*ws, "size", "a", "m.l", "m.r", "m.score")
    # Every part of two words and more of a longer phrase, with the most that a longer phrase counts.
    inner = [F.when(F.col("size") == size, part(lo, hi)) for size in range(3, longest + 1) for m in range(2, size) for lo, hi in stretches(size, m)]
    if inner:
        hidden = found.select("a", F.explode(F.filter(F.array(*inner), lambda c: c.isNotNull())).alias("_key")).groupBy("_key").agg(F.max("a").alias("_most"))
        scored = scored.join(hidden, F.array(*ws) == F.col("_key"), "left")
        scored = scored.filter(F.col("_most").isNull() | (F.lit(100).cast(big) * F.col("_most").cast(big) < F.lit(hides).cast(big) * F.col("a").cast(big)))
    # Names are needed to rank, as ties go by phrase.
    named = scored.select(*ws, "a", "l", "r", "score")
    for i, w in enumerate(ws):
        o = often.select(F.col("id").alias(f"_id{i}"), F.col("word").alias(f"_word{i}"), *([F.col("lang")] if i == 0 else []))
        named = named.join(o, F.col(w) == F.col(f"_id{i}"), "inner" if i < 2 else "left").drop(f"_id{i}")
    named = named.withColumn("phrase", F.concat_ws(" ", *[f"_word{i}" for i in range(longest)]))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    n = total.select(F.col("lang").alias("_lang"), F.col("n"))
    return best.join(n, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def stretches(size: int, m: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of ``m`` among ``size`` words."""
    return [(i, i + m) for i in range(size - m + 1)]


ORACLE = r"""
WITH p AS (
  SELECT doc_id, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pno FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)
), q AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, m, unnest([w[i : i + m - 1] FOR i IN range(1, len(w) - m + 2)]) AS ws FROM q, (SELECT unnest([1, 2, 3, 4])::BIGINT AS m) WHERE len(w) >= m
), f AS (
  SELECT lang, m, ws, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE m > 1 AND a >= 30
), k AS (
  SELECT lang, m, ws, a, unnest(range(1, m)) AS k FROM c
), s AS (
  SELECT k.lang, k.m, k.ws, k.a, k.k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * k.a) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.ws = k.ws[1 : k.k] JOIN f y ON y.lang = k.lang AND y.ws = k.ws[k.k + 1 :]
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
), h AS (
  SELECT DISTINCT lang, part, max(a) OVER (PARTITION BY lang, part) AS most FROM (
    SELECT lang, a, unnest(flatten([[ws[i : i + z - 1] FOR i IN range(1, m - z + 2)] FOR z IN range(2, m)])) AS part FROM c WHERE m > 2)
), o AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.part = b.ws WHERE h.most IS NULL OR 100 * h.most < 80 * b.a
)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n.n, score
FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000
"""
