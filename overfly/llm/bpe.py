"""Byte-level BPE encoding by forced-boundary splitting, and decoding.

A byte pair that occurs inside no vocabulary token marks a certain token
boundary: no merge can ever span it. Texts are cut at such pairs, the distinct
fragments of a chunk are encoded independently (most are in a bounded memo, as words
repeat), and the ids are concatenated. Cuts that could change how the splitting
pattern reads its surroundings are left out (see ``cuts``), so the ids equal those of
the whole text.

Free style: one pass over Arrow batches, no shuffle. Fragments are found by a hash and
laid out by NumPy, so no Python object is made per fragment; memory is bounded by a
text chunk plus the memo. A lost executor costs only its own splits.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, hash_spans, ramp
from .common import extended, give_back, map_arrow

#: Fragments and bytes beyond which a memo starts anew.
MEMO, MEMO_BYTES = 300_000, 12 << 20
#: Bytes of text encoded at a time.
CHUNK = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[f : f + c] of each (f, c), joined."""
    return flat[np.repeat(first, counts) + ramp(counts)]


class Memo:
    """Encoded fragments in flat arrays: found by hash, laid out as bytes of the fragment, its ids, and the bytes these decode to."""

    def __init__(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: Per column, the values of all fragments and where each begins (and the last ends).
        self.flat = {"source": np.zeros(0, np.uint8), "ids": np.zeros(0, np.int32), "decoded": np.zeros(0, np.uint8)}
        self.at = {k: np.zeros(1, np.int64) for k in self.flat}

    def full(self) -> bool:
        return len(self.keys) > MEMO or sum(x.nbytes for x in self.flat.values()) > MEMO_BYTES

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, -1 where it is absent."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray, **columns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows of new keys (sorted) with their values, joined, and how many each has."""
        rows = np.arange(len(keys)) + len(self.at["ids"]) - 1
        place = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, place, keys), np.insert(self.rows, place, rows)
        for k, (values, counts) in columns.items():
            self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + np.cumsum(counts)])
            self.flat[k] = np.concatenate([self.flat[k], values])
        return rows

    def laid_out(self, column: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of these rows joined, number per row)."""
        at = self.at[column]
        counts = (at[1:] - at[:-1])[rows]
        return gather(self.flat[column], at[rows], counts), counts


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        if spec.get("normalizer"):
            raise ValueError("a vocabulary with a normalizer cannot be cut at byte pairs")
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        #: The tokens' bytes in one array, by id.
        by_id = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_size = np.array([len(t) for t in by_id])
        self.token_at, self.token_flat = np.cumsum(self.token_size) - self.token_size, np.frombuffer(b"".join(by_id), np.uint8)
        never = np.ones((256, 256), dtype=bool)
        for t in tokens.values():
            b = np.frombuffer(t, np.uint8)
            never[b[:-1], b[1:]] = False
        #: Pairs that may be cut: in no token, the right byte starts a character ...
        never[:, 0x80:0xC0] = False
        #: ... the left one is no ASCII white space, whose runs are read with lookahead ...
        never[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)], :] = False
        #: ... and an apostrophe, which may begin a contraction, only follows a letter or digit.
        word = np.zeros(256, dtype=bool)
        word[[c for c in range(128) if chr(c).isalnum()]] = True
        never[~word, 0x27] = False
        self.pairs = never.reshape(-1)
        self.memo = Memo()
        del spec, tokens, by_id
        give_back()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions before which the flat buffer is cut, each text's start included."""
        if len(data) == 0:
            return np.zeros(0, np.int64)
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = self.pairs[data[:-1].astype(np.int32) * 256 + data[1:]]
        if (data >= 0xC2).any():
            # A character of Unicode white space before the place: no cut there either.
            b0, b1, b2 = data[2:-1], data[1:-2], data[:-3]
            wide = ((b2 == 0xE2) & (b1 == 0x80) & ((b0 <= 0x8A) | (b0 == 0xA8) | (b0 == 0xA9) | (b0 == 0xAF))) | ((b2 == 0xE2) & (b1 == 0x81) & (b0 == 0x9F))
            wide |= ((b2 == 0xE3) & (b1 == 0x80) & (b0 == 0x80)) | ((b2 == 0xE1) & (b1 == 0x9A) & (b0 == 0x80))
            cut[3:] &= ~wide
            cut[2:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def encode_fragments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Source bytes, ids and decoded bytes of fragments, each encoded alone."""
        raw, size = data.tobytes(), ends - starts
        found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)]
        counts = np.array([len(x) for x in found])
        ids = np.fromiter(chain.from_iterable(found), np.int32, counts.sum())
        sums = np.concatenate([[0], np.cumsum(self.token_size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return {"source": (gather(data, starts, size), size), "ids": (ids, counts), "decoded": (gather(self.token_flat, self.token_at[ids], self.token_size[ids]), np.diff(sums))}

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text, decoded bytes of all texts, number of bytes per text)."""
        starts = self.cuts(data, offsets)
        if not len(starts):
            none = np.zeros(len(offsets) - 1, np.int64)
            return np.zeros(0, np.int32), none, np.zeros(0, np.uint8), none
        ends = np.append(starts[1:], len(data))
        if self.memo.full():
            self.memo = Memo()
        memo = self.memo
        keys, first, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        rows = memo.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = memo.add(keys[new], **self.encode_fragments(data, starts[first[new]], ends[first[new]]))
        rows = rows[which]
        if not np.array_equal(memo.laid_out("source", rows)[0], data):
            # Two fragments of one hash: this chunk's are all encoded on their own.
            memo = Memo()
            rows = memo.add(np.arange(len(starts), dtype=np.uint64), **self.encode_fragments(data, starts, ends))
        at = np.searchsorted(starts, offsets)
        out = []
        for column in ("ids", "decoded"):
            values, counts = memo.laid_out(column, rows)
            out += [values, np.diff(np.concatenate([[0], np.cumsum(counts)])[at])]
        return tuple(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; byte runs that are no UTF-8 become U+FFFD."""
        i = np.array([i for i in ids if 0 <= i < len(self.token_size)], np.int64)
        return gather(self.token_flat, self.token_at[i], self.token_size[i]).tobytes().decode("utf-8", "replace")


def strings(raw: np.ndarray, sizes: np.ndarray, known: bool) -> pa.Array:
    """Texts of so many bytes each; ``known`` to be UTF-8, or else with U+FFFD for what is none."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    if known:
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    flat = raw.tobytes()
    return pa.array([flat[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``ids array<int>`` and, if asked, ``decoded`` (the text made again from the ids).

    A null or empty text gives no ids and the empty text. Texts are never cut off;
    repeated rows give repeated rows; an empty table gives none. Other columns pass
    through; ones already named ids or decoded are replaced.
    """
    df = df.drop("ids", "decoded")
    schema = extended(df, ids="array<int>", **({"decoded": "string"} if decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi, data, offsets in chunks(column, CHUNK):
                ids, counts, raw, sizes = c.encode_chunk(data, offsets)
                new = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))]
                if decoded:
                    new.append(strings(raw, sizes, known=np.array_equal(raw, data)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "ids", *(["decoded"] if decoded else [])])

    return map_arrow(df, run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an ``array<int>`` column of ids; a null list gives the empty text, unknown ids nothing."""
    schema = extended(df.drop(out), **{out: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.decode(x or ()) for x in lists], pa.string())], names=[*batch.schema.names, out])

    return map_arrow(df.drop(out), run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts."""
    d = encode(docs.select("doc_id", "text"), path, decoded=True)
    return d.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
