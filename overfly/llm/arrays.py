"""Vectorised text primitives over Arrow string buffers.

Everything works on one flat ``uint8`` buffer and an offsets array, so the cost
is a few NumPy passes per byte and no Python object is made per word.
A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (one text longer than this forms its own chunk).
CHUNK_BYTES = 1 << 19
#: Bytes or words hashed at a time.
BLOCK = 1 << 15

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64 numbers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix64(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand (up to a block)."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


BYTE_VALUE = stream64(11, 256)
BYTE_POWERS = Powers(0x9E6C63D0876A3F6B)
WORD_POWERS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets): runs of whole texts of about ``size`` bytes."""
    data, offsets = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, count per text) of the maximal runs of ``inside``, none crossing a text's end."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and do not overlap.

    Bytes are taken ``BLOCK`` at a time, so that tables and temporaries stay small
    however long a text is; a span of more bytes is summed over several blocks.
    """
    out = np.zeros(len(starts), np.uint64)
    up, down = BYTE_POWERS.to(BLOCK + 1)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + BLOCK, "right"))
        if j > i:
            part = data[lo : ends[j - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[part] * up[: len(part)], out=sums[1:])
            s = starts[i:j] - lo
            out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
            i = j
        else:
            total = 0
            for a in range(lo, int(ends[i]), BLOCK):
                part = data[a : min(a + BLOCK, int(ends[i]))]
                total += int((BYTE_VALUE[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(BYTE_POWERS.base, a - lo, 1 << 64)
            out[i] = np.uint64(total & (1 << 64) - 1)
            i += 1
    return mix64(out)


def hash_windows(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive word hashes (of the flat sequence), ``BLOCK`` runs at a time."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, BLOCK):
        part = words[i : i + BLOCK + width - 1]
        m = len(part) - width + 1
        up, down = WORD_POWERS[which].to(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=sums[1:])
        out[i : i + m] = (sums[width:] - sums[:-width]) * down[:m]
    return mix64(out + np.uint64(width))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
