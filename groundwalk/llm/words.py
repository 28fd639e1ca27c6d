"""Words of Arrow text columns as numpy arrays, with no Python object per word.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D in the UTF-8 text. Its fingerprint is a
64-bit mix of all its bytes, eight at a time, and of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64
#: Masks that keep the first n bytes of a little-endian word of 8.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Word i spans data[start[i]:end[i]]; document d has the words first[d] to first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        length = self.end - self.start
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix((eight[self.start] & _MASK[np.minimum(length, 8)]) + length.astype(U64) * U64(0x9E3779B97F4A7C15))
        left, lane = np.flatnonzero(length > 8), 8
        while len(left):
            more = eight[self.start[left] + lane] & _MASK[np.minimum(length[left] - lane, 8)]
            out[left] = mix(out[left] * U64(0xD6E8FEB86659FD93) + more)
            lane += 8
            left = left[length[left] > lane]
        return out

    def grams(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of the k words from each word on; only those that end within their document mean anything."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= U64(0x9FB21C651E98DF25)
            out += hashes[j : j + n]
            out ^= out >> U64(29)
        return mix(out)


def split(text: pa.Array, lower: bool = False, fold: np.ndarray | None = None, keep: np.ndarray | None = None) -> Words:
    """Nulls count as empty texts. `fold` maps bytes before words are cut; texts of `keep` are not lower-cased."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "").cast(pa.large_binary())
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if lower:
        plain, data = data, LOWER[data]
        for d in np.flatnonzero(keep) if keep is not None else ():
            data[off[d] : off[d + 1]] = plain[off[d] : off[d + 1]]
    if fold is not None:
        data = fold[data]
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < len(data)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(data, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, off))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows, each part with at most `limit` bytes of text or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
