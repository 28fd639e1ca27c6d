"""Plans of contiguous vertex ranges, and how many partitions a build should have."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

# Bytes of memory that a build sets aside, per vertex and in all, and per open bin.
RESERVE, PER_VERTEX, OPEN_BIN = 32 << 20, 16, 64 << 10
INT_MAX = (1 << 31) - 1


@dataclass(frozen=True)
class Range:
    """Vertices begin to end, without end, and their in-edges."""

    begin: int
    end: int
    edges: int
    oversized: bool = False


def plan_shards(degrees: Iterable[np.ndarray], count: int, edges: int) -> list[Range]:
    """At most `count` ranges of about equal numbers of the `edges`; a range ends as soon as it has its share, the last one
    with the vertices. `degrees` are the in-degrees in order, in arrays of any size; only ranges are kept."""
    if count < 1:
        raise ValueError("count must be at least 1")
    share = max(1, edges // count)
    out: list[Range] = []
    begin = seen = done = total = 0  # done: edges of the ranges in out
    for part in degrees:
        upto = total + np.cumsum(part, dtype=np.int64)
        while len(out) < count - 1 and (i := int(np.searchsorted(upto, done + share))) < len(upto):
            out.append(Range(begin, seen + i + 1, int(upto[i]) - done))
            begin, done = seen + i + 1, int(upto[i])
        seen, total = seen + len(part), total + int(part.sum())
    return [*out, Range(begin, seen, total - done)] if begin < seen else out


def plan_bins(degrees: Iterable[np.ndarray], most: int) -> list[Range]:
    """Ranges of at most `most` edges; a vertex with more stands alone and is marked. `degrees` as for `plan_shards`."""
    if most < 1:
        raise ValueError("most must be at least 1")
    out: list[Range] = []
    begin = seen = done = total = 0
    for part in degrees:
        upto = total + np.cumsum(part, dtype=np.int64)
        # The first vertex that doesn't fit into the open range.
        while (i := int(np.searchsorted(upto, done + most, "right"))) < len(upto):
            before = int(upto[i - 1]) if i else total
            if begin < seen + i:
                out.append(Range(begin, seen + i, before - done))
                begin, done = seen + i, before
            if part[i] > most:
                out.append(Range(begin, begin + 1, int(part[i]), True))
                begin, done = begin + 1, int(upto[i])
        seen, total = seen + len(part), total + int(part.sum())
    return [*out, Range(begin, seen, total - done)] if begin < seen else out


def available_bytes(total: int, vertices: int) -> int:
    return max(0, total - RESERVE - PER_VERTEX * vertices)


def max_edges_per_bin(total: int, vertices: int) -> int:
    """Edges of eight bytes that fit at once in what is free and in three fifths of the heap."""
    if total < 1:
        raise ValueError("total must be at least 1")
    free = min(available_bytes(total, vertices), total * 3 // 5 - PER_VERTEX * vertices)
    return min(max(free // 8, 1), INT_MAX)


def waves(bins: int, free: int) -> int:
    """Passes over the input if only so many bins can be open at once."""
    if bins == 0:
        return 0
    at_once = min(max(free // OPEN_BIN, 1), bins)
    return -(-bins // at_once)
