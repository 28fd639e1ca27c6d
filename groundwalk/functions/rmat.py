"""Deterministic power-law graphs by recursive quadrants.

The random numbers are those of the linear congruential generator that Java's documentation of java.util.Random
defines. An edge uses `scale` doubles, so edge i starts 2 * scale * i steps into the stream, and any task can jump there:
i steps of x -> a x + c are again of this form, with a and c found by squaring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the generator's definition.
MULTIPLIER, INCREMENT, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1
QUADRANTS = (0.57, 0.19, 0.19, 0.05)
_U = np.uint64


def jump(steps: int) -> tuple[int, int]:
    """(a, c) of that many steps at once."""
    a, c, x, y = 1, 0, MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            a, c = a * x & MASK, (c * x + y) & MASK
        x, y = x * x & MASK, (y * x + y) & MASK
        steps >>= 1
    return a, c


def edges_from(first: int, count: int, scale: int, quadrants: tuple[float, float, float, float], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of `count` edges from number `first` on."""
    a, c = jump(2 * scale)
    start = np.empty(count, dtype=_U)
    # States at the starts of the edges, by doubling: those of the second half are one jump after the first half.
    a0, c0 = jump(2 * scale * first)
    start[:1] = (a0 * ((seed ^ MULTIPLIER) & MASK) + c0) & MASK
    have = 1
    while have < count:
        more = min(have, count - have)
        start[have : have + more] = (start[:more] * _U(a) + _U(c)) & _U(MASK)
        a, c = a * a & MASK, (c * a + c) & MASK
        have += more
    x, left, right = start, np.zeros(count, np.int64), np.zeros(count, np.int64)
    p, q, r, _ = quadrants
    for bit in range(scale - 1, -1, -1):
        x = (x * _U(MULTIPLIER) + _U(INCREMENT)) & _U(MASK)
        high = x >> _U(22)
        x = (x * _U(MULTIPLIER) + _U(INCREMENT)) & _U(MASK)
        u = ((high << _U(27)) + (x >> _U(21))).astype(np.float64) * 2.0**-53
        right |= np.where(((u >= p) & (u < p + q)) | (u >= p + q + r), 1 << bit, 0)
        left |= np.where(u >= p + q, 1 << bit, 0)
    return left, right


def check(scale: int, edges: int, quadrants: tuple[float, float, float, float]) -> None:
    if not 1 <= scale <= 30:
        raise ValueError("scale must be 1 to 30")
    if edges < 0:
        raise ValueError("edges must not be negative")
    if min(quadrants) < 0 or abs(sum(quadrants) - 1) > 1e-9:
        raise ValueError("probabilities must not be negative and must sum to 1")


def rmat(spark: SparkSession, scale: int, edges: int, quadrants: tuple[float, float, float, float] = QUADRANTS, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """(id, src, dst): the same edges for any number of partitions; ids are below 2 ** scale."""
    check(scale, edges, quadrants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if len(ids):  # a range's batch is a run of neighbouring ids
                src, dst = edges_from(int(ids[0]), len(ids), scale, quadrants, seed)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(src.astype(np.int32)), pa.array(dst.astype(np.int32))], ["id", "src", "dst"])

    ids = spark.range(0, edges, 1, partitions) if partitions else spark.range(edges)
    return ids.mapInArrow(run, "id long, src int, dst int")
