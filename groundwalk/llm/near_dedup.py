"""MinHash near-dedup with HyperMinHash registers: exact components of texts that share most of their shingles.

Each text's distinct word shingles get a sketch of 128 buckets. A bucket has a hash function of its own and
keeps, of the smallest hash, the leading-zero count (6 bits) and the next 10 mantissa bits, 16 bits in all.
Four registers make a band; documents that agree on a band are candidates. A Jaccard estimate, corrected for
chance collisions of compressed registers, drops hopeless candidates, and what is left is confirmed on the full
shingle sets, so a link is never a guess.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^32 < 1e-7, and the estimate of such a
pair falls below the cut, 0.2 under the threshold, with probability < 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialize
from .words import U64, mix, slices, split

BUCKETS, ROWS, MANTISSA = 128, 4, 10
_RNG = np.random.default_rng(20240)
_XOR = _RNG.integers(1, 2**64, BUCKETS, dtype=U64)
_MUL = _RNG.integers(1, 2**64, BUCKETS, dtype=U64) | U64(1)
#: How far an estimate may lie under the threshold before its pair is dropped: over five standard deviations.
MARGIN = 0.2
#: Documents of a bucket that are compared at once.
CHUNK = 512


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's k-word shingles; of all its words if they are fewer."""
    words = split(text, lower=True)
    hashes = words.hashes()
    grams = words.grams(hashes, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(words.grams(hashes[a:b], b - a) ^ U64(b - a))
        else:
            out.append(hashes[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BUCKETS registers for each set; all 65535 for an empty one."""
    out = np.full((len(sets), BUCKETS), 0xFFFF, np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    joined = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    least = np.empty((len(full), BUCKETS), U64)
    for j in range(BUCKETS):
        least[:, j] = np.minimum.reduceat((joined ^ _XOR[j]) * _MUL[j], at)
    part, exponent = np.frexp((least >> U64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 63)
    mantissa = np.maximum((part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out[full] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that two unlike minima of n and m hashes get the same register.

    Two exponential variables of rates n and m fall into one cell of relative width 2^-r(1 .. 1/2): the mean
    over the octave is ln 2 = 0.68..0.69, times nm/(n+m)^2, which is 1/4 for equal sizes.
    """
    n, m = np.maximum(n, 1).astype(float), np.maximum(m, 1).astype(float)
    return 0.1699 * 2.0**-MANTISSA * 4 * n * m / (n + m) ** 2


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers."""
    c = chance(n, m)
    return (equal - c) / (1 - c)


def _sketch(k: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), k)
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "n", "digest", "regs"],
                )

    return run


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """One row per row of docs: doc_id, n (distinct shingles), digest of the set (null if empty), regs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch(k), "doc_id long, n long, digest binary, regs binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = BUCKETS // ROWS
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), U64).reshape(-1, count)
            keys = mix(regs + np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
            ids = part.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, count))], ["band", "doc_id"])


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in slices(batch, limit=16 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([pack((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())], ["doc_id", "packed"])


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): the texts as zstandard frames, for a shuffle of less than half the size."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_squeeze, "doc_id long, packed binary")


def _confirm(k: int, percent: int):
    """Rows arrive sorted: each (b, chunk) starts with the text of b, its partners follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, heads = None, []  # several heads only if an id is repeated
        for batch in batches:
            a, b = [], []
            for left, right, chunk, packed, n, regs in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "chunk", "packed", "n", "regs")), strict=True):
                if (right, chunk) != of:
                    of, heads = (right, chunk), []
                row = (n, np.frombuffer(regs, np.uint16), None, packed)
                if left is None:
                    heads.append(row)
                    continue
                own = None
                for h, head in enumerate(heads):
                    if estimate((head[1] == row[1]).mean(), np.array(head[0]), np.array(n)) < percent / 100 - MARGIN:
                        continue
                    if head[2] is None:
                        head = heads[h] = (*head[:2], _set_of(head[3], k), b"")
                    own = _set_of(packed, k) if own is None else own
                    if _linked(own, head[2], percent):
                        a.append(left)
                        b.append(right)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _set_of(packed: bytes, k: int) -> np.ndarray:
    return shingle_sets(pa.array([zstandard.ZstdDecompressor().decompress(packed)], pa.binary()).cast(pa.string()), k)[0]


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if not len(s) or not len(t) or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def confirm(pairs: DataFrame, packed: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the (a, b) whose estimate allows it and whose full shingle sets are as similar as asked.

    The partners of one b are dealt out in chunks of about 64, each with a copy of b's text, so a document with
    very many candidates loads no single task.
    """
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / 64).alias("chunks"))
    dealt = pairs.join(degree, "b").select("a", "b", F.pmod(F.xxhash64("a"), "chunks").alias("chunk"))
    left = dealt.join(packed, dealt["a"] == packed["doc_id"]).select("b", "chunk", "a", "packed", "n", "regs")
    heads = degree.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    right = heads.join(packed, heads["b"] == packed["doc_id"]).select("b", "chunk", F.lit(None).cast("long").alias("a"), "packed", "n", "regs")
    rows = left.union(right).repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())
    return rows.mapInArrow(_confirm(k, percent), "a long, b long").distinct()


def _joined(rows: list[tuple], k: int, percent: int) -> list[tuple[int, int]]:
    """Links between the components in one group of rows (doc_id, comp, n, regs, chunk, packed, i, j): for each
    document outside the largest one, a confirmed link to every other component that has one.

    All comparisons of a document are one pass over the group's sets, so nothing is put out for a pair but a link.
    """
    ids, comp, n, chunk = (np.array([r[c] for r in rows]) for c in (0, 1, 2, 4))
    if len(rows) < 2 or (comp == comp[0]).all():
        return []
    regs = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), -1)
    names, sizes = np.unique(comp, return_counts=True)
    across = rows[0][6] != rows[0][7]
    tests, wanted = [], np.zeros(len(rows), bool)
    for x in np.flatnonzero(comp != names[np.argmax(sizes)]):
        other = np.flatnonzero((comp != comp[x]) & (chunk != chunk[x] if across else True))
        other = other[100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x])]
        if len(other):
            other = other[estimate((regs[other] == regs[x]).mean(axis=1), n[other], n[x]) >= percent / 100 - MARGIN]
        if len(other):
            tests.append((x, other))
            wanted[other] = wanted[x] = True
    if not tests:
        return []
    use = np.flatnonzero(wanted)
    place = np.cumsum(wanted) - 1
    sets = [_set_of(rows[i][5], k) for i in use]
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    links = []
    for x, other in tests:
        other = other[comp[other] != comp[x]]
        if not len(other):
            continue
        own = codes[at[place[x]] : at[place[x]] + size[place[x]]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes], at)[place[other]]
        mark[own] = 0
        near = other[100 * both >= percent * (size[place[x]] + size[place[other]] - both)]
        for c in np.unique(comp[near]):
            links.append((int(ids[x]), int(ids[near[comp[near] == c][0]])))
            comp[comp == c] = comp[x]
    return links


def _close_links(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "comp", "n", "regs", "chunk", "packed", "i", "j", "band")), strict=True):
                if r[6:] != key:
                    out += _joined(rows, k, percent)
                    key, rows = r[6:], []
                rows.append(r)
        out = sorted({*out, *_joined(rows, k, percent)})
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of distinct k-word shingles (words lower-cased in A-Z) have 100 * common >=
    percent * union; component_id is the smallest doc_id reachable over links. A null text counts as empty; an
    empty set is linked with nothing. Rows that repeat a doc_id are one node of the graph and each keep a row of
    their own. A null doc_id cannot be linked: its component_id is null and it is kept. Other columns don't matter.

    Equal sets become one node first. Each band's documents are then compared with the band's smallest id, which
    joins nearly all true groups by as many comparisons as documents; only bands that still hold more than one
    component are compared further, between components, in chunks of bounded size that are dealt to all tasks and
    give back only links.
    """
    made = materialize(sketch(docs, k), "sketch")
    usable = made.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    nodes = materialize(usable.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi").select("doc_id", "n", "regs"), "nodes")
    bands = nodes.select("doc_id", "regs").mapInArrow(_bands, "band long, doc_id long")
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1")
    crowded = materialize(bands.join(shared, "band"), "bands")

    stars = crowded.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = nodes.join(crowded.select("doc_id").distinct(), "doc_id", "left_semi")
    packed = materialize(squeezed(docs).join(wanted, "doc_id").select("doc_id", "packed", "n", "regs"), "texts")
    first = materialize(confirm(stars, packed, k, percent), "links")
    found = components(first)

    placed = crowded.join(found, "doc_id", "left").select("band", "doc_id", "m", F.coalesce("component_id", "doc_id").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    open_rows = placed.join(mixed, "band").withColumn("chunks", F.ceil(F.col("m") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks"))
    dealt = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    dealt = dealt.join(packed, "doc_id").select("doc_id", "comp", "n", "regs", "chunk", "packed", "i", "j", "band")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    second = dealt.mapInArrow(_close_links(k, percent), "a long, b long")
    repeated = usable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    same_id = usable.join(repeated, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(first.union(second).union(same_id))

    of_class = classes.join(final, classes["rep"] == final["doc_id"], "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    by_row = made.join(of_class, "digest", "left")
    out = by_row.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
