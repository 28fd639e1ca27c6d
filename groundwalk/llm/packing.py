"""Packing of documents into training sequences by lexical retrieval.

Terms are the tokenizer's ids, so document frequencies, the number of documents and their mean length are counted over the
whole table and still have a proven size. The inverted index is sharded by content: a document's key holds, for each of
KEYS orders of the terms, the first of its terms in that order, where a term comes early in proportion to its idf. Documents
that share rare terms get equal keys by as much as they share, the table is range-partitioned and sorted by key, and
each SHARD_IDS ids in that order make a shard. A key that very many documents have is spread over as many shards as they
fill, by a hash of the row behind the key.

Within a shard BM25 ranks the unused documents for each seed, and the best of them fill its window greedily. The
document that overflows is cut, and its rest opens the next window and seeds it, so every window is full. A window still
open at the end of a shard goes on in the next one. What a partition leaves at its end, less than one window, is cut
into sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .tokens import encoder
from .words import U64, mix, slices

WINDOW, END = 4096, 2
#: Ids of a shard, whose index a task holds as a matrix; a longer document is a shard of its own.
SHARD_IDS, SHARD_DOCS = 1 << 19, 1 << 12
#: Ids of a partition, about.
PART_IDS = 1 << 23
TERMS, KEYS = 1 << 16, 3
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenise(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                coded = encode.code(part.column("text"))
                ends = np.concatenate([[0], coded.ends])
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(coded.ids)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "tie", "row")], pa.array(np.diff(ends)), raw], ["doc_id", "tie", "row", "n", "ids"])

    return run


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ids, and where each row's start, with the end of the last."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    ids = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view("<u2") if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint16)
    return ids, (offsets - offsets[0]) // 2


def postings(ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of each pair, in this order; at most 65,536 documents."""
    doc = np.repeat(np.arange(len(edge) - 1, dtype=np.uint32), np.diff(edge))
    keys = np.sort(doc << np.uint32(16) | ids)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[new] >> np.uint32(16)).astype(np.int64), (keys[new] & np.uint32(0xFFFF)).astype(np.int64), np.diff(np.append(new, len(keys)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task's documents: a row for each term at most."""
    df = np.zeros(TERMS, np.int64)
    for batch in batches:
        for at in range(0, len(batch), 1024):
            df += np.bincount(postings(*_ids(batch.column("ids").slice(at, 1024)))[1], minlength=TERMS)
    own = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(df[own])], ["term", "df"])


class Statistics:
    """idf of each term and the mean length over the whole table, and the orders of terms that keys are taken by."""

    def __init__(self, df: np.ndarray, docs: int, mean: float) -> None:
        self.mean = max(mean, 1e-9)
        # A term of one document finds no other.
        self.idf = np.where(df > 1, np.log1p((docs - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
        self.orders = []
        for k in range(KEYS):
            u = ((mix(np.arange(TERMS, dtype=U64) + U64(1 + (k << 20))) >> U64(11)).astype(float) + 0.5) * 2.0**-53
            late = np.where(self.idf > 0, -np.log(u) / np.maximum(self.idf, 1e-9), np.inf)
            order = np.empty(TERMS, np.uint16)
            order[np.argsort(late, kind="stable")] = np.arange(TERMS, dtype=np.uint16)
            self.orders.append(order)

    def keys(self, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(edge))
        out = np.zeros(len(edge) - 1, np.int64)
        for order in self.orders:
            out <<= 16
            if len(full):
                out[full] |= np.minimum.reduceat(order[ids], edge[full])
        return out


def _keyed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = sent.value.keys(*_ids(batch.column("ids")))
            yield pa.RecordBatch.from_arrays([pa.array(key), *[batch.column(c) for c in ("tie", "row", "doc_id", "ids")]], ["key", "tie", "row", "doc_id", "ids"])

    return run


class Index:
    """BM25 over the documents of one shard, with the table's statistics: a row of weights for each term that two of them
    have, a column for each document."""

    def __init__(self, ids: np.ndarray, edge: np.ndarray, facts: Statistics) -> None:
        self.docs = len(edge) - 1
        doc, term, tf = postings(ids, edge)
        self.own = np.split(term, np.searchsorted(doc, np.arange(1, self.docs)))
        useful = (np.bincount(term, minlength=TERMS) > 1) & (facts.idf > 0)
        self.row = np.where(useful, np.cumsum(useful) - 1, -1)
        doc, term, tf = (x[useful[term]] for x in (doc, term, tf))
        norm = K1 * (1 - B + B * np.diff(edge) / facts.mean)
        self.weight = np.zeros((int(useful.sum()), self.docs), np.float32)
        self.weight[self.row[term], doc] = facts.idf[term] * (tf * (K1 + 1) / (tf + norm[doc]))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        rows = self.row[terms]
        return self.weight[rows[rows >= 0]].sum(axis=0)

    def neighbours(self, terms: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Free documents that share a term, best first, equals in their order."""
        score = self.scores(terms)
        unused = np.flatnonzero(free & (score > 0))
        return unused[np.argsort(-score[unused], kind="stable")]


class Plan:
    """Sequences of one partition, filled over its shards; each piece is put out when its sequence is full."""

    def __init__(self, window: int, facts: Statistics, base: int = 0) -> None:
        self.window, self.facts, self.sequence = window, facts, base
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []  # (doc_id, start, ids, ids of the document)
        self.filled = 0
        self.query = np.zeros(0, np.int64)
        self.out: list[tuple] = []

    def close(self) -> None:
        offset = 0
        for doc_id, start, ids, n in self.open:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def put(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Whether a window was filled; what is left of the document opens the next one."""
        start, full = 0, False
        while start < len(ids):
            part = ids[start : start + self.window - self.filled]
            self.open.append((doc_id, start, part, len(ids)))
            start, self.filled = start + len(part), self.filled + len(part)
            if self.filled == self.window:
                self.close()
                full = True
        return full

    def add(self, doc_ids: list[int | None], ids: np.ndarray, edge: np.ndarray) -> None:
        """A shard's documents. An open window goes on first; where it finds nothing, and after a window that ends with its
        last document, the next unused document is the seed."""
        index = Index(ids, edge, self.facts)
        texts = [np.append(ids[a:b], np.uint16(END)).astype("<u4") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        free, first = np.ones(len(texts), bool), 0
        while True:
            near = index.neighbours(self.query, free) if self.filled else np.zeros(0, np.int64)
            seeds = not len(near)
            if seeds:
                while first < len(texts) and not free[first]:
                    first += 1
                if first == len(texts):
                    return
                near = np.array([first])
            for doc in near.tolist():
                free[doc] = False
                if self.put(doc_ids[doc], texts[doc]) or seeds:
                    self.query = index.own[doc]
                    break

    def finish(self) -> None:
        """The open window over powers of two."""
        left, filled = self.open[::-1], self.filled
        for b in range(self.window.bit_length() - 1, -1, -1):
            if not filled & (1 << b):
                continue
            room, self.open = 1 << b, []
            while room:
                doc_id, start, ids, n = left.pop()
                self.open.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    left.append((doc_id, start + room, ids[room:], n))
                room -= min(len(ids), room)
            self.close()
        self.open, self.filled = [], 0

    def taken(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*self.out, strict=True)) or [[]] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _packed(sent, window: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(window, sent.value, TaskContext.get().partitionId() << 40)
        rows: list[pa.RecordBatch] = []
        size = docs = 0

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            plan.add(table.column("doc_id").to_pylist(), *_ids(table.column("ids").chunk(0)))
            rows.clear()
            return plan.taken()

        for batch in batches:
            n = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy()) // 2
            at = 0
            while at < len(batch):
                done = int(n[at - 1]) if at else 0
                to = max(int(np.searchsorted(n, done + shard_ids - size, "right")), at + (not docs))
                to = min(to, at + SHARD_DOCS - docs)
                rows.append(batch.slice(at, to - at))
                size, docs = size + int(n[to - 1] if to else 0) - done, docs + to - at
                at = to
                if at < len(batch):
                    yield shard()
                    size = docs = 0
        if docs:
            yield shard()
        plan.finish()
        yield plan.taken()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_ids: int = SHARD_IDS, part_ids: int = PART_IDS) -> DataFrame:
    """One row per piece of a document in a sequence (PIECES). `tokenizer` is the path of a vocabulary file.

    A document's ids end with END; a null text counts as empty and has only that id. Rows that repeat, or lack, a
    doc_id are packed each for itself; documents with equal scores are taken in the order of their keys and row hashes, repeated rows in table order.
    Other columns don't matter. A seed's neighbours are the best of its shard by BM25 with the statistics of all
    documents. Gathered on the driver: a number for each id of the vocabulary.
    """
    if window & (window - 1):
        raise ValueError("the window has to be a power of two")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())  # tells repeated rows apart
    coded = materialize(rows.mapInArrow(_tokenise(tokenizer), "doc_id long, tie long, row long, n long, ids binary"), "ids")
    count, total = coded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(TERMS, np.int64)
    for r in coded.select("ids").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # TERMS rows at most
        df[r["term"]] = r["df"]
    sent = spark.sparkContext.broadcast(Statistics(df, count, total / max(count, 1)))  # a few numbers for each of TERMS
    dealt = coded.select("tie", "row", "doc_id", "ids").mapInArrow(_keyed(sent), "key long, tie long, row long, doc_id long, ids binary")
    parts = max(1, -(-(total + count) // part_ids))
    return dealt.repartitionByRange(parts, "key", "tie", "row").sortWithinPartitions("key", "tie", "row").mapInArrow(_packed(sent, window, shard_ids), PIECES)
