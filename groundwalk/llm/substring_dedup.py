"""Substring dedup with a log-structured fingerprint index.

A window is `window` consecutive words of one document. A word goes if it is covered by a window that also
starts in a document with a smaller doc_id. A row for each window would move several times the text, so the index
is on anchors: of the 5-word fingerprints inside a window, the smallest is its anchor, and equal windows have equal
anchors. Documents are held in sheets, some hundred texts in a compressed row; sheets are what fingerprints point to.

The index has two kinds of sorted immutable runs, each bucketed by its fingerprint, so they are read and merged where
they are and never shuffled again:

* anchor runs: (h, state). The state of an anchor that one sheet holds, in one document, is that sheet. Any other is
  EXPANDED: all windows around it are in the window runs. So a passage of a third of all documents is one row.
* window runs: the 96-bit prints of windows around expanded anchors.

A batch of documents is merge-joined with the anchor runs. Anchors met for the second time are expanded: the batch's
sheets, and of the history only the one sheet that each points to, give the prints of the windows around them. These
are merge-joined with the window runs; of a print that is new, all but its first document are later ones, of a known one all
are. A sheet whose own documents share an anchor knows that by itself and is not told, so no message goes out for each
document of a large group. When there are more than `fan_in` runs they are compacted into one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shared_dir
from .words import U64, Words, mix, slices, split

ANCHOR = 5
#: State of an anchor all of whose windows are in the window runs.
EXPANDED = -1
#: A sheet's documents and bytes of text at most; a longer document is a sheet of its own.
SHEET_DOCS, SHEET_BYTES = 256, 1 << 20
#: Anchors that a task remembers to have told the index as shared.
TOLD = 1 << 20
_SHEET = "sheet long, ids array<long>, sizes array<int>, packed binary"


def _anchors(words: Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """For each word the anchor of the window that starts there; windows beyond their document are noise."""
    grams = words.grams(hashes, min(ANCHOR, window))
    reach = window - min(ANCHOR, window) + 1
    n = len(grams) - reach + 1
    if n <= 0:
        return np.zeros(0, U64)
    least = grams[:n].copy()
    for j in range(1, reach):
        np.minimum(least, grams[j : j + n], out=least)
    return mix(least)


def _prints(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits over the words of the windows that start at `at`: a long and an int."""
    second = mix(hashes ^ U64(0x5851F42D4C957F2D))
    w, check = np.zeros(len(at), U64), np.zeros(len(at), U64)
    for j in range(window):
        for out, own in ((w, hashes), (check, second)):
            out *= U64(0x9FB21C651E98DF25)
            out += own[at + j]
            out ^= out >> U64(29)
    return mix(w).view(np.int64), (mix(check) >> U64(32)).astype(np.uint32).view(np.int32)


def _text_hash(raw: bytes) -> int:
    """As F.xxhash64 has it."""
    return int.from_bytes(xxhash.xxh64_digest(raw, seed=42), "big", signed=True)




# ---- sheets -------------------------------------------------------------------------------------------------


def _sheets(batch_number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet = batch_number << 48 | TaskContext.get().partitionId() << 24
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, limit=SHEET_BYTES):
                for at in range(0, len(part), SHEET_DOCS):
                    own = part.slice(at, SHEET_DOCS)
                    texts = [(t or "").encode() for t in own.column("text").to_pylist()]
                    columns = [[sheet], [own.column("doc_id").to_pylist()], [[len(t) for t in texts]], [pack(b"".join(texts))]]
                    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sheet", "ids", "sizes", "packed"])
                    sheet += 1

    return run


@dataclass
class Sheet:
    """Texts of a sheet. Windows that start at word i are `inside` their document; doc_ids of null are not `known`."""

    texts: list[bytes]
    ids: list[int | None]
    words: Words
    hashes: np.ndarray
    anchors: np.ndarray
    inside: np.ndarray
    owner: np.ndarray

    @classmethod
    def open(cls, ids: list[int | None], sizes: list[int], packed: bytes, window: int) -> Sheet:
        raw = zstandard.ZstdDecompressor().decompress(packed)
        ends = np.cumsum(sizes).tolist()
        texts = [raw[b - n : b] for b, n in zip(ends, sizes, strict=True)]
        words = split(pa.array(texts, pa.binary()).cast(pa.string()))
        hashes = words.hashes()
        anchors = _anchors(words, hashes, window) & ~U64(1)
        count = np.diff(words.first)
        doc = np.repeat(np.arange(len(count)), count)[: len(anchors)]
        known = np.array([i is not None for i in ids], bool)
        inside = (np.arange(len(anchors)) + window <= words.first[1:][doc]) & known[doc]
        owner = np.array([i or 0 for i in ids], np.int64)[doc]
        return cls(texts, ids, words, hashes, anchors, inside, owner)

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, sorted, and whether two documents of the sheet hold them."""
        at = np.flatnonzero(self.inside)
        key, who = self.anchors[at], self.owner[at]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])  # neighbours mostly share their anchor
        key, who = key[fresh], who[fresh]
        order = np.argsort(key)
        key, who = key[order], who[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            return key, np.zeros(0, bool)
        return key[first], np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)

    def hits(self, keys: np.ndarray, alone: bool) -> np.ndarray:
        """Starts of the windows whose anchor is one of the keys (their low 32 bits), or shared in the sheet where `alone`."""
        wanted = np.isin((self.anchors & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), keys)
        if alone:
            key, many = self.held()
            wanted |= np.isin(self.anchors, key[many])
        return np.flatnonzero(wanted & self.inside)

    def prints(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, group starts, w, check, least owner) of windows, sorted by w; the last three for each print."""
        w, check = _prints(self.hashes, at, window)
        order = np.argsort(w)
        w, check = w[order], check[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.owner[at][order], first) if len(first) else np.zeros(0, np.int64)
        return order, first, w[first], check[first], least


def _numbers(column: pa.Array, k: int) -> np.ndarray:
    """The list in row k as numbers; of a null, none."""
    return column[k].values.to_numpy() if column[k].is_valid else np.zeros(0, np.int64)


def _opened(batches: Iterator[pa.RecordBatch], window: int, *more: str) -> Iterator[tuple]:
    """(sheet number, sheet, lists of numbers)."""
    for batch in batches:
        column = batch.column
        for k in range(len(batch)):
            sheet = Sheet.open(column("ids")[k].as_py(), _numbers(column("sizes"), k).tolist(), column("packed")[k].as_py(), window)
            yield column("sheet")[k].as_py(), sheet, *[_numbers(column(name), k) for name in more]


# ---- anchors ------------------------------------------------------------------------------------------------


def _entries(window: int):
    """(h, sheet, many) for each anchor of a sheet. One that two of its documents hold is told once by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for number, sheet in _opened(batches, window):
            key, many = sheet.held()
            shared = np.flatnonzero(many)
            again = np.array([h in told for h in key[shared].tolist()], bool)
            told.update(key[shared[~again]].tolist())
            if len(told) > TOLD:
                told.clear()
            use = np.ones(len(key), bool)
            use[shared[again]] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(np.full(int(use.sum()), number)), pa.array(many[use])], ["h", "sheet", "many"])

    return run


def _merge(keep: bool):
    """Of rows (h, sheet, many, old) sorted by h: the run's rows (h, state), and (h, ask) for each sheet that is to be
    told that an anchor it holds is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row so far if its anchor is not known to be shared; the anchor that is.
        left: list[np.ndarray] | None = None
        known: int | None = None

        def out(h: np.ndarray, state: np.ndarray | None, ask: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(h), none if state is None else pa.array(state), none if ask is None else pa.array(ask)], ["h", "state", "ask"])

        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column("h").to_numpy(), batch.column("sheet").to_numpy(), batch.column("many").to_numpy(zero_copy_only=False), batch.column("old").fill_null(-2).to_numpy()]
            if left is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(left, columns, strict=True)]
            h, sheet, many, old = columns
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(h)))
            go_on = known is not None and known == h[0]
            shared = (size > 1) | np.logical_or.reduceat(many, first) | (old[first] != -2)
            shared[0] |= go_on
            begun = np.ones(len(first), bool)
            begun[0] = not go_on
            left = None if shared[-1] else [c[-1:] for c in columns]
            known = int(h[-1]) if shared[-1] else None
            single = first[~shared]
            if keep and len(single):
                single = single[: len(single) - (left is not None)]
                yield out(h[single], sheet[single], None)
            fresh = first[shared & begun]
            if keep:
                marks = fresh[old[fresh] != EXPANDED]
                yield out(h[marks], np.full(len(marks), EXPANDED), None)
            before = fresh[old[fresh] >= 0]
            yield out(h[before], None, old[before])
            told = np.flatnonzero(np.repeat(shared, size) & ~many)
            yield out(h[told], None, sheet[told])
        if left is not None and keep:
            yield out(left[0], left[1], None)

    return run


# ---- windows ------------------------------------------------------------------------------------------------


def _found(window: int, fresh: bool):
    """(w, check, doc_id, sheet) of each print around the anchors asked for, with its first document in the sheet; no sheet
    where it belongs to the history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, sheet, keys in _opened(batches, window, "keys"):
            _, _, w, check, least = sheet.prints(sheet.hits(keys, alone=fresh), window)
            where = pa.array(np.full(len(w), number)) if fresh else pa.nulls(len(w), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(check), pa.array(least), where], ["w", "check", "doc_id", "sheet"])

    return run


def _later(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (w, check, doc_id, sheet, old) sorted by the first three: a row for each sheet all of whose documents come
    after the print's first one, and to keep, one without sheet for each print that is new."""
    last, first = None, None
    for batch in batches:
        if not len(batch):
            continue
        w, check, doc = (batch.column(c).to_numpy() for c in ("w", "check", "doc_id"))
        old, sheet = batch.column("old").to_numpy(zero_copy_only=False), batch.column("sheet")
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (check[1:] != check[:-1])
        new[0] = last != (w[0], check[0])
        group = np.cumsum(new)
        firsts = np.concatenate([[first if first is not None else 0], doc[new]]).astype(np.int64)
        last, first = (w[-1], check[-1]), firsts[group[-1]]
        run = np.flatnonzero(new & ~old) if keep else np.zeros(0, np.int64)
        told = np.flatnonzero((old | (doc > firsts[group])) & sheet.is_valid().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(w[run]), pa.array(check[run]), pa.nulls(len(run), pa.int64())], ["w", "check", "ask"])
        yield pa.RecordBatch.from_arrays([pa.array(w[told]), pa.array(check[told]), sheet.take(pa.array(told))], ["w", "check", "ask"])


_CUT = "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept string, spans binary"


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.binary())])
        for _, sheet, keys, ws, checks in _opened(batches, window, "keys", "ws", "checks"):
            at = sheet.hits(keys, alone=True)
            order, first, w, check, least = sheet.prints(at, window)
            known = np.zeros(len(w), bool)
            if len(ws):
                by = np.argsort(ws)
                place = np.minimum(np.searchsorted(ws, w, sorter=by), len(ws) - 1)
                known = (ws[by][place] == w) & (checks[by][place] == check)
            size = np.diff(np.append(first, len(order)))
            gone = at[order][np.repeat(known, size) | (sheet.owner[at][order] > np.repeat(least, size))]
            n = len(sheet.hashes) + 1
            removed = np.cumsum(np.bincount(gone, minlength=n) - np.bincount(gone + window, minlength=n))[:-1] > 0
            rows: list[tuple] = []
            for d, (doc_id, raw) in enumerate(zip(sheet.ids, sheet.texts, strict=True)):
                own = removed[sheet.words.first[d] : sheet.words.first[d + 1]]
                words = raw.split()
                cut = int(own.sum())
                steps = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                inner = [0, *steps.tolist(), len(words)]
                kept = b" ".join([x for a, b in zip(inner[::2], inner[1::2], strict=True) for x in words[a:b]] if cut else words)
                rows.append((doc_id, _text_hash(raw), len(words), cut, hashlib.sha256(kept).hexdigest(), kept.decode() if cut else None, steps.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _kinds(df: DataFrame, *without: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name not in without]


def squeezed_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `packed`, the text as a zstandard frame or null, in place of the column `text`."""
    kept = _kinds(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([None if t is None else pack(t.encode()) for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c, _ in kept], packed], [*[c for c, _ in kept], "packed"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in [*kept, ("packed", "binary")]))


def opened_rows(rows: DataFrame, name: str = "text") -> DataFrame:
    """rows with their text again, as the column `name`: `kept` where there is one, else what `packed` holds."""
    other = _kinds(rows, "packed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            both = zip(batch.column("kept").to_pylist(), batch.column("packed").to_pylist(), strict=True)
            text = [k if k is not None else None if p is None else unpack(p).decode() for k, p in both]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c, _ in other], pa.array(text, pa.string())], [*[c for c, _ in other], name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in [*other, (name, "string")]))


class FingerprintIndex:
    """Sheets of the documents so far, and runs of their anchors and windows.

    Batches come in rising order of doc_id. `keep=False` leaves out the runs of a batch after which none follows.
    """

    def __init__(self, window: int = 13, fan_in: int = 4) -> None:
        self.window, self.fan_in = window, fan_in
        self.sheets: list[DataFrame] = []
        self.anchors: list[DataFrame] = []
        self.windows: list[DataFrame] = []
        self.top: int | None = None
        self.buckets = 0

    def _write(self, df: DataFrame, key: str) -> DataFrame:
        """df as a table of sorted buckets in the shared folder; its name leaves the catalogue, its files stay."""
        spark = df.sparkSession
        name = f"groundwalk_{key}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
        out = spark.table(name)
        out.schema  # resolved before the name goes
        spark.sql(f"DROP TABLE {name}")
        return out

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.buckets, key)

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the text left, null if nothing
        went), spans (removed word ranges, packed int64 ends), text_hash (xxhash64 of the text, to tell rows apart).

        A null text has no words. A row without doc_id is neither indexed nor cut. Rows that repeat a doc_id stand for
        one document: they don't remove each other's words. Other columns don't matter.
        """
        spark = docs.sparkSession
        self.buckets = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        low, top = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and self.top is not None and low <= self.top:
            raise ValueError(f"doc_id {low} comes after {self.top}: batches must rise")
        sheets = self._write(self._dealt(docs.mapInArrow(_sheets(len(self.sheets)), _SHEET), "sheet"), "sheet")

        met = self._dealt(sheets.mapInArrow(_entries(self.window), "h long, sheet long, many boolean"), "h").withColumn("old", F.lit(None).cast("long"))
        for run in self.anchors:  # later runs know better
            met = met.join(run.withColumnRenamed("state", "now"), "h", "left").withColumn("old", F.coalesce("now", "old")).drop("now")
        merged = self._write(met.sortWithinPartitions("h").mapInArrow(_merge(keep), "h long, state long, ask long"), "h")
        low_bits = F.col("h").bitwiseAND(0xFFFFFFFF)
        key = F.when(low_bits >= 1 << 31, low_bits - (1 << 32)).otherwise(low_bits).cast("int")
        asked = self._write(self._dealt(merged.where("ask is not null").groupBy(F.col("ask").alias("sheet")).agg(F.collect_list(key).alias("keys")), "sheet"), "sheet")

        self.asked = asked
        # Of the history only batches with a sheet that is asked for are read: a number for each at most.
        touched = sorted(r[0] for r in asked.select(F.shiftright("sheet", 48).alias("n")).distinct().collect()) if self.sheets else []
        prints = sheets.join(asked, "sheet", "left").select("sheet", "ids", "sizes", "packed", "keys").mapInArrow(_found(self.window, True), "w long, check int, doc_id long, sheet long")
        for n in touched:
            if n < len(self.sheets):
                old = self.sheets[n].join(asked, "sheet").select("sheet", "ids", "sizes", "packed", "keys")
                prints = prints.union(old.mapInArrow(_found(self.window, False), "w long, check int, doc_id long, sheet long"))
        found = self._dealt(prints, "w").withColumn("old", F.lit(False))
        for run in self.windows:
            # The second half of a print is no key of the join, as runs are bucketed by the first.
            known = run.select(F.col("w").alias("w_"), F.col("check").alias("check_"))
            found = found.join(known, (F.col("w") == F.col("w_")) & (F.col("check") - F.col("check_") == 0), "left").withColumn("old", F.col("old") | F.col("w_").isNotNull()).drop("w_", "check_")
        later = found.sortWithinPartitions("w", "check", "doc_id").mapInArrow(lambda rows: _later(rows, keep), "w long, check int, ask long")
        later = self._write(later, "w") if keep else later
        earlier = later.where("ask is not null").groupBy(F.col("ask").alias("sheet")).agg(F.collect_list("w").alias("ws"), F.collect_list("check").alias("checks"))
        out = sheets.join(asked, "sheet", "left").join(earlier, "sheet", "left").select("sheet", "ids", "sizes", "packed", "keys", "ws", "checks").mapInArrow(_cut(self.window), _CUT)

        self.sheets.append(sheets)
        self.top = top if top is not None else self.top
        if keep:
            self.anchors.append(merged.where("state is not null").select("h", "state"))
            self.windows.append(later.where("ask is null").select("w", "check"))
            if len(self.anchors) > self.fan_in:
                self.compact()
        return out

    def compact(self) -> None:
        """Each kind's runs as one. They are bucketed alike, so buckets are merged in place."""
        anchors, windows = self.anchors[0], self.windows[0]
        for run in self.anchors[1:]:
            anchors = anchors.join(run.withColumnRenamed("state", "now"), "h", "full_outer").select("h", F.coalesce("now", "state").alias("state"))
        for run in self.windows[1:]:
            other = run.select(F.col("w").alias("w_"), F.col("check").alias("check_"))
            windows = windows.join(other, (F.col("w") == F.col("w_")) & (F.col("check") - F.col("check_") == 0), "full_outer").select(F.coalesce("w", "w_").alias("w"), F.coalesce("check", "check_").alias("check"))
        self.anchors, self.windows = [self._write(anchors, "h")], [self._write(windows, "w")]


def deduplicate(docs: DataFrame, window: int = 13, batches: int = 3, fan_in: int = 1) -> DataFrame:
    """`FingerprintIndex.add` over the whole table, in `batches` of rising doc_id and about equal size."""
    index, out = FingerprintIndex(window, fan_in), None
    cuts = sorted({int(x) for x in docs.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)})
    for k, low in enumerate([None, *cuts]):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        if k < len(cuts):
            part = part.where((F.col("doc_id") <= cuts[k]) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= cuts[k])
        cut = index.add(part, keep=k < len(cuts))
        out = cut if out is None else out.union(cut)
    return out
