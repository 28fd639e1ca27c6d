"""Quality classifier: a support vector machine on naive Bayes features, trained in numpy.

A text's features are the indicators of its word 1- and 2-grams and of the shapes of its words (letters folded to
one of lower, upper, digit; other characters kept), hashed into 2^18 places. Each place is scaled by the log ratio
of its smoothed frequencies in the two classes; rows are scaled to unit length; a linear model with squared hinge
loss is fitted by dual coordinate descent, and its margin becomes a probability by Platt's sigmoid, fitted on
margins that were predicted for rows left out of their fit. The sample that is learned from is bounded:
SAMPLE labelled rows, those with the smallest hash of their id, each by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, mix, slices, split

PLACES = 1 << 18
#: Labelled rows that a fit uses at most, for each class.
SAMPLE = 2000
#: Folds of documents by crc32 of their id; fold 0 is held out.
FOLDS = 5
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row ends and the sorted distinct places of each row's features."""
    words = split(text, lower=False)
    plain = words.hashes()
    first, last = words.data[words.start], words.data[np.maximum(words.end - 1, 0)] if len(words.end) else words.start
    # The shape of a word: fold of its first and last two bytes, its length up to 12, and whether all its letters are capitals.
    shape_data = _SHAPE[words.data]
    upper = np.concatenate([[0], np.cumsum(shape_data == 65)])
    lower = np.concatenate([[0], np.cumsum(shape_data == 97)])
    length = words.end - words.start
    ups, lows = upper[words.end] - upper[words.start], lower[words.end] - lower[words.start]
    case = np.where(lows == 0, np.where(ups > 1, 2, 3), np.where(ups > 0, 1, 0))
    f, l1 = shape_data[words.start] if len(first) else first, shape_data[words.end - 1] if len(last) else last
    l2 = shape_data[np.maximum(words.end - 2, words.start)] if len(last) else last
    shape = mix(((f.astype(U64) << U64(24)) | (l2.astype(U64) << U64(16)) | (l1.astype(U64) << U64(8)) | (np.minimum(length, 12).astype(U64) << U64(2)) | case.astype(U64)) ^ U64(0xA5A5A5A5_00000000))
    tail = mix(((l2.astype(U64) << U64(16)) | (l1.astype(U64) << U64(8)) | case.astype(U64)) ^ U64(0x77770000_00000000))
    count = np.diff(words.first)
    doc = np.repeat(np.arange(len(count), dtype=np.int64), count)
    same = np.zeros(len(doc), bool)
    same[:-1] = doc[1:] == doc[:-1]
    pair = words.grams(plain, 2)
    pair = np.append(pair, np.zeros(len(plain) - len(pair), U64))
    tails = np.append(mix(tail[:-1] * U64(31) + tail[1:]), np.zeros(min(1, len(tail)), U64))
    again = np.zeros(len(doc), bool)
    again[:-1] = same[:-1] & (plain[1:] == plain[:-1])
    parts = [(plain, slice(None)), (shape, slice(None)), (tail, slice(None)), (pair, same), (tails, same), (np.full(len(doc), 0x1234567, U64), again)]
    rows = np.concatenate([doc[pick] for _, pick in parts])
    place = np.concatenate([(h[pick] >> U64(46)).astype(np.int64) for h, pick in parts])
    keys = np.unique(rows * PLACES + place)
    rows, place = keys >> 18, keys & (PLACES - 1)
    return np.searchsorted(rows, np.arange(1, len(count) + 1)), place.astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, ends: np.ndarray, place: np.ndarray, unit: bool = True) -> np.ndarray:
        starts = np.concatenate([[0], ends[:-1]])
        total = np.concatenate([[0.0], np.cumsum(self.weights[place])])
        return (total[ends] - total[starts]) / np.sqrt(np.maximum(ends - starts, 1)) + self.bias

    def scores(self, text: pa.Array) -> np.ndarray:
        z = self.slope * self.margins(*features(text)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _svm(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; weights are per place, with the ratio multiplied in."""
    w, b = np.zeros(PLACES), 0.0
    alpha = np.zeros(len(rows))
    scaled = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norm = np.array([s @ s for s in scaled]) + 1 + 1 / (2 * c)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ scaled[i] + b) - 1 + alpha[i] / (2 * c)
            if alpha[i] == 0 and gradient >= 0:
                continue
            new = max(alpha[i] - gradient / norm[i], 0.0)
            step = (new - alpha[i]) * y[i]
            w[rows[i]] += step * scaled[i]
            b += step
            worst, alpha[i] = max(worst, abs(gradient)), new
        if worst < 1e-3:
            break
    return w * ratio, b


def fit(text: list[str | None], label: list[int], c: float = 1.0, epochs: int = 20, counts: tuple[int, int] | None = None) -> Model:
    """A model of whole texts and labels 0 or 1; `counts` as in `fit_places`."""
    rows: list[np.ndarray] = []
    for batch in pa.table({"text": pa.array(text, pa.string())}).to_batches():
        for part in slices(batch):
            ends, place = features(part.column("text"))
            rows += np.split(place, ends[:-1])
    return fit_places(rows, label, c, epochs, counts)


def fit_places(rows: list[np.ndarray], label: list[int], c: float = 1.0, epochs: int = 20, counts: tuple[int, int] | None = None) -> Model:
    """A model of rows' places and labels 0 or 1. With one class only, every score is that class's smoothed share.

    `counts` are those of labels 0 and 1 among all labelled rows, of which the rows may be a sample by class: scores are
    fitted as if each class stood for so many, so they don't depend on how much of a class was sampled.
    """
    y = np.where(np.array(label, dtype=int) > 0, 1, -1)
    down, up = counts or (int(np.sum(y < 0)), int(np.sum(y > 0)))
    if len(np.unique(y)) < 2:
        share = (up + 1) / (up + down + 2)
        return Model(np.zeros(PLACES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))

    def solve(use: np.ndarray) -> tuple[np.ndarray, float]:
        p = np.ones(PLACES)
        q = np.ones(PLACES)
        for i in use:
            (p if y[i] > 0 else q)[rows[i]] += 1
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        return _svm([rows[i] for i in use], ratio, y[use], c, epochs, 7)

    margin = np.zeros(len(y))
    fold = np.arange(len(y)) % 3
    for k in range(3):
        use = np.flatnonzero(fold != k)
        if len(np.unique(y[use])) < 2:
            continue
        w, b = solve(use)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + b
    w, b = solve(np.arange(len(y)))
    slope, offset = _platt(margin, y, np.where(y > 0, up / np.sum(y > 0), down / np.sum(y < 0)))
    return Model(w.astype(np.float32), float(b), slope, offset)


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid by damped Newton steps on smoothed targets; a row stands for `weight` rows."""
    up, down = weight[y > 0].sum(), weight[y < 0].sum()
    weight = weight / weight.mean()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([np.sum(weight * (p - target) * margin), np.sum(weight * (p - target))])
        v = weight * p * (1 - p) + 1e-9
        h = np.array([[np.sum(v * margin * margin), np.sum(v * margin)], [np.sum(v * margin), np.sum(v)]]) + np.eye(2) * 1e-6
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """A model of `target` from labelled documents that are not held out; at most `sample` rows of each class.

    Rows without id, label or match are not used; rows that repeat an id are one row each, up to twice `sample` in all.
    The driver gets the rows' places, 4 * PLACES bytes for each at most and mostly a few thousand, not their texts.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds=folds)).select("doc_id", F.col(target).cast("int").alias("label"))
    ranked = [known.where(F.col("label") <= 0), known.where(F.col("label") > 0)]
    chosen = None
    for part in ranked:
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * sample small rows: a proven bound for the broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "label").limit(2 * sample)
    placed = rows.mapInArrow(_places, "doc_id long, label int, places binary").collect()
    order = sorted(placed, key=lambda r: (r["doc_id"], r["label"], r["places"]))
    np.random.default_rng(11).shuffle(order)
    return fit_places([np.frombuffer(r["places"], np.int32) for r in order], [r["label"] for r in order], counts=tuple(part.count() for part in ranked))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            ends, place = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label"), pa.array([x.tobytes() for x in np.split(place, ends[:-1])], pa.binary())], ["doc_id", "label", "places"])


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns that docs has, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # PLACES floats, whatever the input
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(sent.value.scores(part.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (doc_id by default; not score or predicted), score and predicted; one row per row. A null text
    counts as empty; rows that repeat are scored each; equal texts get equal scores; other columns don't matter."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # PLACES floats, whatever the input
    keep = keep or ["doc_id"]
    chosen = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    names = [*keep, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = sent.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names)

    kinds = ", ".join([*[f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep], "score double", "predicted int"])
    return chosen.mapInArrow(run, kinds)
