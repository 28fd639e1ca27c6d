"""Media columns: lossless WebP files in a binary column, read back into pixel arrays and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .words import slices

#: Bytes of text whose files are decoded together.
TOGETHER = 4 << 20


def _payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (webp.WIDTH if not raw else -len(raw) % webp.WIDTH)


def _feature(samples: np.ndarray, pictures: int) -> str:
    """Number of pictures, mean, deviation, distinct values and entropy of the samples."""
    count = np.bincount(samples, minlength=256)
    share = count[count > 0] / len(samples)
    return f"pictures={pictures};mean={samples.mean():.6f};std={samples.std():.6f};distinct={len(share)};entropy={-(share * np.log2(share)).sum():.6f}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=TOGETHER):
            payloads = [_payload(t) for t in part.column("text").to_pylist()]
            n = [len((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array([webp.samples_to_file(p) for p in payloads], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each text, zero-padded to a positive multiple of 64, as a WebP file.

    One row per row; a null text is empty; equal texts get equal files; other columns don't matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "media", TOGETHER // 2):
            files = part.column("media").to_pylist()
            streams = [webp.streams_of(f) if f is not None else [] for f in files]
            pixels = iter(webp.decode([s for own in streams for s in own]))
            rows = [[next(pixels) for _ in own] for own in streams]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([[p.shape[1] for p in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([[p.shape[0] for p in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([b"".join(p.astype("<u4").tobytes() for p in r) for r in rows], pa.binary()),
                ],
                ["doc_id", "widths", "heights", "argb"],
            )


def read(media: DataFrame) -> DataFrame:
    """(doc_id, widths, heights, argb) of (doc_id, media): the pictures' pixels, row by row, as little-endian 32-bit ARGB.

    A null file has no pictures; a file that is not lossless WebP raises.
    """
    return media.select("doc_id", "media").mapInArrow(_arrays, "doc_id long, widths array<int>, heights array<int>, argb binary")


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _DIGESTS.split(", ")]
    for batch in batches:
        for part in slices(batch, "media", TOGETHER // 2):
            files = part.column("media").to_pylist()
            rows = []
            for doc, n, file, got in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), files, webp.files_to_samples(files), strict=True):
                samples = np.frombuffer(got, np.uint8)
                pictures = -(-len(got) // (webp.WIDTH * webp.HEIGHT))
                rows.append((doc, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-webp.WIDTH :]), len(file), hashlib.sha256(file).hexdigest(), _feature(samples, pictures)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from the files of store(): sizes, hashes of payload and file, and features of the samples."""
    return stored.mapInArrow(_digest, _DIGESTS)
