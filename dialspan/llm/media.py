"""Media columns: texts as progressive JPEG, and what is read back from the stored bytes.

A payload is a text's UTF-8 bytes (null: none) with bytes 0 up to a positive multiple of 64.
Payloads over ``PICTURE_BYTES`` are several pictures one after the other, so that a very long
text is coded and decoded in bounded memory. Equal texts have equal media. The tensors are
full-resolution RGB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .arrowtext import slices

UNIT_BYTES, PICTURE_BYTES = 64, 1 << 20
#: Bytes of payload or media that are worked on together.
TOGETHER = 1 << 20
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes((-len(raw)) % UNIT_BYTES if raw else UNIT_BYTES)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                texts = part.column("text").to_pylist()
                strips = [[p[i : i + PICTURE_BYTES] for i in range(0, len(p), PICTURE_BYTES)] for p in map(payload_of, texts)]
                if sum(map(len, strips)) == len(strips):
                    media = jpeg.encode([s[0] for s in strips])
                else:
                    media = [b"".join(jpeg.encode([x])[0] for x in s) for s in strips]
                sizes = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pictures(media: bytes) -> list[bytes]:
    """The pictures that stand one after the other; the marker of an end is in no coded data."""
    parts = media.split(b"\xff\xd9\xff\xd8")
    return [(b"\xff\xd8" if i else b"") + p + (b"\xff\xd9" if i < len(parts) - 1 else b"") for i, p in enumerate(parts)]


def decoded(media: list[bytes]) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """For each of the media, (payload, RGB tensor) of its pictures."""
    if all(len(pictures(m)) == 1 for m in media):
        for units, parts, across, _ in jpeg.decode(media):
            yield [(units.astype(np.uint8).tobytes(), jpeg.rgb(parts, across))]
    else:
        for m in media:
            found = (jpeg.decode([p])[0] for p in pictures(m))
            yield [(units.astype(np.uint8).tobytes(), jpeg.rgb(parts, across)) for units, parts, across, _ in found]


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, picture (its number), height, width and pixels (row by row, three bytes each) of the media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", TOGETHER):
                rows = [(doc, n, *t.shape[:2], t.tobytes()) for doc, found in zip(part.column("doc_id").to_pylist(), decoded(part.column("media").to_pylist()), strict=True) for n, (_, t) in enumerate(found)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "picture", "height", "width", "pixels"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, picture int, height int, width int, pixels binary")


def features(stored: DataFrame) -> DataFrame:
    """Digests of the payload that is read back from the media, and means and deviations of the RGB channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", TOGETHER):
                media = part.column("media").to_pylist()
                rows = []
                for m, found in zip(media, decoded(media), strict=True):
                    sha, size, n, sums, squares = hashlib.sha256(), 0, 0, np.zeros(3), np.zeros(3)
                    for payload, tensor in found:
                        sha.update(payload)
                        size += len(payload)
                        flat = tensor.reshape(-1, 3)
                        n += len(flat)
                        sums += flat.sum(axis=0, dtype=np.int64)
                        squares += np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
                    mean = sums / n
                    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
                    feature = f"{len(found)}:{n}:" + ",".join(f"{x:.3f}" for x in (*mean, *spread))
                    rows.append((size, sha.hexdigest(), zlib.crc32(found[-1][0][-UNIT_BYTES:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *(c.split()[0] for c in FEATURES.split(", "))])

    return stored.mapInArrow(run, f"doc_id long, {FEATURES}")
