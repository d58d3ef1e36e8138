"""Quality scores by votes of the nearest labelled neighbours in a latent-semantic space.

A text is its counts of hashed byte trigrams (and of words that repeat the one before).
Document frequencies come from all texts. The latent space is the truncated singular value
decomposition of a bounded sample of labelled texts; their vectors, at most ``SAMPLE`` rows
of ``RANK`` numbers, are broadcast. Every text is then projected in blocks, and exact cosine
products with all labelled vectors give its neighbours, whose labels count by similarity.
Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices, words_of

FEATURES = 4096
#: Most labelled texts that are fitted on: half of them from each label where it has so many.
SAMPLE = 4096
RANK, NEIGHBOURS, SHARPNESS, THRESHOLD = 64, 15, 8.0, 0.7
REPEATS = 1.5
#: Rows whose dense counts are held at once.
BLOCK = 256


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Dense feature counts of the texts, ``BLOCK`` rows at a time; a null text is empty.

    The first feature is the share of words that repeat the one before.
    """
    _, codes, offsets = words_of(texts)
    again = np.zeros(len(codes) + 1, np.int64)
    again[1:-1] = codes[1:] == codes[:-1]
    again[np.minimum(offsets[:-1], len(codes))] = 0
    repeats = np.concatenate([[0], np.cumsum(again[:-1])])
    repeats = repeats[offsets[1:]] - repeats[offsets[:-1]]
    raw = [(x or "").encode() for x in texts.to_pylist()]
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        text = np.frombuffer(b"\0\0".join(part) + b"\0\0", np.uint8).astype(np.uint32)
        sizes = np.array([len(x) for x in part]) + 2
        owner = np.repeat(np.arange(len(part), dtype=np.int64), sizes)[: len(text) - 2]
        gram = (text[:-2] << 16) | (text[1:-1] << 8) | text[2:]
        inside = (text[:-2] > 0) & (text[1:-1] > 0) & (text[2:] > 0)
        feature = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        table = np.bincount((owner * FEATURES + feature)[inside], minlength=len(part) * FEATURES).reshape(len(part), FEATURES).astype(np.float32)
        table[:, 0] = repeats[at : at + BLOCK] / np.maximum(1, np.diff(offsets)[at : at + BLOCK])
        yield table


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature stands, and how many texts have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for table in counts(part.column("text")):
                    df[:-1] += (table > 0).sum(axis=0)
                    df[-1] += int(table.any(axis=1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(df)], names=["feature", "n"])

    sums = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1, np.int64)
    for feature, n in sums.collect():  # a row a feature
        out[feature] = n
    return out[:-1], int(out[-1])


def weighted(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors; the share of repeated words weighs by its root against all trigrams together."""
    share = table[:, 0]
    table = np.log1p(table) * idf
    table[:, 0] = 0
    table[:, 0] = REPEATS * np.sqrt(share) * np.linalg.norm(table, axis=1)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


class Model:
    """Inverse document frequencies, the latent axes, and the labelled texts' latent unit vectors."""

    def __init__(self, idf: np.ndarray, tables: np.ndarray, labels: np.ndarray):
        self.idf, self.labels = idf.astype(np.float32), labels.astype(np.float32)
        rows = weighted(tables, self.idf)
        rank = min(RANK, *rows.shape) if rows.size else 0
        rng = np.random.default_rng(7)
        if rank:
            probe = rows @ rng.standard_normal((rows.shape[1], min(rank + 16, rows.shape[0]))).astype(np.float32)
            for _ in range(3):
                probe, _ = np.linalg.qr(rows @ (rows.T @ probe))
            _, _, axes = np.linalg.svd(probe.T @ rows, full_matrices=False)
            self.axes = axes[:rank].T.astype(np.float32).copy()
        else:
            self.axes = np.zeros((FEATURES, 1), np.float32)
        self.vectors = self.latent(tables)

    def latent(self, table: np.ndarray) -> np.ndarray:
        x = weighted(table, self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, table: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, by similarity to the power ``SHARPNESS``.

        0 for a text without features; one half where there is no labelled neighbour. All
        neighbours that are as near as the last of the nearest vote, too.
        """
        if not len(self.labels):
            return np.where(table.any(axis=1), 0.5, 0.0)
        near = self.latent(table) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        row, at = np.nonzero(near >= np.partition(near, -k, axis=1)[:, -k :][:, :1])
        weight = np.maximum(near[row, at], 0).astype(np.float64) ** SHARPNESS
        total = np.bincount(row, weight, minlength=len(near))
        vote = np.where(total > 0, np.bincount(row, weight * self.labels[at], minlength=len(near)) / np.maximum(total, 1e-300), 0.5)
        return np.where(table.any(axis=1), np.clip(vote, 0, 1), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from labels of documents that aren't held out; ``docs`` (all of them) give the frequencies.

    The labelled texts are the first by a hash of their id, ``most / 2`` of either label at
    most. Labels that are null or neither 0 nor 1 teach nothing; without any the model knows
    no neighbours.
    """
    df, n = frequencies(docs)
    idf = np.log1p(n / (1.0 + df))
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = [known.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for x in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most ``most`` ids
    texts = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of several texts under one id the least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [row for table in counts(part.column("text")) for row in table]
                at = [np.flatnonzero(r) for r in rows]
                packed = [(x.astype("<u2").tobytes(), r[x].astype("<f4").tobytes()) for x, r in zip(at, rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.array(x, pa.binary()) for x in zip(*packed, strict=True))], names=["doc_id", "label", "at", "value"])

    sparse = texts.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(run, "doc_id long, label int, at binary, value binary")
    rows = sorted(sparse.collect(), key=lambda r: r.doc_id)
    table = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        table[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    return Model(idf, table, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score; a column of that name is replaced. Equal texts get equal scores up to rounding."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = [known.value.score(table) for table in counts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(np.concatenate(values), 6))], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: the score is ``threshold`` or more) of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = score(rows, fit(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
