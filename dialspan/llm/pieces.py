"""SentencePiece encoding and decoding by a Viterbi search over many words at once.

A text gets one leading space, spaces are written as ``▁``, and words begin where a ``▁``
follows another character, and at the ends of lines (no piece of the vocabulary spans such a place).
The distinct words of equal length advance together: for every end the hashes of the last 1
to 16 characters probe the sorted keys of the pieces, and vectorised maxima over the lengths
keep the best score and a pointer back. Of equal scores the longest last piece wins.
Characters without a piece become their UTF-8 bytes.

The search gives the segmentation whose pieces' scores have the greatest sum, which is what
the format means by a unigram model. For a file of type BPE, whose scores are the negative
ranks of merges, it is still that maximum, not the merges' order; both decode to the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices

SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Substrings that are probed at once.
PROBES = 1 << 20
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 20


class Vocabulary:
    """The pieces of a model file: sorted 64-bit keys with scores and ids, and the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece spans words")
        byte_ids = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_ids = np.array([byte_ids.get(b, sp.unk_id()) for b in range(256)], np.int32)
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.longest = max(len(self.text[i]) for i in normal)
        keys = np.array([self._key(self.text[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids], np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.powers = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        ends_line = "\\n" if not any("\n" in self.text[i] for i in normal) else ""  # then a line's end is a word of its own
        self.split = re.compile(f"{SPACE}*[^{SPACE}{ends_line}]+|{SPACE}+|\n").findall

    @staticmethod
    def _key(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + np.uint64(ord(c) + 1)
            return (h ^ np.uint64(len(piece))) * _SPREAD

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of each key; minus infinity and -1 for none."""
        score, found = np.full(keys.shape, -np.inf), np.full(keys.shape, -1, np.int32)
        some = np.nonzero(self.maybe[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        where = tuple(x[hit] for x in some)
        score[where], found[where] = self.scores[at[hit]], self.ids[at[hit]]
        return score, found

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one word after the other, their number of each) of words of one length, given as rows of code points."""
        n, length = points.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * _BASE + points[:, i].astype(np.uint64) + np.uint64(1)
        best = np.zeros((length + 1, n))
        back, piece = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.int32)
        most, rows = min(self.longest, length), np.arange(n)
        step = max(1, PROBES // (n * most))
        for low in range(1, length + 1, step):
            ends = range(low, min(length, low + step - 1) + 1)
            # the longest first: of equal sums the first wins
            end, size = np.array([(e, z) for e in ends for z in range(min(most, e), 0, -1)]).T
            hashed = (prefix[end] - prefix[end - size] * self.powers[size][:, None]) ^ size.astype(np.uint64)[:, None]
            score, found = self.probe(hashed * _SPREAD)
            lone = np.flatnonzero(size == 1)
            score[lone] = np.where(score[lone] == -np.inf, self.unknown, score[lone])
            for e, at in zip(ends, np.append(0, lone[:-1] + 1), strict=True):
                z = min(most, e)
                sums = score[at : at + z] + best[e - z : e]
                took = sums.argmax(axis=0)
                best[e], back[e], piece[e] = sums[took, rows], z - took, found[at : at + z][took, rows]
        out = np.full((n, length), -2, np.int32)
        at, nth = np.full(n, length), length
        while len(rows):
            nth -= 1
            out[rows, nth] = piece[at[rows], rows]
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        kept = out != -2
        flat, sizes = out[kept], kept.sum(axis=1)
        if (flat == -1).any():
            ids = np.split(flat, np.cumsum(sizes)[:-1])
            for r in np.flatnonzero((out == -1).any(axis=1)):
                ids[r] = self._with_bytes(points[r], back[:, r], piece[:, r])
            flat, sizes = np.concatenate(ids), np.array([len(x) for x in ids])
        return flat, sizes

    def _with_bytes(self, points: np.ndarray, back: np.ndarray, piece: np.ndarray) -> np.ndarray:
        parts, at = [], len(points)
        while at:
            raw = chr(points[at - 1]).encode("utf-8") if piece[at] < 0 else b""
            parts.append([piece[at]] if piece[at] >= 0 else self.byte_ids[np.frombuffer(raw, np.uint8)])
            at -= int(back[at])
        return np.concatenate(parts[::-1]).astype(np.int32)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, their number) of distinct words in which ``▁`` stands at the beginning only."""
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        starts, sizes, flats, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0
        for n in np.unique(length):
            same = np.flatnonzero(length == n)
            rows = max(1, PROBES // int(n * min(n, self.longest)))
            for at in range(0, len(same), rows):
                part = same[at : at + rows]
                text = "".join(words.take(pa.array(part)).to_pylist())
                flat, many = self.viterbi(np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(part), n))
                starts[part], sizes[part] = total + np.cumsum(many) - many, many
                flats.append(flat)
                total += len(flat)
        return np.concatenate(flats), starts, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; an empty text has none."""
        lists = [self.split(f" {t}".replace(" ", SPACE)) if t else [] for t in texts]
        coded = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
        flat, starts, sizes = self.encode_words(coded.dictionary)
        codes = coded.indices.to_numpy().astype(np.int64)
        many = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        every = flat[np.repeat(starts[codes] - ends[:-1], many) + np.arange(ends[-1])]
        words = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return [every[ends[a] : ends[b]] for a, b in zip(words[:-1], words[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: pieces one after the other, runs of byte pieces as UTF-8, without the leading space."""
        ids = ids.tolist()
        if self.byte_of.keys().isdisjoint(ids):
            out = "".join(map(self.text.__getitem__, ids))
        else:
            out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode() for i in ids).decode(errors="replace")
        return out.replace(SPACE, " ").removeprefix(" ")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every document; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = vocabulary.encode([t or "" for t in part.column("text").to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with text: what the ids mean; null ids mean nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            texts = [None if not x.is_valid else vocabulary.decode(x.values.to_numpy()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.drop("text").mapInArrow(run, f"{schema}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256, and whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
                    back = vocabulary.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
