"""Vectorised words of an Arrow batch of texts.

The whole batch is split at ASCII white space in one call and dictionary-encoded,
so that what depends on a word alone is worked out once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``most`` bytes of ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + most, side="right")))
        # a copy: string kernels are not all right on arrays with an offset
        yield batch.take(pa.array(np.arange(row, stop)))
        row = stop


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in order, where each text's words begin and end).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. ``lower`` maps A-Z to a-z, nothing else.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # splitting leaves an empty word at an edge
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if not kept.all():
        flat = flat.filter(pa.array(kept))
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets.astype(np.int64)


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """The 64-bit hash of every word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each text's distinct ``size``-word shingles, ascending by text; their offsets).

    A text of fewer words than ``size`` has its whole sequence as its only shingle; one without words has none.
    """
    distinct, codes, offsets = words_of(texts, lower)
    count = np.diff(offsets)
    word = np.append(mixed(hashes(distinct)), np.uint64(0))[codes] if len(codes) else np.zeros(0, np.uint64)
    parts, owners = [], []
    step = np.uint64(0x9E3779B97F4A7C15)
    doc_of = np.repeat(np.arange(len(count)), count)
    left = np.repeat(offsets[1:], count) - np.arange(len(word))  # words from this one to the text's end
    for n in range(1, size + 1):  # shorter sequences only where they are the whole text
        at = np.flatnonzero(left >= size) if n == size else np.flatnonzero((left == n) & (count[doc_of] == n))
        if len(at):
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ word[at + k]) * step
                h ^= h >> np.uint64(29)
            parts.append(mixed(h))
            owners.append(doc_of[at])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    if size > 1:
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(count) + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
