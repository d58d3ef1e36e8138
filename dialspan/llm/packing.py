"""Packing token sequences by cutting-stock column generation.

Documents are tokenised where they lie and cut into pieces of at most one sequence.
A histogram of piece lengths, in classes of ``UNIT`` tokens (rounded up), goes to the
driver: at most ``length / UNIT`` rows whatever the input. There a linear program over
patterns (how many pieces of each class share one sequence) is solved by column
generation; a knapsack dynamic program prices the next column. The rounded patterns are a
small table with ranges of ranks, which is broadcast and joined with the pieces' ranks
within their class.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import slices, words_of
from .shared import cut

LENGTH, UNIT, END_ID = 4096, 8, 2
#: Most (class, salt) groups that ranks are counted in; their offsets are broadcast.
GROUPS = 100_000
#: Words whose ids a task remembers.
WORDS_KEPT = 150_000
#: Words of one part: ASCII and Latin-1 letters that are their own NFC.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_ids(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from distinct words to (their token ids one after the other, the ids of each).

    Right for tokenizers whose words never span ASCII white space, which they drop. Where the
    file asks for what most words need no library for (lower case, one splitting pattern), words
    of plain Latin-1 letters, digits and signs are lowered and split here and the library's
    model gets each distinct part once; all other words go through the whole tokenizer.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    made = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
    splits = [x for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
    simple = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and made["post_processor"] is None
    special = [x["content"] for x in made["added_tokens"]]
    odd = "[^!-~\u00a1-\u00ff]" + "".join("|" + re.escape(x[:2]) for x in special)
    parts_of = regex.compile((splits[0]["pattern"]["Regex"] if simple else "") + "|\n").findall
    letters = byte_letters()
    whole: dict[str, list[int]] = {}
    parts: dict[str, list[int]] = {}

    def recalled(known: dict[str, list[int]], words: list[str], ids_of: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        if new := [w for w in words if w not in known]:
            if len(known) > WORDS_KEPT:
                known.clear()
                new = words
            known.update(zip(new, ids_of(new), strict=True))
        found = [known[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def by_all(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]

    def by_model(words: list[str]) -> list[list[int]]:
        one = tokenizer.model.tokenize
        return [[x.id for x in one(w if w.isascii() else "".join(letters[b] for b in w.encode()))] for w in words]

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not simple:
            return recalled(whole, words.to_pylist(), by_all)
        letters = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
        plain = ~letters & ~pc.match_substring_regex(words, odd).to_numpy(zero_copy_only=False)
        # letters alone are one part
        one = pc.utf8_lower(words.filter(pa.array(letters))).dictionary_encode()
        flat, sizes = recalled(parts, one.dictionary.to_pylist(), by_model)
        codes = one.indices.to_numpy().astype(np.int64)
        kinds = [(letters, sizes[codes], gathered(flat, sizes, codes)[0])]
        # other plain words are split where the pattern says
        lines = words.filter(pa.array(plain)).cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), pa.scalar("\n"))[0].as_py()
        found = pa.array(parts_of(joined.lower() + "\n" if len(lines) else ""), pa.string()).dictionary_encode()
        texts = found.dictionary.to_pylist()
        flat, sizes = recalled(parts, [x for x in texts if x != "\n"], by_model)
        line = texts.index("\n") if "\n" in texts else len(texts)
        sizes = np.insert(sizes, line, 0) if line < len(texts) else sizes
        codes = found.indices.to_numpy().astype(np.int64)
        ids, ends = gathered(flat, sizes, codes)
        kinds.append((plain, np.diff(np.concatenate([[0], ends[1:][codes == line]])), ids))
        # the whole tokenizer gets the rest
        rest = ~letters & ~plain
        flat, sizes = recalled(whole, words.filter(pa.array(rest)).to_pylist(), by_all)
        kinds.append((rest, sizes, flat))
        every = np.zeros(len(words), np.int64)
        for mask, many, _ in kinds:
            every[mask] = many
        out = np.empty(int(every.sum()), np.uint32)
        for mask, _, ids in kinds:
            out[np.repeat(mask, every)] = ids
        return out, every

    return encode


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the coded words one after the other, and where each word's begin."""
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    lengths = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])
    return flat[at], ends


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every document's ids (a null text is empty) with the end id: whole sequences, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, offsets = words_of(part.column("text"))
                flat, ends = gathered(*encode(words), codes)
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), ends[offsets[:-1]], ends[offsets[1:]], strict=True):
                    ids = np.append(flat[a:b], np.uint32(END_ID)).astype("<u4")
                    for at in range(0, len(ids), length):
                        piece = ids[at : at + length]
                        rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def knapsack(worth: np.ndarray) -> np.ndarray:
    """How many of each width 1..C (in units) fill a capacity of C units at the greatest worth."""
    c = len(worth) - 1
    best, took = np.zeros(c + 1), np.zeros(c + 1, np.int64)
    for room in range(1, c + 1):
        sums = worth[1 : room + 1] + best[room - 1 :: -1][:room]
        w = int(sums.argmax())
        best[room], took[room] = (sums[w], w + 1) if sums[w] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    pattern, room = np.zeros(c + 1, np.int64), c
    while room:
        pattern[took[room]] += took[room] > 0
        room -= max(1, took[room])
    return pattern


def column_generation(demand: np.ndarray, gap: float = 5e-4, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used (fractions) so that ``demand[w]`` pieces of each width w are cut from few stocks.

    A revised simplex starts from patterns of one width. It ends where the material's own
    size or the bound (sum / the dearest column's worth) shows that at most the share ``gap``
    can be saved.
    """
    capacity = len(demand) - 1
    widths = np.flatnonzero(demand)
    if not len(widths):
        return []
    columns = np.diag(capacity // widths).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ demand[widths]
    least = demand @ np.arange(capacity + 1) / capacity
    for _ in range(rounds):
        if use.sum() <= least * (1 + gap):
            break
        price = inverse.sum(axis=0)
        worth = np.zeros(capacity + 1)
        worth[widths] = np.maximum(price, 0)
        column = knapsack(worth)[widths].astype(float)
        if column @ price <= 1 + gap:
            break
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, use / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = column
    full = np.zeros((len(widths), capacity + 1), np.int64)
    full[:, widths] = columns.T.astype(np.int64)
    return list(zip(full, use, strict=True))


def rounded(demand: np.ndarray, fractions: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that cut exactly ``demand``: rounded down, then up where the rest allows it, then first fit."""
    left, out = demand.copy(), []
    for pattern, use in fractions:
        if times := int(use + 1e-9):
            out.append((pattern, times))
            left -= times * pattern
    for pattern, _ in sorted(fractions, key=lambda x: (-(x[1] % 1), tuple(x[0]))):
        if pattern.any() and (pattern <= left).all():
            out.append((pattern, 1))
            left -= pattern
    while left.any():
        pattern, room = np.zeros_like(left), len(left) - 1
        while room and (fit := np.flatnonzero(left[: room + 1] > pattern[: room + 1])).size:
            pattern[fit[-1]] += 1
            room -= int(fit[-1])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, its first rank, the rank after its last, pieces in a sequence, first sequence, first slot) of the patterns."""
    merged: Counter = Counter()
    for pattern, times in patterns:
        merged[tuple(pattern.nonzero()[0]), tuple(pattern[pattern > 0])] += times
    rank: Counter = Counter()
    out, sequence = [], 0
    for (classes, counts), times in sorted(merged.items()):
        slot = 0
        for c, n in zip(map(int, classes), map(int, counts), strict=True):
            out.append((c, rank[c], rank[c] + n * times, n, sequence, slot))
            rank[c] += n * times
            slot += n
        sequence += times
    return out


def pack(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with sequence_id and offset.

    Every piece is placed once. Equal rows are pieces of their own. Ranks are counted within
    (class, salt) groups of bounded size, so that a class with a third of all pieces is many
    groups. Lengths over ``length`` or under 1 are an error of the caller. An empty table
    gives an empty one. Columns beyond doc_id, start and length are kept, whatever their
    names; only sequence_id and offset are overwritten. Pieces are ranked by all their columns
    of plain types, so that a task that runs again gives the same ranks.
    """
    spark = pieces.sparkSession
    others = [f for f in pieces.schema.fields if f.name not in ("doc_id", "start", "length", "sequence_id", "offset")]
    plain = [F.col(f"_kept.`{f.name}`") for f in others if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))]
    pieces = pieces.select("doc_id", "start", "length", F.struct(*[F.col(f"`{f.name}`") for f in others] or [F.lit(None).alias("none")]).alias("_kept"))
    order = ["doc_id", "start", "length", *plain]
    pieces = cut(pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")))
    counts = {r[0]: r[1] for r in pieces.groupBy("_class").count().collect()}  # at most length / unit rows
    demand = np.zeros(length // unit + 1, np.int64)
    for c, n in counts.items():
        demand[c] = n
    plan = slots(rounded(demand, column_generation(demand)))
    table = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "_class int, _from long, _to long, _many long, _base long, _slot long")
    group = max(256, -(-int(demand.sum()) // GROUPS))
    salts = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // group))]) if counts else F.create_map(F.lit(0), F.lit(1))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.greatest(F.try_element_at(salts, F.col("_class")), F.lit(1))))
    sums = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("_class", "_salt").count().select("_class", "_salt", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(F.broadcast(before), ["_class", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    nth = F.col("_rank") - F.col("_from")
    placed = ranked.join(F.broadcast(table), (ranked["_class"] == table["_class"]) & F.col("_rank").between(F.col("_from"), F.col("_to") - 1)).drop("_class")
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor(nth / F.col("_many"))).withColumn("_slot", F.col("_slot") + nth % F.col("_many"))
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return placed.select("doc_id", "start", "length", *[F.col(f"_kept.`{f.name}`") for f in others], "sequence_id", "offset")
