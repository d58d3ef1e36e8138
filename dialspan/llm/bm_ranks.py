"""Ranked lexical search with classes of equal bags.

A document matters to a set of items only by the occurrences of the items' terms and by its
length class m, so documents that agree in both have the same score for every item. The
documents are restricted to the items' vocabulary, equal bags of equal m are one class (found
by a hash of both and verified on the bag itself), each class is scored once against all items in
blocks, and the best classes are expanded to their members by ascending id.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
lower-cased. They are cut out of a whole batch of texts by one table over bytes and looked up
by Arrow's own hash of strings, so that a term counts only if it is equal.

1. One pass over the texts keeps the number of terms and the bag (numbers of vocabulary terms,
   ascending, with their occurrences) and counts in fixed memory by task how many documents
   hold a term.
2. A class keeps its smallest id. A task scores its classes and keeps the ``best`` of each
   item by score and smallest id, which are then ranked over all tasks. No more classes
   can reach the list: each has a member that ranks before all of a later class.
3. Of the classes that are left, the ``best`` members with the smallest ids are joined with
   the items that chose them and ranked.

The items are read in groups whose texts have at most ``MOST_BYTES`` (one item at least); what
is broadcast is one group's vocabulary. More items are more groups, each with passes of its own.

Null texts have no terms; documents without any count in nothing, without one of the
items' they have score 0 and are never listed. Rows that share a doc_id are documents of their own. A
null doc_id is ranked after others with the same score. Items without terms, or whose terms no
document holds, have no rows; items that share an item_id, or have none, each have their
rows. Further columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import slices
from .shared import cut

BEST = 20
#: Bytes of the items' texts whose vocabulary is broadcast at once, and of a joined table that may be.
MOST_BYTES, MOST_BROADCAST = 8 << 20, 16 << 20
#: Classes that are scored at once.
BLOCK = 1024
#: Which bytes of UTF-8 belong to a term: digits, letters and all beyond ASCII.
IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms in order, where each text's terms begin and end); a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(joined) + 1, joined.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
    inside = IN_TERM[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    letters = LOWER[raw[inside]]
    terms = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
    return terms, np.searchsorted(begin, offsets - offsets[0])


class Items:
    """A group of items: its vocabulary, and which items hold a term how often (by term)."""

    def __init__(self, texts: list[str | None]):
        terms, edges = terms_of(pa.array(texts, pa.large_string()))
        coded = terms.dictionary_encode()
        self.vocabulary: pa.Array = coded.dictionary
        self.many = len(texts)
        counts = Counter(zip(coded.indices.to_pylist(), np.repeat(np.arange(len(texts)), np.diff(edges)).tolist(), strict=True))
        held = np.array([(t, i, n) for (t, i), n in sorted(counts.items())], np.int64).reshape(-1, 3)
        self.starts = np.searchsorted(held[:, 0], np.arange(len(self.vocabulary) + 1))
        self.item, self.times = held[:, 1], held[:, 2]
        self.longest = int(np.diff(edges).max(initial=0))


def bags(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms with repeats) and bag (pairs of term number and occurrences, as 32-bit numbers) of every document."""
    known = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                terms, edges = terms_of(part.column("text"))
                number = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(edges))
                both = row[number >= 0] * len(vocabulary) + number[number >= 0]
                both, times = np.unique(both, return_counts=True)
                pairs = np.stack([both % max(1, len(vocabulary)), times], axis=1).astype("<u4")
                ends = 8 * np.searchsorted(both, np.arange(part.num_rows + 1) * len(vocabulary))
                packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(edges), pa.int64()), packed.cast(pa.binary())], names=["doc_id", "n", "bag"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, bag binary")


def holders(known: DataFrame, many: int) -> np.ndarray:
    """In how many documents each of the ``many`` terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(many, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("bag").to_pylist()), "<u4")[::2], minlength=many)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df), pa.int64()), pa.array(df[df > 0])], names=["term", "df"])

    out = np.zeros(many, np.int64)
    sums = known.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term
    out[sums["term"].to_numpy()] = sums["df"].to_numpy()
    return out


class Best:
    """The ``most`` classes of each item so far, by score and smallest id."""

    def __init__(self, items: int, most: int):
        self.most, self.least, self.items = most, np.zeros(items), items
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kept: dict[int, tuple] = {}
        self.waiting = 0

    def add(self, scores: np.ndarray, first: np.ndarray, of: list[tuple], at: int) -> None:
        row, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.rows.append((item, scores[row, item], row + at))
        for r in np.unique(row).tolist():
            self.kept[r + at] = (int(first[r]), *of[r])
        self.waiting += len(row)
        if self.waiting > 20 * self.items * self.most:
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, row = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64),) * 3
        first = np.array([self.kept[r][0] for r in row.tolist()], np.int64)
        order = np.lexsort((first, -score, item))
        item, score, row = item[order], score[order], row[order]
        begins = np.searchsorted(item, np.arange(self.items + 1))
        rank = np.arange(len(item)) - begins[item]
        full = np.flatnonzero(rank == self.most - 1)
        self.least[item[full]] = score[full]
        kept = rank < self.most
        self.rows = [(item[kept], score[kept], row[kept])]
        self.kept = {r: self.kept[r] for r in np.unique(row[kept]).tolist()}
        self.waiting = int(kept.sum())
        return self.rows[0]


def scores_of(bag: list[bytes], m: np.ndarray, items: Items, weights: np.ndarray) -> np.ndarray:
    """The score of each class (row) for each item; sums of whole numbers that doubles hold exactly, or 64-bit ones."""
    sizes = np.array([len(b) // 8 for b in bag])
    term, times = np.frombuffer(b"".join(bag), "<u4").reshape(-1, 2).T.astype(np.int64)
    row = np.repeat(np.arange(len(bag)), sizes)
    gain = weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[row]))
    out = np.zeros(len(bag) * items.many, np.float64 if weights.max(initial=1) * 1_000_000 * max(1, items.longest) < 1 << 53 else np.int64)
    many = items.starts[term + 1] - items.starts[term]
    ends = np.cumsum(many)
    at = 0
    while at < len(term):  # so many (class, term, item) at once
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), side="right")))
        n = many[at:stop]
        where = np.repeat(items.starts[term[at:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(row[at:stop] * items.many, n) + items.item[where]
        value = np.repeat(gain[at:stop], n) * items.times[where]
        if out.dtype == np.float64:
            out += np.bincount(cell, value, minlength=len(out))
        else:
            np.add.at(out, cell, value)
        at = stop
    return out.reshape(len(bag), items.many)


def best_classes(classes: DataFrame, items: Items, weights: np.ndarray, best: int) -> DataFrame:
    """(item, score, first, bag, m) of each item's ``best`` classes."""
    known = classes.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = known.value
        top, at = Best(own.many, best), 0
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                bag, m = part.column("bag").to_pylist(), part.column("m").to_numpy()
                first = pc.fill_null(part.column("first"), np.iinfo(np.int64).max).to_numpy()
                top.add(scores_of(bag, m, own, weight), first, list(zip(bag, m.tolist(), part.column("first").to_pylist(), strict=True)), at)
                at += part.num_rows
        item, score, row = top.trim()
        held = [top.kept[r] for r in row.tolist()]
        columns = [pa.array(item, pa.int32()), pa.array(score.astype(np.int64)), *(pa.array([h[k] for h in held], t) for k, t in ((3, pa.int64()), (1, pa.binary()), (2, pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "first", "bag", "m"])

    found = classes.select("bag", "m", "first").mapInArrow(run, "item int, score long, first long, bag binary, m long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), "bag", "m")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best).drop("place")


def rank_group(docs: DataFrame, items: list, best: int) -> DataFrame:
    """The ranked documents of one group of items (item_id, text)."""
    group = Items([r.text for r in items])
    known = cut(bags(docs, group))
    total = known.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = holders(known, len(group.vocabulary))
    weights = np.floor(1000 * np.log((2 * total.N + 2) / (2 * df + 1))).astype(np.int64)
    m = F.expr(f"75L + (25L * n * {total.N}L) div {max(1, total.L)}L")
    known = known.where(F.length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("key", F.xxhash64("bag", "m"))
    classes = known.groupBy("key", "m", "bag").agg(F.min("doc_id").alias("first"))
    chosen = cut(best_classes(classes, group, weights, best).withColumn("key", F.xxhash64("bag", "m")))
    wanted = chosen.select("key", "m", "bag").distinct()
    size = chosen.agg(F.coalesce(F.sum(F.length("bag") + 64), F.lit(0))).first()[0]
    order = Window.partitionBy("key", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    members = known.join(F.broadcast(wanted) if size <= MOST_BROADCAST else wanted, ["key", "m", "bag"]).withColumn("member", F.row_number().over(order))
    members = members.where(F.col("member") <= best).drop("member")
    placed = chosen.drop("first").join(members, ["key", "m", "bag"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).alias("rank")
    ids = F.broadcast(docs.sparkSession.createDataFrame([(k, r.item_id) for k, r in enumerate(items)], "item int, item_id long"))  # of one group
    ranked = placed.select("item", rank, "doc_id", "score").where(F.col("rank") <= best)
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the ``best`` documents of each item with a score above 0."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    groups = max(1, -(-size // MOST_BYTES))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(groups):
        # ordered, so that a task that runs again reads the same numbers
        group = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k).orderBy("item_id", "text").collect()  # about ``MOST_BYTES``
        if group:
            out = out.unionByName(rank_group(docs, group, best))
    return out
