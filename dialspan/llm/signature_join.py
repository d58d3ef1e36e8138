"""Near duplicates by an inverted join of MinHash signatures.

A document's signature is the least hash of its shingles under each of ``COORDINATES``
permutations. Two documents whose sets have the similarity J agree in a coordinate with
probability J, so pairs at 0.8 agree in ``LEAST`` of 64 coordinates but for about one in 10^8 of
them; fewer than one random pair in 10^14 at a similarity of 0.1 does.

1. Documents with equal sets are one node (pre-aggregated).
2. A node is posted under its coordinate-value pairs. All pairs have one order: those whose
   list has at most ``HOT`` nodes first, by coordinate, the long lists last. Two nodes that agree
   in ``LEAST`` coordinates share one of the first ``COORDINATES - LEAST + 1`` (the prefix), so
   only these are merged, and the long lists of most nodes are skipped: their coordinates are
   still counted below. Where fewer short lists than the prefix are left, the nodes that can
   only meet in long lists are posted under neighbouring coordinates that both have a long list,
   two values at a time, instead of in the long lists; a pair at 0.8 meets in none of the 32
   with a probability of 10^-14.
3. Nodes of the lists that have the same smallest node meet once, with a byte a coordinate.
   Their collisions are counted over the whole signature, and pairs with ``LEAST`` and fitting
   sizes are retained. What these connect in a list is a unit.
4. Lists of more than ``BLOCK`` nodes are counted against their smallest node first; only what
   doesn't agree with it is counted against the whole list, in blocks.
5. The retained pairs are confirmed on the full sets (see ``jaccard``), whose verified links
   make the components. A large group of near copies costs its own size.

Null ids: the document is linked with nothing, has no component and is kept. Rows with the same
id are one document in links, whatever their texts. Null and empty texts have no shingles and no
links. Further columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mixed, shingle_sets, slices
from .jaccard import SET, distinct_units, in_cells, joined, linked, set_sums, small
from .shared import cut

COORDINATES, LEAST = 64, 32
PREFIX = COORDINATES - LEAST + 1
#: Nodes of a list from which on it is long, of a block of a larger group, and rows that one call is to get.
HOT, BLOCK, CALL_ROWS = 512, 2048, 4000
SMALL, CHUNK = 24, 128
SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A row of ``COORDINATES`` least hashes for each set (none of them empty)."""
    out = np.empty((len(o) - 1, COORDINATES), np.uint64)
    for c, seed in enumerate(SEEDS):
        x = (h ^ seed) * (seed | np.uint64(1))
        x ^= x >> np.uint64(32)
        out[:, c] = np.minimum.reduceat(x * np.uint64(0xFF51AFD7ED558CCD), o[:-1])
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), two sums that equal sets share, a byte a coordinate, and the numbers of the coordinate-value pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, o = shingle_sets(part.column("text"), words)
                n = np.diff(o)
                some = n > 0
                values = signatures(h, np.append(o[:-1][some], len(h))) if some.any() else np.zeros((0, COORDINATES), np.uint64)
                raw = np.full(len(n), None, object)
                raw[some] = [row.tobytes() for row in (mixed(values) & np.uint64(255)).astype(np.uint8)]
                ends = np.concatenate([[0], np.cumsum(np.where(some, COORDINATES, 0))])
                items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mixed(values ^ SEEDS).ravel().view(np.int64)))
                sums = [pa.array(s) for s in set_sums(h, o)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *sums, pa.array(raw, pa.binary()), items], names=["doc_id", *SET, "signature", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, sum_a long, sum_b long, signature binary, items array<long>")


def postings(nodes: DataFrame) -> DataFrame:
    """(node, key): a node's prefix of short lists, and the pairs of long lists where these are too few."""
    each = nodes.select("node", F.posexplode("items").alias("at", "item"))
    long = cut(each.groupBy("item").agg(F.count("*").alias("many")).where(F.col("many") > HOT).select("item"))
    marks = each.join(small(long), "item").groupBy("node").agg(F.expr("bit_or(shiftleft(1L, at))").alias("long"))
    marked = nodes.select("node", "items").join(marks, "node", "left").withColumn("long", F.coalesce("long", F.lit(0).cast("long")))
    short = F.expr("filter(items, (x, i) -> (shiftrightunsigned(long, i) & 1) = 0)")
    both = F.expr(f"filter(sequence(0, {COORDINATES - 2}, 2), i -> (shiftrightunsigned(long, i) & 3) = 3)")
    pairs = F.when(F.size(short) < PREFIX, F.transform(both, lambda i: F.xxhash64(F.get("items", i), F.get("items", i + 1)))).otherwise(F.array().cast("array<long>"))
    return marked.select("node", F.explode(F.concat(F.slice(short, 1, PREFIX), pairs)).alias("key"))


def fitting(n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    return (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])


def retained(cell: np.ndarray, signature: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell that agree in ``LEAST`` coordinates and whose sizes fit; rows of a cell stand together, by size."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    many = np.diff(np.append(starts, len(cell)))
    for m in np.unique(many[(many > 1) & (many <= SMALL)]):
        rows = starts[many == m]
        a, b = np.triu_indices(m, 1)
        for at in range(0, len(rows), 1024):
            i, j = ((rows[at : at + 1024, None] + x).ravel() for x in (a, b))
            fits = fitting(n, i, j, percent)
            i, j = i[fits], j[fits]
            kept = (signature[i] == signature[j]).sum(axis=1) >= LEAST
            yield i[kept], j[kept]
    for start, m in zip(starts[many > SMALL], many[many > SMALL], strict=True):
        sizes = n[start : start + m]
        for at in range(0, m, CHUNK):
            of = slice(start + at, start + min(m, at + CHUNK))
            stop = start + int(np.searchsorted(100 * sizes, 100 * 100 * n[of.stop - 1] // percent, side="right"))
            i, j = np.nonzero((signature[of, None, :] == signature[None, of.start : stop, :]).sum(axis=2, dtype=np.uint8) >= LEAST)
            i, j = i[i < j] + of.start, j[i < j] + of.start
            fits = fitting(n, i, j, percent)
            yield i[fits], j[fits]


def count_collisions(table: pa.Table, percent: int) -> pa.Table:
    """(first, root, node) of what the retained pairs of each cell connect."""
    cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
    order = np.lexsort((n, cell))
    cell, n, ids = cell[order], n[order], table["node"].to_numpy()[order]
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(-1, COORDINATES)[order]
    label = np.arange(len(cell))
    for i, j in retained(cell, signature, n, percent):
        label = joined(label, i, j)
    some = np.bincount(label, minlength=len(label))[label] > 1
    return pa.table({"first": pa.array(cell[some], pa.int64()), "root": pa.array(ids[label[some]], pa.int64()), "node": pa.array(ids[some], pa.int64())})


def agrees(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with whether a node and the first one of its group (first_n, first_signature) are a retained pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("signature", "first_signature"))
            n = np.concatenate([batch.column("n").to_numpy(), batch.column("first_n").to_numpy()])
            at = np.arange(batch.num_rows)
            near = ((one == two).sum(axis=1) >= LEAST) & fitting(n, at, at + batch.num_rows, percent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near)], names=["first", "node", "n", "signature", "near"])

    return rows.select("first", "node", "n", "signature", "first_n", "first_signature").mapInArrow(run, "first long, node long, n long, signature binary, near boolean")


def candidate_units(nodes: DataFrame, percent: int) -> DataFrame:
    """(unit, node): what pairs that agree in ``LEAST`` coordinates connect in each group of lists."""
    cells = cut(in_cells(postings(nodes)))
    groups = cut(cells.groupBy("first").agg(F.count("*").alias("many")))
    held = nodes.select("node", "n", "signature")
    few = cells.join(small(groups.where(F.col("many") <= BLOCK).select("first")), "first").join(held, "node").withColumn("cell", F.col("first"))
    rows, total = few, groups.where(F.col("many") <= BLOCK).agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    large, family = groups.where(F.col("many") > BLOCK), None
    if large.limit(1).count():
        first = nodes.select(F.col("node").alias("first"), F.col("n").alias("first_n"), F.col("signature").alias("first_signature"))
        seen = cells.join(small(large.select("first")), "first").join(held, "node").join(first, "first")
        seen = cut(agrees(seen, percent))
        family = seen.where("near").select("first", F.col("first").alias("root"), "node")
        size = seen.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.sum((~F.col("near")).cast("int")) / BLOCK).cast("int").alias("rest_blocks"))
        dealt = seen.join(small(cut(size)), "first").where("rest_blocks > 0").withColumn("number", F.xxhash64("node"))
        down = dealt.withColumns({"i": F.explode(F.expr("sequence(0, rest_blocks - 1)")), "j": F.pmod("number", "all_blocks").cast("int")})
        across = dealt.where("not near").withColumns({"j": F.explode(F.expr("sequence(0, all_blocks - 1)")), "i": F.pmod("number", "rest_blocks").cast("int")})
        blocks = down.unionByName(across).select(F.xxhash64("first", "i", "j").alias("cell"), "node", "n", "signature").distinct()
        total += blocks.count()
        rows = rows.select("cell", "node", "n", "signature").unionByName(blocks)
    dealt = rows.select("cell", "node", "n", "signature").withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-total // CALL_ROWS)))))
    found = dealt.groupBy("bucket").applyInArrow(lambda table: count_collisions(table, percent), "first long, root long, node long")
    return distinct_units(found if family is None else found.unionByName(family))


def near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) and kept (it is that id) of every row.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both;
    ``LEAST`` is made for 80 and more.
    """
    found = linked(docs, sketches(docs, words), candidate_units, words, percent)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
