"""Linked documents by the Jaccard similarity of their word shingles.

A document's shingles are hashed into groups; the counts are a point. The sum of the smaller
coordinates bounds how many shingles two documents can share. Points stand in R-trees, whose
nodes keep the greatest coordinates below them, so that a node bounds the overlap with all
its points; pairs that survive are verified on the 64-bit hashes of their shingles.

Counts alone tell equally long texts apart only point by point: a node of unlike texts
bounds nothing, because the allowed distance grows with the length and the spread of the
counts with its root. So a tree is never made over all texts: the candidates come from shared
rare shingles. All shingles have one order, common ones last; of two linked documents the
first shingles in it (as many as may be missing, and one: the keys) share one. No link is
lost by it, nothing is compared with all, and what a third of all documents share is a key of
those only that hold nothing rarer.

1. Shingles that many texts hold are counted in fixed memory by task. The counts only say
   what comes last in the order; results are the same with any counts.
2. Documents with equal sets are one node with a number of its own (pre-aggregated).
3. The nodes with one key are a cell, the cells with the same smallest node a group, so that a
   point is sent once per group and not once per key. A tree in each group gives the pairs
   that may be linked; what these connect in a group is a unit.
4. The sets of a unit come together once and are verified exactly, but for pairs that are
   connected already. A unit of more than ``BLOCK_SHINGLES`` is dealt into blocks, each with
   the unit's first node, too; what isn't connected with that one is then held against all
   blocks. A large group of near copies so costs its own size.
5. The components of the verified links are the result.

Null ids: the document is linked with nothing and has no component. Rows with the same id
are one document in links, whatever their texts. Null and empty texts have no shingles and
no links. Further columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import shingle_sets, slices
from .shared import components, cut

#: Coordinates of a tree's points, rows of a leaf, and rows of a group that one task compares.
GROUPS, LEAF, BLOCK = 64, 16, 2048
#: Shingles per coordinate of a stored point, whose coordinates grow with the set (powers of two).
PER_GROUP = 8
#: Counters of a task, and from which count on a shingle is common; the most common ones that are ordered by their counts.
COUNTERS, COMMON, ORDERED = 1 << 22, 32, 1 << 16
#: Bytes of a table that may be broadcast; a larger one is joined by shuffles.
MOST_BROADCAST = 16 << 20
#: Shingles of a block of sets; rows and shingles that one call of the Python side is to get.
BLOCK_SHINGLES, POINT_ROWS, CALL_SHINGLES = 200_000, 2000, 400_000
#: Bytes of text whose shingles a task holds at once: idle Python workers keep what their largest slice took.
TEXT_BYTES = 1 << 20
SMALL = 24
SET = ["n", "sum_a", "sum_b"]


def least_shared(total: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two sets of ``total`` together share at least if they are linked."""
    return -(-percent * total // (100 + percent))


def count_vectors(hashes: np.ndarray, offsets: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    group = (hashes % np.uint64(groups)).astype(np.int64)
    counts = np.bincount(rows * groups + group, minlength=(len(offsets) - 1) * groups).reshape(-1, groups)
    return counts.astype(np.int16 if counts.max(initial=0) < 1 << 15 else np.int32)


def coordinates(n: int) -> int:
    """How many coordinates the stored point of ``n`` shingles has."""
    return max(GROUPS, 1 << (-(-n // PER_GROUP) - 1).bit_length())


def stored(h: np.ndarray) -> bytes:
    """The point of a set: the width of a count (1, or 4 where one is over 255), then the counts."""
    groups = coordinates(len(h))
    point = np.bincount((h % np.uint64(groups)).astype(np.int64), minlength=groups)
    width = 1 if point.max(initial=0) < 256 else 4
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def read_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer coordinates, which divide its own."""
    return point.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table of numbers) to be broadcast if its size allows it."""
    return F.broadcast(df) if 8 * len(df.columns) * df.count() <= MOST_BROADCAST else df


def set_sums(h: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    """Two sums of every set's hashes that equal sets share."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (h, (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25))]
    return [(s[o[1:]] - s[o[:-1]]).astype(np.uint64).view(np.int64) for s in sums]


def counted(batches: Iterator[pa.RecordBatch], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the common shingles of a task's texts, in the memory of the counters and one slice."""
    counters, found = np.zeros(COUNTERS, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            h, o = shingle_sets(part.column("text"), words)
            _, one = np.unique(set_sums(h, o)[0], return_index=True)  # equal sets count once
            own = np.zeros(len(o) - 1, bool)
            own[one] = True
            h = h[np.repeat(own, np.diff(o))]
            place = (h % np.uint64(COUNTERS)).astype(np.int64)
            np.add.at(counters, place, 1)
            found = np.union1d(found, h[counters[place] >= COMMON])
            if len(found) > 4 * ORDERED:  # the memory stays fixed; what is left out is only not known as common
                many = counters[(found % np.uint64(COUNTERS)).astype(np.int64)]
                found = np.sort(found[np.argsort(-many, kind="stable")[: 2 * ORDERED]])
    return found, counters[(found % np.uint64(COUNTERS)).astype(np.int64)]


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; their places in the order of counts) of the ``ORDERED`` most common shingles, counted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, many = counted(batches, words)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many, pa.int64())], names=["h", "c"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "h").limit(ORDERED).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    place = np.empty(len(h), np.int64)
    place[np.lexsort((h, c))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], place[order]


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), two sums that equal sets share, the point, and the first hashes in the order."""
    common, place = common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                h, o = shingle_sets(part.column("text"), words)
                n = np.diff(o)
                sets = [h[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]
                first = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(first)])
                at = np.repeat(o[:-1] - ends[:-1], first) + np.arange(ends[-1])
                if len(common) and len(h):
                    near = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    last = np.where(common[near] == h, place[near], 0)
                    at = np.lexsort((last, np.repeat(np.arange(len(n)), n)))[at] if last.any() else at
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[at].view(np.int64)))
                sums = [pa.array(s) for s in set_sums(h, o)]
                points = pa.array([stored(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *sums, points, keys], names=["doc_id", *SET, "point", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, sum_a long, sum_b long, point binary, keys array<long>")


class RTree:
    """Points packed into leaves of neighbours in size and widest coordinate, and levels of nodes above."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = LEAF * max(1, int(np.sqrt(len(sizes) / LEAF)))
        order = np.argsort(sizes, kind="stable")
        wide = int(points.var(axis=0).argmax())
        self.order = np.concatenate([part[np.argsort(points[part, wide], kind="stable")] for part in (order[i : i + slab] for i in range(0, len(order), slab))])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, low_n, high_n = points[self.order], sizes[self.order], sizes[self.order]
        while len(high) > 1 or not self.levels:
            at = np.arange(0, len(high), LEAF)
            high, low_n, high_n = np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            self.levels.append((high, low_n, high_n))

    def near(self, points: np.ndarray, sizes: np.ndarray, of: np.ndarray, n_of: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs that may be linked: the bound holds for them and for every node above."""
        query, node = np.repeat(np.arange(len(of)), len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), len(of))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[level]
            fits = (100 * n_of[query] >= percent * low_n[node]) & (100 * high_n[node] >= percent * n_of[query])
            query, node = query[fits], node[fits]
            least = least_shared(n_of[query] + np.maximum(low_n[node], -(-percent * n_of[query] // 100)), percent)
            kept = bounded(of, high, query, node, least)
            query, node = query[kept], node[kept]
            below = len(self.levels[level - 1][0]) if level else len(self.order)
            query, node = np.repeat(query, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            query, node = query[node < below], node[node < below]
        node = self.order[node]
        fits = (100 * n_of[query] >= percent * sizes[node]) & (100 * sizes[node] >= percent * n_of[query])
        query, node = query[fits], node[fits]
        kept = bounded(of, points, query, node, least_shared(n_of[query] + sizes[node], percent))
        return query[kept], node[kept]


def bounded(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the coordinate minima of a[i] and b[j] sum up to ``least``, some pairs at a time."""
    out = np.empty(len(i), bool)
    step = max(1, (1 << 21) // a.shape[1])
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        out[part] = np.minimum(a[i[part]], b[j[part]]).sum(axis=1, dtype=np.int32) >= least[part]
    return out


def pairs_in_cells(cell: np.ndarray, points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell that may be linked; rows of a cell stand together. Small cells are single leaves."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    many = np.diff(np.append(starts, len(cell)))
    for m in np.unique(many[many <= SMALL]):
        rows = starts[many == m]
        for at in range(0, len(rows), 4096):
            a, b = np.triu_indices(m, 1)
            i, j = ((rows[at : at + 4096, None] + x).ravel() for x in (a, b))
            fits = (100 * sizes[i] >= percent * sizes[j]) & (100 * sizes[j] >= percent * sizes[i])
            i, j = i[fits], j[fits]
            kept = bounded(points, points, i, j, least_shared(sizes[i] + sizes[j], percent))
            yield i[kept], j[kept]
    for start, m in zip(starts[many > SMALL], many[many > SMALL], strict=True):
        own = slice(start, start + m)
        tree = RTree(points[own], sizes[own])
        for at in range(0, m, 128):
            of = slice(start + at, start + min(m, at + 128))
            i, j = tree.near(points[own], sizes[own], points[of], sizes[of], percent)
            i = i + at
            yield start + i[i < j], start + j[i < j]


def finely_bounded(points: list[np.ndarray], many: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs also fit by their stored points (of ``many`` coordinates), in the coordinates of the coarser one."""
    both, least = np.minimum(many[i], many[j]), least_shared(sizes[i] + sizes[j], percent)
    kept = np.ones(len(i), bool)
    for groups in np.unique(both[both > GROUPS]):
        at = np.flatnonzero(both == groups)
        rows, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        fine = np.stack([folded(points[r], groups) for r in rows])
        kept[at] = bounded(fine, fine, back[: len(at)], back[len(at) :], least[at])
    return kept


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each component) after the pairs i, j are linked, too."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def in_cells(rows: DataFrame) -> DataFrame:
    """(first, node) of ``rows`` (node, key): the nodes of every key that more than one has, with the smallest of them.

    Keys are sorted where they are shuffled to, so that a key is a run whose first row has its smallest node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None  # the last run's key and first node, and whether that one is already out
        for batch in batches:
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if not len(key):
                continue
            carried = last is not None and last[0] == key[0]
            begins = np.concatenate([[not carried], key[1:] != key[:-1]])
            starts = np.flatnonzero(begins)
            firsts = node[starts] if not carried else np.concatenate([[last[1]], node[starts]])
            run_of = np.cumsum(begins) - (0 if carried else 1)
            first = firsts[run_of]
            later = ~begins
            shared = np.zeros(len(firsts), bool)
            shared[run_of[later]] = True
            own = begins & shared[run_of]
            a, b = np.concatenate([first[later], first[own]]), np.concatenate([node[later], first[own]])
            if carried and not last[2]:
                a, b = np.append(a, last[1]), np.append(b, last[1])
            last = (key[-1], firsts[-1], bool(shared[-1]))
            both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["first", "node"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "first long, node long").distinct()


def candidate_units(nodes: DataFrame, percent: int) -> DataFrame:
    """(unit, node): what pairs of nodes that may be linked connect in each group. Equal units are one."""
    cells = cut(in_cells(nodes.select("node", F.explode("keys").alias("key"))))
    groups = cut(cells.groupBy("first").agg(F.count("*").alias("many")))
    total = groups.where(F.col("many") <= BLOCK).agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // POINT_ROWS))
    known = small(groups)
    rows = cells.join(known.where(F.col("many") <= BLOCK), "first").join(nodes.select("node", "n", "point"), "node")
    rows = rows.select("first", "node", "n", "point", F.pmod(F.xxhash64("first"), F.lit(buckets)).alias("bucket"))

    def run(table: pa.Table) -> pa.Table:
        cell = table["first"].to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, ids, sizes = cell[order], table["node"].to_numpy()[order], table["n"].to_numpy()[order]
        fine = [read_point(p) for p in table["point"].take(pa.array(order)).to_pylist()]
        points = np.stack([folded(p, GROUPS) for p in fine])
        points = points.astype(np.int16 if points.max(initial=0) < 1 << 15 else np.int32)
        label, coordinates_of = np.arange(len(cell)), np.array([len(p) for p in fine])
        for i, j in pairs_in_cells(cell, points, sizes, percent):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            kept = finely_bounded(fine, coordinates_of, sizes, i, j, percent)
            label = joined(label, i[kept], j[kept])
        many = np.bincount(label, minlength=len(label))[label] > 1
        return pa.table({"first": pa.array(cell[many], pa.int64()), "root": pa.array(ids[label[many]], pa.int64()), "node": pa.array(ids[many], pa.int64())})

    found = rows.groupBy("bucket").applyInArrow(run, "first long, root long, node long")
    large = cells.join(known.where(F.col("many") > BLOCK), "first").select("first", F.col("first").alias("root"), "node")
    return distinct_units(found.unionByName(large))


def distinct_units(found: DataFrame) -> DataFrame:
    """(unit, node) of what ``found`` (first, root, node) brings together, equal units once."""
    found = cut(found.select(F.xxhash64("first", "root").alias("unit"), "node"))
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(20,0)")) for k in (1, 2)]  # of as many nodes as there may be
    once = found.groupBy("unit").agg(F.count("*").alias("m"), sums[0].alias("a"), sums[1].alias("b")).groupBy("m", "a", "b").agg(F.min("unit").alias("unit"))
    return found.join(small(cut(once.select("unit"))), "unit")


def rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, pa.Table]:
    """Parts (standing together), nodes, sets, sizes and points of the rows that a verifying call gets."""
    table = table.take(pa.array(np.argsort(table["part"].to_numpy(), kind="stable")))
    sets = [np.frombuffer(x, "<u8") for x in table["set"].to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    points = np.stack([folded(read_point(stored(s)), GROUPS) for s in sets])
    points = points.astype(np.int16 if points.max(initial=0) < 1 << 15 else np.int32)
    return table["part"].to_numpy(), table["node"].to_numpy(), sets, n, points, table


def verified(sets: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, label: np.ndarray, of: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of the rows i, j that are linked; those whose labels (of[row] is a row's place there) are equal already are left out."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    for a, b in zip(starts, [*starts[1:], len(i)], strict=False):
        one, others = i[a], j[a:b]
        while len(others := others[label[of[others]] != label[of[one]]]):
            other, others = others[0], others[1:]
            at = np.minimum(np.searchsorted(sets[one], sets[other]), n[one] - 1)
            shared = int((sets[one][at] == sets[other]).sum())
            if 100 * shared >= percent * (n[one] + n[other] - shared):
                x, y = sorted((label[of[one]], label[of[other]]))
                label[label == y] = x
                yield one, other


def verified_links(docs: DataFrame, nodes: DataFrame, again: DataFrame, units: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes that connect what all links between nodes of one unit connect."""
    units = units.join(nodes.select("node", "n"), "node")
    sizes = units.groupBy("unit").agg(F.sum("n").alias("many"), F.min("node").alias("pivot"))
    sizes = cut(sizes.select("unit", "pivot", "many", F.ceil(F.col("many") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    total = sizes.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    units = cut(units.join(small(sizes.drop("many")), "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    schema = "a long, b long, unit long"

    def run(table: pa.Table) -> pa.Table:
        part, ids, sets, n, points, table = rows_of(table)
        label, at = np.arange(len(part)), np.arange(len(part))
        links = [x for i, j in pairs_in_cells(part, points, n, percent) for x in verified(sets, n, i, j, label, at, percent)]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        split = table["blocks"].to_numpy() > 1
        pivot_at = np.flatnonzero(split & (ids == table["pivot"].to_numpy()))
        whole = dict(zip(part[pivot_at].tolist(), label[pivot_at].tolist(), strict=True))
        rest = [k for k in np.flatnonzero(split) if label[k] != whole.get(part[k])]
        none = pa.nulls(len(rest), pa.int64())
        return pa.concat_tables([
            pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64()), "unit": pa.nulls(len(a), pa.int64())}),
            pa.table({"a": pa.array(ids[rest], pa.int64()), "b": none, "unit": table["unit"].take(pa.array(rest, pa.int64()))}),
        ])

    everywhere = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = units.withColumn("block", F.explode(everywhere)).withColumn("part", F.xxhash64("unit", "block"))
    sets = node_sets(docs, nodes, again, units.select("node").distinct(), words)
    found = cut(dealt(sets, rows.select("part", "unit", "node", "pivot", "blocks"), total).applyInArrow(run, schema))
    links, rest = found.where("unit is null").select("a", "b"), found.where("unit is not null").select("unit", F.col("a").alias("node"))
    if rest.limit(1).count() == 0:
        return links
    return links.unionByName(rest_links(docs, nodes, again, units, rest, words, percent))


def rest_links(docs: DataFrame, nodes: DataFrame, again: DataFrame, units: DataFrame, rest: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of the ``rest`` (unit, node), which isn't connected with its unit's first node, with all of the unit.

    Blocks of the rest are held against blocks of the unit; its other nodes are connected with each other already.
    """
    rest = units.join(rest, ["unit", "node"]).select("unit", "node", "n")
    sizes = cut(rest.groupBy("unit").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("rows")))
    rest = rest.withColumn("side", F.lit(1))
    rows = units.join(small(sizes), "unit").join(rest.select("unit", "node", "side"), ["unit", "node"], "left").withColumn("side", F.coalesce("side", F.lit(0)))
    rows = cut(rows)
    total = rows.agg(F.coalesce(F.sum(F.col("n") * (F.col("rows") + F.col("side") * F.col("blocks"))), F.lit(0))).first()[0]
    down = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumns({"_j": F.col("block"), "query": F.lit(0)})
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")).cast("int")
    across = rows.where("side = 1").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"_i": own, "query": F.lit(1)})
    parts = down.unionByName(across).select(F.xxhash64("unit", "_i", "_j").alias("part"), "node", "side", "query")

    def run(table: pa.Table) -> pa.Table:
        part, ids, sets, n, points, table = rows_of(table)
        query, side, links = table["query"].to_numpy(), table["side"].to_numpy(), []
        for cell in np.unique(part[query == 1]):
            to, of = (np.flatnonzero((part == cell) & (query == q)) for q in (0, 1))
            if not len(to):
                continue
            both = np.concatenate([to, of])
            known, place = np.unique(ids[both], return_inverse=True)
            label, at = np.arange(len(known)), np.zeros(len(part), np.int64)
            at[both] = place
            connected = at[both[side[both] == 0]]
            label[connected] = connected.min(initial=len(known))
            tree = RTree(points[to], n[to])
            for k in range(0, len(of), 128):
                i, j = tree.near(points[to], n[to], points[of[k : k + 128]], n[of[k : k + 128]], percent)
                links += verified(sets, n, of[i + k], to[j], label, at, percent)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    sets = node_sets(docs, nodes, again, rows.select("node").distinct(), words)
    return dealt(sets, parts, total).applyInArrow(run, "a long, b long")


def node_sets(docs: DataFrame, nodes: DataFrame, again: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set: ascending hashes) of the ``wanted`` nodes, from the text of each one's first document.

    ``again``: documents whose id stands in several rows, which may all hold the node's text.
    """
    one = cut(nodes.join(small(cut(wanted)), "node").select("node", "doc_id", *[F.col(c).alias(f"_{c}") for c in SET]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                h, o = shingle_sets(part.column("text"), words)
                same = np.diff(o) == part.column("_n").to_numpy()
                for name, s in zip(SET[1:], set_sums(h, o), strict=True):
                    same &= s == part.column(f"_{name}").to_numpy()  # of the texts under one id the node's own
                at = np.flatnonzero(same)
                _, once = np.unique(part.column("node").to_numpy()[at], return_index=True)
                at = at[once]
                sets = pa.array([h[o[k] : o[k + 1]].astype("<u8").tobytes() for k in at], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(at)), sets], names=["node", "set"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(small(one), "doc_id")
    sets = texts.select("text", "node", *[f"_{c}" for c in SET]).mapInArrow(run, "node long, set binary")
    if again.limit(1).count() == 0:
        return sets
    several = small(cut(one.join(again, "doc_id", "left_semi").select("node")))
    return sets.join(several, "node", "left_anti").unionByName(sets.join(several, "node", "left_semi").dropDuplicates(["node"]))


def dealt(sets: DataFrame, rows: DataFrame, total: int):  # noqa: ANN201
    """``rows`` (part, node, ...) with their sets, parts dealt into the buckets that one call gets."""
    buckets = max(1, -(-total // CALL_SHINGLES))
    return sets.join(small(cut(rows)), "node").withColumn("bucket", F.pmod(F.col("part"), F.lit(buckets))).groupBy("bucket")


def with_component(known: DataFrame, groups: DataFrame) -> DataFrame:
    """``known`` with the component of its set; sets that many rows have are joined apart, by a broadcast if their table is small."""
    many = F.col("members") > BLOCK // 8
    hot = small(cut(groups.where(many).select("component", *SET)))
    few = groups.where(~many).select("component", *SET)
    return known.join(hot, SET).unionByName(known.join(hot, SET, "left_anti").join(few, SET))


def link_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every row.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both.
    """
    return linked(docs, sketches(docs, words, percent), candidate_units, words, percent)


def linked(docs: DataFrame, sketch: DataFrame, units_of: Callable[[DataFrame, int], DataFrame], words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``sketch`` (doc_id, the columns of ``SET`` and what ``units_of`` reads).

    ``units_of`` gives the (unit, node) of all pairs of nodes that may be linked.
    """
    sketch = cut(sketch)
    known = sketch.where("n > 0 and doc_id is not null")
    more = [F.first(c).alias(c) for c in sketch.columns if c not in ("doc_id", *SET)]
    groups = known.groupBy(*SET).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"), *more)
    nodes = cut(groups.withColumn("node", F.monotonically_increasing_id()))  # numbers of the written table
    ids = known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.struct(*SET)).alias("x"), F.max(F.struct(*SET)).alias("y")).where("rows > 1")
    again = cut(ids.select("doc_id", (F.col("x") != F.col("y")).alias("differ")))
    links = cut(verified_links(docs, nodes, again, units_of(nodes, percent), words, percent))
    ends = [nodes.select(F.col("node").alias(end), F.col("doc_id").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
    edges = links.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    texts = known.join(again.where("differ"), "doc_id", "left_semi").select("doc_id", *SET).distinct()
    twins = texts.join(nodes.select(*SET, F.col("doc_id").alias("b")), SET).select(F.col("doc_id").alias("a"), "b")
    of = components(edges.unionByName(twins)).withColumnRenamed("node", "doc_id")
    placed = cut(nodes.select("doc_id", "members", *SET).join(of, "doc_id", "left").select("members", *SET, F.coalesce("component", "doc_id").alias("component")))
    linked = with_component(known.select("doc_id", *SET), placed).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = sketch.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
