import random
import re

import numpy as np
from pyspark.sql import functions as F

from dialspan.llm import jaccard as J
from dialspan.llm import minhash as H
from dialspan.llm.shared import components


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for family in range(12):
        base = passage[: rng.choice([0, 60])] + [rng.choice(words) for _ in range(rng.choice([3, 40, 120, 1500]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(copy) // 40])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def brute_by_rows(texts, size, percent):
    """brute(), for rows whose ids may repeat: rows with one id are linked."""
    own = brute(list(enumerate(t for _, t in texts)), size, percent)
    label = {k: own[k][1] for k in own}
    for i in {i for i, _ in texts}:
        rows = {label[k] for k, (j, _) in enumerate(texts) if j == i and own[k][0]}
        label = {k: min(rows) if v in rows else v for k, v in label.items()}
    least = {v: min(texts[k][0] for k in label if label[k] == v) for v in label.values()}
    return sorted((i, own[k][0], least[label[k]] if own[k][0] else i) for k, (i, _) in enumerate(texts))


def test_components_by_brute_force(spark, monkeypatch):
    for seed, (block, shingles_, common, size, percent) in enumerate([(1024, 500_000, 32, 4, 85), (1024, 400, 2, 5, 80), (3, 400, 2, 4, 85)]):
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "BLOCK_SHINGLES", shingles_)
        monkeypatch.setattr(J, "COMMON", common)
        monkeypatch.setattr(J, "SMALL", 4)
        texts = corpus(seed)
        df = spark.createDataFrame(texts, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link_components(df, size, percent).collect()}
        assert got == brute(texts, size, percent)


def test_repeated_ids_by_brute_force(spark):
    texts = [(i // 3, t) for i, t in corpus(4)]
    texts += [(i, t) for i, t in texts[:5]]
    got = sorted(tuple(r) for r in J.link_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85).collect())
    assert got == brute_by_rows(texts, 4, 85)


def test_pairs_under_repeated_ids_are_linked(spark):
    """Ids that stand twice, each time with a text of its own that is linked with the other id's."""
    rows = []
    for k in range(3):
        base = [f"p{k}w{i}" for i in range(200)]
        rows += [(2 * k + 1, " ".join(base)), (2 * k + 2, " ".join([*base[:-1], "end"])), (2 * k + 1, f"alone {k} a b c d"), (2 * k + 2, f"single {k} e f g h")]
    got = J.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5} and len(got) == 12


def test_keys_meet_whatever_the_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rng = random.Random(9)
        rows = sorted({(rng.randrange(12), rng.randrange(40)) for _ in range(200)})
        got = {tuple(r) for r in J.in_cells(spark.createDataFrame(rows, "key long, node long")).collect()}
        cells = [{n for k, n in rows if k == key} for key in range(12)]
        assert got == {(min(c), n) for c in cells if len(c) > 1 for n in c}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 6, (300, J.GROUPS)).astype(np.int16)
    points[100:200] = points[:100]
    points[100:200, 0] += 1
    sizes = points.sum(axis=1).astype(np.int64)
    tree = J.RTree(points, sizes)
    i, j = tree.near(points, sizes, points, sizes, 85)
    want = {(a, b) for a in range(300) for b in range(300) if np.minimum(points[a], points[b]).sum() >= J.least_shared(sizes[a] + sizes[b], 85) and 100 * sizes[a] >= 85 * sizes[b] and 100 * sizes[b] >= 85 * sizes[a]}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_odd_rows(spark, docs, no_docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in J.link_components(docs, 4, 85).collect())
    assert [g for g in got if g[0] in (1, 2, 3, 6)] == [(1, 11, 1), (2, 11, 1), (2, 11, 1), (3, 0, 3), (6, 1, 6)]
    assert got[0] == (0, 8, None) and len(got) == 10
    assert J.link_components(no_docs, 4, 85).count() == 0


def test_long_chains(spark):
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_fingerprints(spark, docs, no_docs):
    rows = {r.doc_id: r for r in H.compare_neighbours(docs).collect()}
    assert len(H.compare_neighbours(docs).collect()) == 10
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[3].fingerprint == rows[4].fingerprint == "" and rows[3].near_next == 1.0 and len(rows[9].fingerprint) == 2 * H.BINS
    assert rows[6].near_next == 0.0 and rows[9].n_chars == docs.where("doc_id = 9").first().n_chars
    assert H.compare_neighbours(no_docs).count() == 0


def test_likeness_is_near_jaccard(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(500)]
    pairs = []
    for n in (8, 60, 400):
        for share in (0, 0.1, 0.4):
            a = [rng.choice(words) for _ in range(n)]
            b = [w if rng.random() > share / 3 else rng.choice(words) for w in a]
            pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = H.with_fingerprint(H.with_fingerprint(df, "a", "x"), "b", "y").select("a", "b", H.likeness(F.col("x"), F.col("y")).alias("s"))
    for r in df.collect():
        p, q = shingles(r.a, 5), shingles(r.b, 5)
        assert abs(r.s - len(p & q) / len(p | q)) < 0.2


def test_next_row_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 7)
    ids = random.Random(7).sample(range(10_000), 100)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.n for r in H.with_next(df, "doc_id", {"n": "text"}, ["text"]).collect()}
    ids.sort()
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
