import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from dialspan.llm import bm_ranks as B
from dialspan.llm import signature_join as S

from .test_similarity import brute, brute_by_rows, corpus


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, best=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    many, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 75 + (25 * sum(c.values()) * many) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


def some(seed):
    rng = random.Random(seed)
    words = ["Äpfel", "über", "a1", "b", "C3", "日本", "été", "x_y", "don't", *[f"w{k}" for k in range(40)]]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 60])))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(70)] + [(2000 + k, "b " + docs[7][1]) for k in range(30)]
    docs += [(None, docs[5][1]), (5, docs[5][1]), (3000, None), (3001, ""), (3002, "., \x00\x7f"), (3003, " ".join(f"w{k % 50}" for k in range(60000)))]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 30])))) for k in range(12)]
    return docs, [*items, (50, None), (51, "nowhere at all"), (52, "w1 w1 w1 B b")]


def test_ranks_by_brute_force(spark, monkeypatch):
    for seed, (most, block) in enumerate([(1 << 20, 1024), (200, 7)]):
        monkeypatch.setattr(B, "MOST_BYTES", most)  # several groups of items
        monkeypatch.setattr(B, "BLOCK", block)
        docs, items = some(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).withColumns({c: F.lit("x") for c in ("score", "rank", "item_id", "bag", "m", "key", "n", "item")})
        got = sorted((tuple(r) for r in B.ranked(df, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("z"))).collect()), key=str)
        assert got == brute_ranks(docs, items)


def test_ranks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert B.ranked(docs, items.limit(0)).count() == B.ranked(docs.limit(0), items).count() == 0
    # a term that all documents hold has the weight floor(1000 * ln(4 / 3))
    assert [tuple(r) for r in B.ranked(docs, items).collect()] == [(1, 1, 1, 287 * (1000000000 // 2200))]


def test_whole_numbers_beyond_doubles(spark):
    text = " ".join(["a"] * 400_000)
    docs = [(1, "a a a b"), (2, "b"), (3, text), *[(k, "c") for k in range(4, 40)]]
    got = B.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, text + " b")], "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(docs, [(7, text + " b")])


def test_signature_join_by_brute_force(spark, monkeypatch):
    for seed, (hot, block, rows) in enumerate([(512, 2048, 4000), (2, 2048, 50), (2, 3, 50)]):
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "CALL_ROWS", rows)
        monkeypatch.setattr(S, "SMALL", 4)
        texts = corpus(seed)
        df = spark.createDataFrame(texts, "doc_id long, text string")
        got = S.near_duplicates(df, 2, 80).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 2, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_signature_join_of_a_family_and_repeated_ids(spark, monkeypatch):
    """Near copies in a chain, so that far ones aren't linked themselves, and a common word pair in all."""
    monkeypatch.setattr(S, "HOT", 8)
    monkeypatch.setattr(S, "BLOCK", 16)
    base, texts = [f"f{k}" for k in range(120)], []
    for k in range(60):
        base[(7 * k) % 120] = f"g{k}"
        texts.append((k // 2, "the same " + " ".join(base)))
    texts += [(100 + k, f"the same and {k} alone") for k in range(40)]
    got = sorted(tuple(r)[:3] for r in S.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2, 80).collect())
    assert got == brute_by_rows(texts, 2, 80)


def test_signature_join_defined_cases(spark, docs, no_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(docs, 2, 80).collect()}
    assert {(1, 13, 1, True), (2, 13, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True)} <= got
    assert [(r[2], r[3]) for r in got if r[0] is None] == [(None, True)]
    assert S.near_duplicates(no_docs, 2, 80).count() == 0
