import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialspan.llm import packing as P
from dialspan.llm.arrowtext import words_of
from dialspan.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def reference(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_ids_are_the_librarys(texts):
    texts = [*texts, "it's I'LL", "a\x1cb\u0085c\u00a0d", "<|endoftext|>x", "İ ΣΑΣ ς ﬁ ²½", "'S's don't"]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    words, codes, offsets = words_of(pa.array(texts, pa.string()))
    flat, ends = P.gathered(*P.word_ids(PATH)(words), codes)
    assert [flat[ends[a] : ends[b]].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == reference(texts)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        worth = np.concatenate([[0], rng.random(12)])
        best = [0.0]
        for room in range(1, 13):
            best.append(max([best[room - 1], *(worth[w] + best[room - w] for w in range(1, room + 1))]))
        pattern = P.knapsack(worth)
        assert pattern @ np.arange(13) <= 12 and pattern @ worth == pytest.approx(best[12])


def test_patterns_cut_the_demand():
    rng = np.random.default_rng(2)
    for n in (0, 1, 30, 5000):
        demand = np.bincount(rng.integers(1, 65, n), minlength=65)
        made = P.rounded(demand, P.column_generation(demand))
        assert (sum((p * t for p, t in made), np.zeros(65, int)) == demand).all()
        assert all(p @ np.arange(65) <= 64 for p, _ in made)
        if n > 1000:
            assert sum(t for _, t in made) <= 1.01 * (demand @ np.arange(65)) / 64 + 1


def test_every_id_once(spark, docs, no_docs):
    rows = P.pack(P.token_pieces(docs, PATH)).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {d: np.array([*i, P.END_ID], "<u4") for d, i in zip(texts, reference(list(texts.values())), strict=True)}
    for r in rows.itertuples():
        own = ids[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(own) == r.doc_tokens
    assert rows.length.sum() == sum(map(len, ids.values())) + len(ids[2])
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= P.LENGTH and (s.offset == s.length.cumsum() - s.length).all()
    assert P.pack(P.token_pieces(no_docs, PATH)).count() == 0


def test_hot_class(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "1000L AS length")
    rows = P.pack(pieces).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 4096 and len(rows) == 3000
    assert rows.sequence_id.nunique() == 750


def test_clashing_columns_and_ids(spark):
    """Rows that share an id and a start, with columns of the operator's own names: each is placed once, the same way each time."""
    rows = [(k % 3, 0, 100 + k % 40, k, f"c{k}", -1, [k]) for k in range(400)] + [(None, 0, 64, 7, None, -1, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, _rank long, _class string, sequence_id long, more array<int>")
    placed = P.pack(df.repartition(5))
    assert placed.columns == ["doc_id", "start", "length", "_rank", "_class", "more", "sequence_id", "offset"]
    got = placed.collect()
    assert sorted((r["_rank"], r["_class"] or "") for r in got) == sorted((r[3], r[4] or "") for r in rows) and all(r.sequence_id >= 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
    again = {(r["_rank"], r["_class"]): (r.sequence_id, r.offset) for r in P.pack(df.repartition(2)).collect() if r.doc_id is not None}
    assert again == {(r["_rank"], r["_class"]): (r.sequence_id, r.offset) for r in got if r.doc_id is not None}
