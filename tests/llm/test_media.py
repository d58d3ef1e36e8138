import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dialspan.llm import jpeg as J
from dialspan.llm import media as M


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=500), min_size=1, max_size=5))
def test_round_trip(raw):
    payloads = [x + bytes(-len(x) % 64) for x in raw]
    media = J.encode(payloads)
    assert [u.astype(np.uint8).tobytes() for u, *_ in J.decode(media)] == payloads
    assert media == [J.encode([p])[0] for p in payloads]


def test_sparse_blocks_and_refinement():
    rng = np.random.default_rng(3)
    for share in (0, 0.02, 0.2, 0.9, 1):
        payload = (rng.integers(0, 256, 6400) * (rng.random(6400) < share)).astype(np.uint8).tobytes()
        assert J.decode(J.encode([payload]))[0][0].astype(np.uint8).tobytes() == payload


def test_inverse_transform_by_definition():
    rng = np.random.default_rng(4)
    block = rng.integers(-40, 40, (1, 64)).astype(np.int16)
    table = np.zeros(64)
    table[J.ZIGZAG] = block[0]
    table = table.reshape(8, 8)
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    want = np.array([[sum(c(u) * c(v) / 4 * table[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)])
    assert np.abs(J.samples(block, 1) - np.clip(np.rint(want + 128), 0, 255)).max() <= 1


def test_grey_stays_grey():
    blocks = [np.zeros((4, 64), np.int16), np.zeros((1, 64), np.int16), np.zeros((1, 64), np.int16)]
    blocks[0][:, 0] = 80
    picture = J.rgb(blocks, 1)
    assert picture.shape == (16, 16, 3) and (picture == 138).all()


def test_documents(spark, docs, no_docs):
    stored = M.encode_texts(docs)
    rows = M.features(stored).toPandas()
    want = sorted((hashlib.sha256(M.payload_of(r.text)).hexdigest(), zlib.crc32(M.payload_of(r.text)[-64:]), len((r.text or "").encode())) for r in docs.collect())
    assert sorted(zip(rows.payload_sha256, rows.tail_crc32, rows.n_bytes, strict=True)) == want
    assert rows.groupby("payload_sha256").feature.nunique().max() == 1
    pixels = M.tensors(stored).collect()
    assert all(len(p.pixels) == p.height * p.width * 3 for p in pixels)
    assert M.features(M.encode_texts(no_docs)).count() == 0


def test_long_text_is_several_pictures(spark):
    df = spark.createDataFrame([(1, "ä" * 700_000)], "doc_id long, text string")
    row = M.features(M.encode_texts(df)).first()
    assert row.payload_sha256 == hashlib.sha256(M.payload_of("ä" * 700_000)).hexdigest() and row.feature.startswith("2:")
