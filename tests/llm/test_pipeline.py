from pyspark.sql import functions as F

import corpus_pipeline as P
from dialspan.llm import pii
from dialspan.llm.queries import PII_KEY


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = P.quality(spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = labels.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0)))).collect()
    shares = dict(map(tuple, judged))
    assert kept.columns == columns and shares[1] > 0.98 and shares.get(0, 0) < 0.1
    once = P.near_duplicates(spark, kept, sf_dir)
    assert sorted(once.columns) == sorted(columns) and 0 < once.count() < kept.count()
    assert once.join(kept, "doc_id", "left_anti").count() == 0
    clean = P.personal_data(spark, once.select(*columns), sf_dir)
    rows = {r.doc_id: r for r in clean.collect()}
    assert sorted(clean.columns) == sorted(columns) and len(rows) == once.count()
    for r in once.collect():
        found = {m[3] for m in pii.mentions(r.text)}
        assert not found & {m[3] for m in pii.mentions(rows[r.doc_id].text)} and (found or rows[r.doc_id].text == r.text)
        assert rows[r.doc_id].n_chars == len(rows[r.doc_id].text)
    packed = P.sequences(spark, clean, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows)
    assert PII_KEY and [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]


def test_odd_rows(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = P.near_duplicates(spark, rows, "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9]
    assert P.near_duplicates(spark, rows.limit(0), "").count() == 0
