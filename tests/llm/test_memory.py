import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from dialspan.llm import jaccard


def test_near_duplicates_broadcast_ids_and_leave_texts_where_they_are(spark, docs):
    rows = docs.where("doc_id <> 2").select("doc_id", "text").withColumn("text", F.concat("text", F.lit(" and one more")))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = P.near_duplicates(spark, rows, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert kept.count() == rows.where("doc_id not in (4, 5) or doc_id is null").count() + 1  # 3 has a null text, 4 and 5 equal ones
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_counting_shingles_takes_the_counters_and_one_slice():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    tracemalloc.start()
    try:
        jaccard.counted(iter([batch]), 5)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * jaccard.COUNTERS + 32 * 2**20


def test_counts_of_common_shingles():
    texts = [f"a b c d e {k}" for k in range(jaccard.COMMON + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found, many = jaccard.counted(iter([batch, batch]), 5)
    assert len(found) == 1 and many.tolist() == [2 * len(texts)]
