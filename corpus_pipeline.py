"""Training-data pipeline: quality, near duplicates, personal data, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. What
it returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialspan.llm import jaccard, knn_quality, packing, pii
from dialspan.llm.queries import PII_KEY, tokenizer_path
from dialspan.llm.shared import cut, table

WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose nearest labelled neighbours vote for quality."""
    scored = knn_quality.score(docs, knn_quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= knn_quality.THRESHOLD).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without an id stay.

    Of rows that repeat an id and its text one stays. Different texts under one id count as one
    document: all stay, or all go if one of them is linked to a smaller id.
    """
    linked = cut(jaccard.link_components(docs, WORDS, PERCENT))
    gone = cut(linked.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(jaccard.small(gone), "doc_id", "left_anti")
    again = cut(linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.limit(1).count() == 0:
        return kept
    once = kept.join(jaccard.small(again), "doc_id", "left_anti")
    return once.unionByName(kept.join(jaccard.small(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    done = pii.anonymise(docs, PII_KEY).drop("n_replaced")
    return done.withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", sequences),
]
#: SQL can't express the classifier; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
