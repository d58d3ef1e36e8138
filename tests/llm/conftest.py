import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Nulls, empty texts, ties, repeated rows, a very long text and extra columns whose names clash."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon all night long."),
        (2, "The cat sat on the mat and looked at the moon all night long."),
        (2, "The cat sat on the mat and looked at the moon all night long."),
        (3, None),
        (4, ""),
        (5, "  \n\t "),
        (6, "word"),
        (7, "é ß 日本 🦄 mail a.b@example.test"),
        (None, "an orphan without an id but with some words in it"),
        (9, " ".join(f"w{i}" for i in range(30000))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("lang", "source", "score", "rule", "ids", "sequence_id", "component")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
