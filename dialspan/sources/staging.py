"""Tables written between the parts of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-staged-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where Spark runs in one process and none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.conf.get("spark.master", "") != "local" and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: the executors need a folder that they share")
    return folder or _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "staged", by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there, and what uses it twice doesn't work it out twice.

    ``by`` names a column of few values that the table is laid out by: who asks for some of them reads no
    others. Rows of a value stand in few files, those of a frequent one in several.
    """
    path = new_path(df.sparkSession, name)
    if by is None:
        df.write.parquet(path)
    else:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
