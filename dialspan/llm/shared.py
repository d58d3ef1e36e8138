"""What the operators of this subpackage share: input tables, written cuts of the lineage, linked components."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one of this machine only where Spark is one process and none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if folder is None and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: the executors need a folder that they share")
    return folder or _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there.

    A lost executor then costs the tasks that ran on it, not the work before the cut.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b): the smallest node that is reachable.

    Labels spread over the edges and are followed to their own labels in each round, so that
    the rounds grow with the logarithm of a component's diameter. Every round is a few
    shuffles of (node, label) rows, minima are combined before they are shuffled, and the
    round's table is cut from its lineage. Nulls and loops link nothing.
    """
    both = edges.where("a <> b").select("a", "b").distinct()
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        spread = cut(spread)
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = cut(spread.join(up, "component").select("node", F.col("next").alias("component"), (F.col("next") < F.col("old")).alias("changed")))
        labels = jumped.select("node", "component")
        if jumped.where("changed").limit(1).count() == 0:
            return labels
