"""The tables of archives, kept below a folder and built a set of archives at a time."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls as C
from ..sources import archives as A
from ..streaming.jobs import there
from . import jobs as Z
from . import listings as L

#: Tables that follow from others over all archives: they are worked out when tables are read.
DERIVED = ("calls", "conversations")
#: Columns of perspectives that depend on other archives.
ACROSS = ("producer", "duplicate_of")
#: Tables that are written at once.
WRITES = 6


def parts_of(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that an archive has by itself, with its calls' windows, its samples' lifecycles and its fixes' movement."""
    out = {n: t for n, t in tables.items() if n not in DERIVED}
    evidence = tables["events"].where("perspective_id IS NOT NULL").select("perspective_id", "ts")
    windows = tables["perspectives"].select("import_id", "perspective_id", "call_id", "line_id", "start", "connected", "end")
    out["windows"] = C.bound_open_windows(windows, evidence, ["perspective_id"])
    creations = tables["transients"].where("type = 'device_created'").select("import_id", F.col("next_state").alias("device"), "ts", "event_id")
    out["periodic"] = L.tag_lifecycle(tables["periodic"], creations)
    out["movement"] = Z.movement_of(tables["positions"])
    return out


def next_build(spark: SparkSession, target: str) -> str:
    """A name that sorts behind those of the builds that ended below ``target``."""
    last = spark.read.parquet(f"{target}/built").agg(F.max("build")).first()[0] if there(spark, f"{target}/built") else None
    return f"b{int(last[1:].split('-')[0]) + 1 if last else 0:09d}-{uuid.uuid4().hex}"


def build_into(spark: SparkSession, archives: DataFrame, target: str, again: bool = False) -> list[str]:
    """Builds the tables of ``archives`` (import_id, archive, content) below ``target``; the names of the tables.

    Archives whose bytes were built are left out, or with ``again`` built anew. A build adds a
    folder of its own to every table, with as many files as its rows need, however many archives they
    are of. Which archives it built is written last, and of an archive the rows of its last build count, so that
    one archive is built without the others, and a lost build leaves nothing that is read.
    Rows that a later build replaced stay on disk.
    """
    if not again and there(spark, f"{target}/built"):
        archives = A.new_imports_only(archives, spark.read.parquet(f"{target}/built"))
    build = next_build(spark, target)
    files = A.unpack(archives).withColumn("parser", A.classify_file("name"))
    tables = parts_of(Z.tables_of(files))

    def write(name: str, table: DataFrame) -> None:
        rows = table.drop(*[c for c in ACROSS if c in table.columns and name == "perspectives"])
        rows.hint("rebalance", "import_id").write.parquet(f"{target}/{name}/build={build}")  # rows of an archive in a file or few

    with ThreadPoolExecutor(WRITES) as pool:  # small tables leave room for others
        list(pool.map(write, tables, tables.values()))
    write("built", archives.select("import_id").distinct())
    return list(tables)


def read_tables(spark: SparkSession, target: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables below ``target``, with perspectives that another archive of their producer brought first marked, and the calls and conversations of all of them."""
    last = spark.read.parquet(f"{target}/built").groupBy("import_id").agg(F.max("build").alias("build"))
    tables = {n: spark.read.parquet(f"{target}/{n}").join(last, ["import_id", "build"], "left_semi").drop("build") for n in names if there(spark, f"{target}/{n}/build=*")}
    if "perspectives" in tables:
        known = tables["producers"].select("import_id", "status", "producer") if "producers" in tables else spark.createDataFrame([], "import_id string, status string, producer string")
        tables["perspectives"] = C.mark_duplicates(tables["perspectives"], known)
        tables["calls"] = C.build_calls(tables["perspectives"])
        uuids = tables["uuids"] if "uuids" in tables else spark.createDataFrame([], "uuid string, call_id string")
        tables["conversations"] = Z.conversations_of(uuids, tables["perspectives"])
    return tables
