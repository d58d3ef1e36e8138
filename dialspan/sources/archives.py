"""Archives and folders of logs as tables, and the sinks.

An archive is read by one task and its members are streamed out one at a time. No cap on
sizes or counts; what can't be read is a row with a warning, not an error of the job.
"""

from __future__ import annotations

import io
import stat
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import csv_safe

MEMBERS = "import_id string, archive string, name string, size long, text string, warning string"
# Beginnings of file names and the families they mean.
FAMILIES = [("sip_debug", "sip"), ("kpelog", "kpe"), ("rtplog", "rtcp"), ("callinfo", "callinfo"), ("phoneengine", "phone"), ("vdlog", "vd")]


def unsafe(name: str) -> bool:
    parts = PurePosixPath(name.replace("\\", "/"))
    return parts.is_absolute() or ".." in parts.parts or (len(name) > 1 and name[1] == ":")


def members(content: bytes) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(name, size, text, warning) of an archive's files; text is NULL where there is a warning."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield "", len(content), None, "not an archive"
        return
    seen: set[str] = set()
    for info in archive.infolist():
        if info.is_dir():
            continue
        why = "unsafe path" if unsafe(info.filename) else "duplicate name" if info.filename in seen else "encrypted" if info.flag_bits & 1 else "symbolic link" if stat.S_ISLNK(info.external_attr >> 16) else None
        seen.add(info.filename)
        raw = b""
        if why is None:
            try:
                raw = archive.read(info)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError):
                why = "unreadable"
            if b"\0" in raw[:4096]:
                why = "not text"
        text = None if why else raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
        yield info.filename, info.file_size, text, why


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of each ZIP below ``path``; an archive that is there twice is read once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return unpack(files.select(F.sha2("content", 256).alias("import_id"), F.col("path").alias("archive"), "content"))


def unpack(archives: DataFrame) -> DataFrame:
    once = archives.groupBy("import_id").agg(F.min("archive").alias("archive"))
    kept = archives.join(once, ["import_id", "archive"], "left_semi").select("import_id", "archive", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for import_id, archive, content in batch.itertuples(index=False, name=None):
                for row in members(content):
                    yield pd.DataFrame([(import_id, archive, *row)], columns=["import_id", "archive", "name", "size", "text", "warning"])

    return kept.mapInPandas(run, MEMBERS)


def read_log_dir(spark: SparkSession, path: str, import_id: str) -> DataFrame:
    """Loose text files of one device as one import."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.lit(import_id).alias("import_id"), F.lit(path).alias("archive"), name.alias("name"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"), F.lit(None).cast("string").alias("warning"))


def new_imports_only(archives: DataFrame, known: DataFrame) -> DataFrame:
    """Archives whose bytes aren't known by their hash yet."""
    return archives.join(known.select("import_id").distinct(), "import_id", "left_anti")


def base_name(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1))


def classify_file(name: Column | str) -> Column:
    base = base_name(name)
    out = F.when(base.startswith("telemetry") & base.endswith(".jsonl"), "telemetry")
    for prefix, family in FAMILIES:
        out = out.when(base.startswith(prefix), family)
    return out.otherwise("raw")


def file_family(name: Column | str) -> Column:
    """The name without its extension and the number of its rotation."""
    return F.regexp_replace(F.regexp_replace(base_name(name), r"\.(?:log|txt|jsonl)(?:\.\d+)?$", ""), r"[._-]?\d+$", "")


def read_telemetry_jsonl(files: DataFrame) -> DataFrame:
    """Every line that isn't blank, malformed ones too: import_id, name, line_no, raw and envelope fields."""
    lines = files.select("import_id", "name", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw"))
    envelope = "schema string, type string, event_id string, source_id string, session_id string, boot_id string, seq long, role string, observed_utc string, mono_ms double, validity string, invalid_reason string, payload string"
    body = F.from_json("raw", envelope, {"mode": "PERMISSIVE"})
    return lines.where(F.trim("raw") != "").select("import_id", "name", (F.col("n") + 1).alias("line_no"), "raw", body.alias("e")).select("import_id", "name", "line_no", "raw", "e.*")


def file_coverage(records: DataFrame) -> DataFrame:
    """First and last time and number of records of a file; a head without a time is a warning."""
    return records.groupBy("import_id", "name").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("records"), F.bool_or(F.col("ts").isNull()).alias("undated_head"))


def write_csv_safe(df: DataFrame, path: str) -> None:
    """CSV whose text no spreadsheet takes for a formula."""
    safe = [csv_safe(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.option("header", "true").mode("overwrite").csv(path)


def export_incidents(episodes: DataFrame, windows: DataFrame, call: str, observer: str, path: str) -> None:
    """Windows as CSV, windows and episodes as JSON, of one call and the observers like a pattern."""
    chosen = [d.where((F.col("call_key") == call) & F.col("observer").ilike(observer)) for d in (windows, episodes)]
    write_csv_safe(chosen[0], f"{path}/windows_csv")
    for name, d in zip(("windows", "episodes"), chosen, strict=True):
        d.write.mode("overwrite").json(f"{path}/{name}_json")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as Parquet, by import where they have one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("import_id") if "import_id" in df.columns else writer).parquet(f"{path}/{name}")
