"""Queries of whole builds: archives rendered from the events, built into tables, built again; with DuckDB SQL for the same rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network as K
from ..sources.staging import new_path
from . import build as B
from .analysis_queries import BASE_US, squeezed
from .core_queries import read


def packed(batch: pd.DataFrame) -> pd.DataFrame:
    """The lines of a user as the engine's log and the log of reports in one archive."""
    out = io.BytesIO()
    batch = batch.sort_values("line_no", kind="stable")
    with zipfile.ZipFile(out, "w") as z:
        for name in ("kpelog.txt", "rtplog.txt"):
            z.writestr(zipfile.ZipInfo(name), "\n".join(batch["text"][batch["name"] == name]))
    return pd.DataFrame([(f"u{batch['user_id'].iloc[0]}.zip", out.getvalue())], columns=["archive", "content"])


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive a user: views add a call to the user's line, purchases end it, clicks report a loss."""
    e = read(spark, sf_dir, "events").where("event_type IN ('view', 'purchase', 'click')")
    stamp, line = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("user_id") + 1
    said = F.when(F.col("event_type") == "view", F.format_string("[%s] [CORE] [INFO] line %d added to the call list", stamp, line)).when(F.col("event_type") == "purchase", F.format_string("[%s] [CORE] [INFO] line %d call terminated", stamp, line))
    loss = F.format_string("[%s] [LINE %d FLOW 0] [INFO] RTCP ARRIVED\nSSRC of this source: 7\nPacket loss we perceive from this source (since last report): %d%%", stamp, line, F.col("event_id") % 100)
    rows = e.select("user_id", F.when(F.col("event_type") == "click", "rtplog.txt").otherwise("kpelog.txt").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("line_no"), F.coalesce(said, loss).alias("text"))
    made = rows.groupBy("user_id").applyInPandas(packed, "archive string, content binary")
    return made.select(F.sha2("content", 256).alias("import_id"), "archive", "content")


def z1_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their window, status and the losses that belong to them, after two thirds of the archives were built, then the rest, with half of those again."""
    target, path = new_path(spark, "tables"), new_path(spark, "archives")
    archives(spark, sf_dir).write.parquet(path)
    every = spark.read.parquet(path)
    part = F.crc32("archive") % 3
    B.build_into(spark, every.where(part > 0), target)
    names = B.build_into(spark, every.where(part < 2), target, again=True)
    tables = B.read_tables(spark, target, names)
    losses = tables["metrics"].where("metric = 'rtcp.loss' AND perspective_id IS NOT NULL").groupBy("perspective_id").agg(F.count("*").alias("losses"), F.sum("value").cast("long").alias("total"))
    calls = tables["perspectives"].join(losses, "perspective_id", "left").join(tables["windows"].select("perspective_id", "end_basis"), "perspective_id")
    return calls.select("line_id", "start", "end", "status", F.coalesce("losses", F.lit(0)).alias("losses"), F.coalesce("total", F.lit(0)).alias("total"), "end_basis")


def w6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of which most repeat the elapsed text of the one before, for long and at changing places."""
    q = squeezed(spark, sf_dir, 5000)
    fixes = q.select(F.col("user_id").cast("string").alias("import_id"), "t_us", F.lit(True).alias("ok"), (45 + F.floor(F.col("event_id") % 8 / 3) / 10000).alias("latitude"), F.lit(9.0).alias("longitude"), F.lit(5.0).alias("accuracy"), F.format_string("+%ds", F.floor((F.col("t_us") - BASE_US) / 300_000_000)).alias("elapsed"), F.floor((F.col("t_us") - BASE_US) / 300_000_000).cast("double").alias("elapsed_s"))
    return K.movement_sequences(fixes).select("import_id", "t_us", "part", "ordinal", "reason")


ORACLE: dict[str, str] = {
    "z1_build": """WITH g AS (SELECT user_id AS u, ts, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS leg FROM events WHERE event_type IN ('view', 'purchase')),
        l AS (SELECT u, leg, min(ts) AS a, max(ts) FILTER (WHERE event_type = 'purchase') AS b FROM g WHERE leg > 0 GROUP BY u, leg),
        c AS (SELECT u, leg, a, coalesce(b, lead(a) OVER (PARTITION BY u ORDER BY leg)) AS b FROM l),
        m AS (SELECT e.event_id, any_value(c.leg) AS leg, any_value(c.u) AS u, any_value(e.event_id % 100) AS loss FROM events e JOIN c ON c.u = e.user_id AND e.ts >= c.a AND (c.b IS NULL OR e.ts <= c.b + INTERVAL 250 MILLISECOND) WHERE e.event_type = 'click' GROUP BY e.event_id HAVING count(*) = 1),
        o AS (SELECT any_value(c.leg) AS leg, any_value(c.u) AS u FROM events e JOIN c ON c.u = e.user_id AND e.ts >= c.a AND (c.b IS NULL OR e.ts <= c.b + INTERVAL 250 MILLISECOND) WHERE e.event_type IN ('view', 'purchase', 'click') GROUP BY e.event_id HAVING count(*) = 1)
        SELECT CAST(c.u + 1 AS INTEGER) AS line_id, c.a AS start, c.b AS "end", 'partial' AS status, count(m.event_id) AS losses, CAST(coalesce(sum(m.loss), 0) AS BIGINT) AS total, CASE WHEN c.b IS NOT NULL THEN 'observed_termination' WHEN EXISTS (SELECT 1 FROM o WHERE o.u = c.u AND o.leg = c.leg) THEN 'last_call_evidence' END AS end_basis
        FROM c LEFT JOIN m ON m.u = c.u AND m.leg = c.leg GROUP BY ALL""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"z1_build": z1_build, "w6_repeats": w6_repeats}
