"""Queries of streams that come in several batches, out of order and late; with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import telemetry as T
from ..sources.staging import new_path
from ..streaming import jobs as streams
from .analysis_queries import as_time
from .core_queries import read

#: Parts of a stream, each a batch of so many files.
PARTS, FILES = 4, 4
HOURS_12 = 12 * 3_600_000


def in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four batches, quarters of their time; an event in fifty comes one batch late, another two."""
    e = read(spark, sf_dir, "events")
    low, high = e.agg(F.min(S.micros("ts")), F.max(S.micros("ts"))).first()
    part = F.floor(PARTS * (S.micros("ts") - low) / (high - low + 1))
    late = F.when(F.col("event_id") % 50 == 0, 1).when(F.col("event_id") % 50 == 1, 2).otherwise(0)
    rows = e.withColumns({"ts": F.timestamp_micros(S.micros("ts")), "part": F.least(F.lit(PARTS - 1), part + late)})
    path = new_path(spark, "parts")
    for k in range(PARTS):  # one after the other: a stream reads files by their age
        rows.where(F.col("part") == k).drop("part").repartition(FILES).write.parquet(f"{path}/at{k}")
    return spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/at*")


def read_all(made: DataFrame) -> DataFrame:
    spark = made.sparkSession
    out = new_path(spark, "stream")
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def r4_late_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of users over several batches with late rows, up to the last watermark."""
    e = in_parts(spark, sf_dir).select(F.col("user_id").cast("string").alias("user"), "ts", F.col("event_type").alias("state"))
    out = read_all(streams.stream_state_ttl(e, "user", "10 seconds", HOURS_12))
    at = lambda c: S.from_micros(F.unix_micros(c)).alias(c)
    return out.select("user", at("start"), at("end"), "state", "ended_by")


def r5_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of users with all phases over several batches with late rows; one without a signal for twelve hours is left open."""
    kind, n = F.col("event_type"), F.col("event_id")
    phase = F.when(kind == "error", "start").when(kind == "purchase", "end").when((kind == "click") & (n % 3 == 0), "ongoing").when((kind == "view") & (n % 5 < 2), "missing")
    length = F.when((kind == "purchase") & (n % 2 == 0), F.col("value")).when((kind == "click") & (n % 4 > 0), F.col("value")).when(kind == "view", F.col("value") * 1000)
    e = in_parts(spark, sf_dir).select(F.col("user_id").cast("string").alias("user"), "ts", phase.alias("phase"), length.alias("duration_ms")).where("phase IS NOT NULL")
    out = read_all(streams.stream_episodes(e, "user", "10 seconds", HOURS_12))
    return out.withColumn("duration_ms", F.round("duration_ms", 3))


def _records(events: DataFrame) -> DataFrame:
    """Three copies a key, the third of which differs at times, in another order than they come."""
    body = F.concat(F.lit("b"), F.when(F.col("event_id") % 30 == 29, F.lit(1)).otherwise(0))
    return events.select(F.lit("s").alias("source_id"), F.concat(F.lit("e"), F.floor(F.col("event_id") / 3)).alias("event_id"), (F.col("event_id") * 7919 % 1000003).alias("line"), body.alias("raw"))


def r2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records merged batch by batch."""
    target = new_path(spark, "canonical")
    streams.stream_canonical(_records(in_parts(spark, sf_dir)), target, new_path(spark, "state"), ["line"]).awaitTermination()
    return streams.read_canonical(spark, target).select("event_id", "line", "raw", "copies", "conflict")


def r2_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.telemetry_canonical(_records(read(spark, sf_dir, "events")), ["line"]).select("event_id", "line", "raw", "copies", "conflict")


#: Rows that a batch doesn't drop: it drops what the watermark of the batch before it has passed, ten seconds behind all that came before that one.
KEPT = """q AS (SELECT e.*, epoch_us(ts) AS t, least(3, (4 * (epoch_us(ts) - al.a)) // (al.z - al.a + 1) + CASE event_id % 50 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS part FROM events e, (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM events) al{only}),
mx AS (SELECT part, max(t) AS m FROM q GROUP BY part), wm AS (SELECT p.part, (SELECT max(m) // 1000 * 1000 - 10000000 FROM mx WHERE mx.part < p.part - 1) AS w FROM mx p),
fin AS (SELECT max(m) // 1000 * 1000 - 10000000 AS w FROM mx), k AS (SELECT q.* FROM q JOIN wm USING (part) WHERE wm.w IS NULL OR q.t > wm.w)"""
PHASE = """CASE WHEN event_type = 'error' THEN 'start' WHEN event_type = 'purchase' THEN 'end' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'ongoing' WHEN event_type = 'view' AND event_id % 5 < 2 THEN 'missing' END"""
CANONICAL = """SELECT 'e' || event_id // 3 AS event_id, min(event_id * 7919 % 1000003) AS line, 'b' || arg_min(CASE WHEN event_id % 30 = 29 THEN 1 ELSE 0 END, event_id * 7919 % 1000003) AS raw, count(*) AS copies, count(DISTINCT event_id % 30 = 29) > 1 AS conflict FROM events GROUP BY event_id // 3"""

ORACLE: dict[str, str] = {
    "r4_late_states": f"""WITH {KEPT.format(only="")}, d AS (SELECT DISTINCT user_id, t, event_type FROM k),
        n AS (SELECT *, least(t + {HOURS_12 * 1000}, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_type), t + {HOURS_12 * 1000})) AS z FROM d)
        SELECT CAST(user_id AS VARCHAR) AS "user", {as_time("t")} AS start, {as_time("z")} AS "end", event_type AS state, CASE WHEN z = t + {HOURS_12 * 1000} THEN 'expiry' ELSE 'next' END AS ended_by FROM n, fin WHERE z <= fin.w""",
    "r5_phases": f"""WITH {KEPT.format(only=f" WHERE {PHASE} IS NOT NULL")},
        s AS (SELECT DISTINCT user_id AS u, t, {PHASE} AS phase, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN value WHEN event_type = 'click' AND event_id % 4 > 0 THEN value WHEN event_type = 'view' THEN value * 1000 END AS d FROM k),
        o AS (SELECT s.*, lag(phase) OVER w AS pp, lag(t) OVER w AS pt FROM s, fin WHERE t <= fin.w WINDOW w AS (PARTITION BY u ORDER BY t, phase = 'end', d NULLS FIRST)),
        n AS (SELECT *, pp IS NULL OR phase = 'start' OR pp = 'end' OR t - pt > {HOURS_12 * 1000} AS new, t - CAST(floor(coalesce(d, 0) * 1000 + 0.5) AS BIGINT) AS back FROM o),
        e AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY t, phase = 'end', d NULLS FIRST) AS e, CASE WHEN phase = 'missing' THEN back WHEN new AND phase = 'start' THEN t WHEN new THEN back END AS began FROM n),
        r AS (SELECT *, min(began) OVER w AS rs, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY u, e ORDER BY t, phase = 'end', d NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        l AS (SELECT *, CASE WHEN phase = 'missing' THEN CASE WHEN new THEN d ELSE (t - rs) / 1000 END WHEN phase = 'ongoing' THEN d END AS len, CASE WHEN (new AND phase = 'missing') OR (phase = 'ongoing' AND d IS NOT NULL) THEN 'minimum' END AS bas,
              CASE phase WHEN 'start' THEN 'observed' WHEN 'missing' THEN 'threshold' WHEN 'ongoing' THEN 'reported_elapsed' ELSE CASE WHEN d IS NULL THEN 'unknown' ELSE 'reported_duration' END END AS fi FROM r),
        g AS (SELECT u, e, min(rs) AS a, max(t) FILTER (WHERE phase = 'end') AS b, max(t) AS z, arg_max(len, i) FILTER (WHERE len IS NOT NULL) AS len, arg_max(bas, i) FILTER (WHERE bas IS NOT NULL) AS bas, arg_min(fi, i) AS fi, max(d) FILTER (WHERE phase = 'end') AS rep, count(*) AS n FROM l GROUP BY u, e),
        x AS (SELECT *, lead(e) OVER (PARTITION BY u ORDER BY e) AS ne FROM g)
        SELECT CAST(u AS VARCHAR) AS "user", a AS start_us, b AS end_us, z AS last_us, round(CASE WHEN b IS NULL THEN len WHEN rep IS NOT NULL THEN rep WHEN fi IN ('threshold', 'observed') THEN greatest((b - a) / 1000, 0) END, 3) AS duration_ms,
        CASE WHEN b IS NULL THEN coalesce(bas, 'unknown') WHEN rep IS NOT NULL THEN 'reported' WHEN fi = 'threshold' THEN 'minimum' WHEN fi = 'observed' THEN 'timestamps' ELSE 'unknown' END AS duration_basis, fi AS start_basis, CASE WHEN b IS NULL THEN 'open' ELSE 'closed' END AS status, n AS signals
        FROM x, fin WHERE b IS NOT NULL OR ne IS NOT NULL OR z + {HOURS_12 * 1000} < fin.w""",
    "r2_merged": CANONICAL,
    "r2_batch": CANONICAL,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE}
