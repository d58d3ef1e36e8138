"""Structured Streaming twins of batch jobs; each equals its batch job on the same complete input."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.telemetry import telemetry_canonical
from ..sources.archives import unpack
from .processors import EPISODE_SQL, EpisodeProcessor, StateProcessor

TTL_MS = 30_000
#: State lives in RocksDB: stateful processors need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def there(spark: SparkSession, pattern: str) -> bool:
    """Whether a path that fits ``pattern`` exists; what can't be looked at is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return found is not None and len(found) > 0


def stream_ingest(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Adds the members of new archives to a Parquet table, by the load that brought them.

    A batch that runs again overwrites its own load, and archives whose bytes another load brought are left out: repeats are no-ops.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.zip").load(path)
    rows = files.select(F.sha2("content", 256).alias("import_id"), F.col("path").alias("archive"), "content")
    owner = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        load = f"{owner}-{number}"
        if there(batch.sparkSession, f"{target}/load=*"):
            known = batch.sparkSession.read.option("basePath", target).parquet(f"{target}/load=*").where(F.col("load") != load)
            batch = batch.join(known.select("import_id").distinct(), "import_id", "left_anti")
        unpack(batch).write.mode("overwrite").parquet(f"{target}/load={load}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def telemetry_stream(records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first copy of each (source_id, event_id) inside the watermark."""
    return records.withWatermark("observed", delay).dropDuplicatesWithinWatermark(["source_id", "event_id"])


#: Parts of the keys of a canonical table; a batch reads the evidence of the parts that it touches.
BUCKETS = 64


def stream_canonical(records: DataFrame, target: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Merges telemetry records into canonical ones below ``target`` as they come: evidence, all copies by batch, and canonical, the keys that a batch touched by batch.

    The first body of a key by ``order`` is kept and different bodies are a conflict, as in
    ``telemetry_canonical``; ``order`` has to tell copies apart whatever batch brings them. Only
    keys that a batch touches are worked out again, from all their copies. A batch that runs again
    overwrites its own parts, so that a repeat changes nothing.
    """
    key = ["source_id", "event_id"]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{target}/evidence/batch={number}"
        batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(own)
        if not there(spark, f"{own}/bucket=*"):
            return
        new = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema.fields)}, bucket int").parquet(own)
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``BUCKETS``
        every = spark.read.schema(new.schema.add("batch", "long")).option("basePath", f"{target}/evidence").parquet(f"{target}/evidence")
        every = every.where(F.col("bucket").isin(buckets) & (F.col("batch") <= number))
        touched = every.join(new.select(*key).distinct(), key, "left_semi").drop("bucket", "batch")
        telemetry_canonical(touched, order).write.mode("overwrite").parquet(f"{target}/canonical/batch={number}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_canonical(spark: SparkSession, target: str) -> DataFrame:
    """The canonical records that ``stream_canonical`` has made: of each key the newest version."""
    rows = spark.read.option("basePath", f"{target}/canonical").parquet(f"{target}/canonical/batch=*")
    newest = Window.partitionBy("source_id", "event_id").orderBy(F.desc("batch"))
    return rows.withColumn("_v", F.row_number().over(newest)).where("_v = 1").drop("_v", "batch")


def stream_bad_windows(intervals: DataFrame, key: list[str], threshold: float, width_s: int = 60, delay: str = "1 minute") -> DataFrame:
    """Covered and bad seconds per tumbling window of (key, ts, seconds, mos); an interval is cut at the windows' edges.

    Rows later than the watermark are lost; ``delay`` has to cover the length of an interval, too.
    """
    start = F.unix_micros("ts")
    end, width = start + F.round(F.col("seconds") * 1e6).cast("long"), width_s * 1_000_000
    pieces = intervals.where("seconds > 0").select(*key, "mos", start.alias("_a"), end.alias("_b"), F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))).alias("_k"))
    low, high = F.greatest("_a", F.col("_k") * width), F.least("_b", (F.col("_k") + 1) * width)
    pieces = pieces.select(*key, "mos", F.timestamp_micros(low).alias("ts"), ((high - low) / 1e6).alias("seconds"))
    bad = F.sum(F.when(F.col("mos") < threshold, F.col("seconds")).otherwise(0.0))
    return pieces.withWatermark("ts", delay).groupBy(F.window("ts", f"{width_s} seconds"), *key).agg(F.sum("seconds").alias("covered"), bad.alias("bad")).select("window.start", "window.end", *key, "covered", "bad")


def stream_state_ttl(events: DataFrame, key: str, delay: str = "10 seconds", ttl_ms: int = TTL_MS) -> DataFrame:
    """States of a layer with their end: the next state's time, or ``ttl_ms`` after the last one, by event-time timers.

    ``events``: key, ts (timestamp), state. A state is emitted once the watermark has reached its end, and a
    key without states that wait for theirs has no state in the store.
    """
    events.sparkSession.conf.set(*STORE)
    out = f"`{key}` string, start timestamp, end timestamp, state string, ended_by string"
    rows = events.select(key, "ts", "state").withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(StateProcessor(key, ttl_ms), out, "append", "EventTime")


def stream_episodes(signals: DataFrame, key: str, delay: str = "10 seconds", ttl_ms: int = 86_400_000) -> DataFrame:
    """Episodes of (key, ts, phase, duration_ms) signals as ``reconstruct_incidents`` makes them: with start, missing, ongoing and end.

    An episode is emitted when the watermark has reached its end, and as an open one when it has reached
    another start, or ``ttl_ms`` after its last signal; then the episode is over whatever follows. A
    key without an episode has no state in the store.
    """
    signals.sparkSession.conf.set(*STORE)
    rows = signals.select(key, "ts", "phase", F.col("duration_ms").cast("double").alias("duration_ms")).withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(EpisodeProcessor(key, ttl_ms), f"`{key}` string, {EPISODE_SQL}", "append", "EventTime")


def stream_incidents(signals: DataFrame, key: str, delay: str = "10 seconds") -> DataFrame:
    """Spans from a start (key, ts, phase) to the end that follows it: closed episodes with an observed start."""
    made = stream_episodes(signals.withColumn("duration_ms", F.lit(None).cast("double")), key, delay, ttl_ms=10_000 * 86_400_000)
    at = [F.timestamp_micros(F.col(f"{c}_us")).alias(c) for c in ("start", "end")]
    return made.where("status = 'closed' AND start_basis = 'observed'").select(key, *at)
