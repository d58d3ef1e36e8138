"""One table of scored intervals of logs and of telemetry: who receives, as whom, and by which clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import metric_context, series_key
from ..operators.intervals import clip
from .reports import seconds

# The clocks of intervals, and the kinds of samples that they come from.
LOG_CLOCK, TELEMETRY_CLOCK = "log_unspecified", "UTC"
LOG_SAMPLE, TELEMETRY_SAMPLE = "step", "interval"
# The metric whose direction a scored interval has, and the ways of telemetry as directions.
SCORED = "derived.mos_reference"
WAYS = {"local_receive": "incoming", "local_send": "outgoing"}
#: What makes a series.
SERIES = ["perspective_id", "direction", "flow", "ssrc", "time_basis", "sample_kind"]


def of_telemetry(intervals: DataFrame, owners: DataFrame, domain: list[str]) -> DataFrame:
    """Telemetry's intervals on the wall clock (domain, stream_id, direction, start, end, loss, mos) as those of perspectives.

    ``owners`` (domain, perspective_id, role): whose a domain is; a domain that several perspectives own
    is nobody's, and its intervals, as those of domains without an owner, are left out.
    """
    own = owners.groupBy(*domain).agg(F.min("perspective_id").alias("perspective_id"), F.max("perspective_id").alias("_other"), F.min("role").alias("role"), F.max("role").alias("_role"))
    own = own.where("perspective_id = _other").withColumn("role", F.when(F.col("role") == F.col("_role"), F.col("role"))).drop("_other", "_role")
    way = F.col("direction")
    for name, direction in WAYS.items():
        way = F.when(F.col("direction") == name, direction).otherwise(way)
    return intervals.join(own, domain).select("perspective_id", way.alias("direction"), F.lit("").alias("flow"), F.col("stream_id").alias("ssrc"), "role", "start", "end", "loss", "mos")


def scored_table(logs: DataFrame, telemetry: DataFrame, observations: DataFrame, start: Column | None = None, end: Column | None = None) -> dict[str, DataFrame]:
    """Intervals of both sources with receiver, role and clock; summaries of their series and receivers' ranks are made of them.

    ``logs`` and ``telemetry``: perspective_id, direction, flow, ssrc, start, end, loss, mos; telemetry with
    ``role``, too, which may be NULL. ``observations``: perspective_id, receiver and receiver_basis of the local
    side and declared_role (NULL where none is). Rows of other perspectives are left out, and intervals
    are clipped to [start, end).

    A role is declared, else telemetry's, else an app's; ``role_basis`` says which. What is received there is
    received by the local side, and what is sent by an unknown peer of it. Intervals of unlike clocks
    are never one series. Series that have overlapping intervals have no time that they cover:
    they are ``refused`` as a whole, and ``intervals`` has the others.
    """
    both = logs.withColumns({"time_basis": F.lit(LOG_CLOCK), "sample_kind": F.lit(LOG_SAMPLE), "role": F.lit(None).cast("string")}).select(*SERIES, "role", "start", "end", "loss", "mos")
    both = both.unionByName(telemetry.withColumns({"time_basis": F.lit(TELEMETRY_CLOCK), "sample_kind": F.lit(TELEMETRY_SAMPLE)}).select(*both.columns))
    if start is not None and end is not None:
        both = clip(both, start, end)
    rows = both.where("start < end").join(observations.select("perspective_id", "receiver", "receiver_basis", "declared_role"), "perspective_id")
    role = F.coalesce("declared_role", "role", F.lit("app"))
    rows = rows.withColumns({
        "role_basis": F.when(F.col("declared_role").isNotNull(), "confirmed").when(F.col("role").isNotNull(), "telemetry").otherwise("app_assumed"),
        "app_direction": metric_context(F.lit(SCORED), "direction", role)["category"],
        "role": role,
    })
    local = F.coalesce(F.col("direction") == "incoming", F.lit(False))
    rows = rows.withColumns({
        "receiver": F.when(local, F.col("receiver")).otherwise(F.concat(F.lit("peer-of:"), "receiver")),
        "receiver_basis": F.when(local, F.col("receiver_basis")).otherwise("remote_unidentified"),
        "series": series_key(*SERIES),
        "seconds": seconds(),
    }).drop("declared_role")
    by = Window.partitionBy("series")
    reach = F.max("end").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_over", F.coalesce(reach > F.col("start"), F.lit(False))).withColumn("_over", F.max("_over").over(by))
    return {"intervals": rows.where("NOT _over").drop("_over"), "refused": rows.where("_over").drop("_over")}


def receiver_table(intervals: DataFrame, observations: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Receivers, apart by what names them and by clock: calls (``observations`` has call_key), covered and bad seconds, and their share."""
    rows = intervals.join(observations.select("perspective_id", "call_key"), "perspective_id")
    bad = F.sum(F.when(F.col("mos") < threshold, F.col("seconds")).otherwise(0.0))
    out = rows.groupBy("receiver", "receiver_basis", "time_basis").agg(F.count_distinct("call_key").alias("calls"), F.sum("seconds").alias("covered"), bad.alias("bad"))
    return out.withColumn("bad_percent", 100 * F.col("bad") / F.col("covered"))
