"""Intervals and scores at places: located, canonical, per cell and along a route.

Fixes come as stamps (one row a time, ``ok`` unless contested). A stamp that isn't ok is a
barrier: nothing is held or interpolated across it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, grid_cell, lon_arc, micros
from .intervals import split_at_states
from .joins import row_hash, state_at, within_tolerance_join
from .windows import SECOND


def fix_stamps(positions: DataFrame, key: list[str]) -> DataFrame:
    """One row a time of positions: ok if all are valid and agree."""
    same = (F.min("latitude") == F.max("latitude")) & (F.min("longitude") == F.max("longitude"))
    return positions.groupBy(*key, "ts").agg((F.min(F.coalesce("valid", F.lit(False))) & same).alias("ok"), F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"), F.max("accuracy").alias("accuracy"))


#: What makes two scored intervals the same observation, whichever archive brought them.
LINEAGE = ["call_key", "text", "direction", "flow", "ssrc", "report_ts", "loss"]


def lineage(intervals: DataFrame, columns: list[str] | None = None) -> Column:
    """A number of the evidence behind an interval: equal in all copies of it, with nulls told apart.

    ``columns``: those that name the evidence; by default the ones of ``LINEAGE`` that are there, or
    all but the edges if none is.
    """
    found = columns or [c for c in LINEAGE if c in intervals.columns] or [c for c in intervals.columns if c not in ("start", "end")]
    return row_hash(found)


def locate_intervals(intervals: DataFrame, positions: DataFrame, key: list[str], most_us: int = 120 * SECOND, evidence: list[str] | None = None) -> DataFrame:
    """Pieces of intervals while a fix holds (until the next stamp or ``most_us``), with its place and the ``signature`` of their evidence."""
    signed = intervals.withColumn("signature", lineage(intervals, evidence))
    pieces = split_at_states(signed, fix_stamps(positions, key).drop("accuracy"), key, ["latitude", "longitude"], most_us)
    return pieces.where("latitude IS NOT NULL")


def declared_positions(positions: DataFrame, intervals: DataFrame, call: str, most_us: int = 120 * SECOND) -> DataFrame:
    """The fixes that count for a call (import_id, call) where declared places do: its own declared ones and all fresh ones from ``most_us`` before it to its end."""
    spans = intervals.groupBy("import_id", call).agg(F.min("start").alias("_start"), F.max("end").alias("_end"))
    fresh = within_tolerance_join(positions.where("kind = 'fresh'").drop(call), spans, ["import_id"], most_us, span=("_start", "_end"))
    own = positions.where("kind = 'sip_local'")
    columns = ["import_id", call, "ts", "latitude", "longitude", "accuracy", "valid"]
    return fresh.select(*columns).unionByName(own.select(*columns))


def canonical_intervals(rows: DataFrame, value: list[str], context: list[str]) -> DataFrame:
    """One observation per elementary piece of a signature: copies must agree in ``value``, else the piece is a conflict and goes; a context field with two values is unknown.

    The edges of a signature are numbered, and an interval becomes the pieces between its own two numbers:
    nothing is held against the signature's other intervals.
    """
    once = rows.select("signature", "start", "end", *value, *context).distinct().where("start < end")
    edges = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(0).alias("side")), F.struct(F.col("end").alias("t"), F.lit(1).alias("side"))))
    edges = once.select("signature", F.struct(*value, *context, "start", "end").alias("_r"), edges.alias("_e")).select("signature", "_r", "_e.t", "_e.side")
    edges = edges.withColumn("_i", F.dense_rank().over(Window.partitionBy("signature").orderBy("t")))
    cuts = edges.groupBy("signature", "_i").agg(F.min("t").alias("a"))
    cuts = cuts.withColumn("b", F.lead("a").over(Window.partitionBy("signature").orderBy("_i")))
    spans = edges.groupBy("signature", "_r").agg(F.min_by("_i", "side").alias("_from"), F.max_by("_i", "side").alias("_to"))
    pieces = spans.withColumn("_i", F.explode(F.sequence("_from", F.col("_to") - 1))).select("signature", "_i", "_r.*").drop("start", "end")
    same = F.lit(True)
    for v in value:
        same = same & F.min(v).eqNullSafe(F.max(v))
    one = [F.when(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).otherwise("unknown").alias(c) for c in context]
    out = pieces.groupBy("signature", "_i").agg(same.alias("_same"), *[F.min(v).alias(v) for v in value], *one).where("_same")
    return out.join(cuts, ["signature", "_i"]).withColumnsRenamed({"a": "start", "b": "end"}).select("signature", "start", "end", *value, *context)


def position_at(rows: DataFrame, positions: DataFrame, key: list[str], ts: str = "ts", most_us: int = 120 * SECOND) -> DataFrame:
    """``rows`` with the place of the last fix at or before their time, if that is uncontested and younger than ``most_us``."""
    return state_at(rows, fix_stamps(positions, key), key, ["latitude", "longitude"], ts, most_us)


def position_cells(positions: DataFrame, metres: float) -> DataFrame:
    """Cells with any valid local fix; says nothing of quality."""
    return positions.where("valid").select(grid_cell("latitude", "longitude", metres).alias("cell")).distinct()


def _scored(rows: DataFrame, pq: DataFrame, key: str = "perspective_id") -> DataFrame:
    """``rows`` (one row a key and bin) that have scores, with their number ``_n`` and the least ``pq``.

    How many bins calls have doesn't follow from the planned size of ``pq``, which is never sent to the driver, nor sorted:
    tasks hold their part of ``rows`` and pass the bins by. Scores are counted after that.
    """
    found = rows.hint("shuffle_hash").join(pq.select(F.col("perspective_id").alias(key), "bin", "pq"), [key, "bin"])
    return found.groupBy(*rows.columns).agg(F.count("*").alias("_n"), F.min("pq").alias("pq"))


def cell_seconds(fixes: DataFrame, pq: DataFrame, metres: float, width_us: int = SECOND) -> DataFrame:
    """perspective_id, bin, cell and pq of the seconds that hold a fix: exactly one cell and one series there."""
    places = fixes.withColumns({"bin": F.floor(micros("ts") / width_us), "cell": grid_cell("latitude", "longitude", metres)})
    places = places.groupBy("perspective_id", "bin").agg(F.countDistinct("cell").alias("_c"), F.min("cell").alias("cell")).where("_c = 1")
    return _scored(places.drop("_c"), pq).where("_n = 1").select("perspective_id", "bin", "cell", "pq")


def pq_cells_direct(fixes: DataFrame, pq: DataFrame, metres: float) -> DataFrame:
    """Per cell: mean score of its seconds (each counts once), seconds, days, passes; ``limited`` under 60 seconds or 2 days."""
    rows = cell_seconds(fixes, pq, metres)
    by = Window.partitionBy("perspective_id").orderBy("bin")
    new = ~F.lag("cell").over(by).eqNullSafe(F.col("cell")) | (F.col("bin") - F.lag("bin").over(by) > 120)
    return _cells(rows.withColumn("_new", new))


def _cells(rows: DataFrame) -> DataFrame:
    daily = rows.withColumn("_day", F.floor(F.col("bin") / 86_400)).groupBy("cell", "_day").agg(F.sum("pq").alias("_s"), F.count("*").alias("_n"), F.count_if("_new").alias("_p"))
    out = daily.groupBy("cell").agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("seconds"), F.count("*").alias("days"), F.sum("_p").alias("passes"))
    return out.withColumn("limited", (F.col("seconds") < 60) | (F.col("days") < 2))


def route_samples(fixes: DataFrame, pq: DataFrame, key: str = "perspective_id", most_us: int = 120 * SECOND) -> DataFrame:
    """A midpoint of each complete clock second between consecutive ok fixes at most ``most_us`` apart; the place is interpolated, the score is the second's own."""
    by = Window.partitionBy(key).orderBy("ts")
    nxt = {f"_n{c}": F.lead(c).over(by) for c in ("ts", "ok", "latitude", "longitude")}
    rows = fixes.withColumns(nxt).withColumns({"_a": micros("ts"), "_b": micros("_nts")}).where(F.col("ok") & F.col("_nok") & (F.col("_b") - F.col("_a") <= most_us))
    first, last = F.ceil(F.col("_a") / SECOND), F.floor(F.col("_b") / SECOND) - 1
    rows = rows.where(first <= last).withColumn("bin", F.explode(F.sequence(first, last)))
    share = (F.col("bin") * SECOND + SECOND / 2 - F.col("_a")) / (F.col("_b") - F.col("_a"))
    lat = F.col("latitude") + (F.col("_nlatitude") - F.col("latitude")) * share
    lon = F.pmod(F.col("longitude") + lon_arc("longitude", "_nlongitude") * share + 180, F.lit(360.0)) - 180
    return _scored(rows.select(key, "bin", lat.alias("latitude"), lon.alias("longitude")), pq, key).where("_n = 1").drop("_n")


def pq_cells_estimated(samples: DataFrame, direct: DataFrame, metres: float) -> DataFrame:
    """Cells of interpolated midpoints beside direct ones: the direct mean wins where both are known."""
    rows = samples.withColumn("cell", grid_cell("latitude", "longitude", metres))
    by = Window.partitionBy("perspective_id").orderBy("bin")
    new = ~F.lag("cell").over(by).eqNullSafe(F.col("cell")) | (F.col("bin") - F.lag("bin").over(by) != 1)
    est = _cells(rows.withColumn("_new", new)).select("cell", F.col("mean").alias("estimated_mean"), F.col("seconds").alias("estimated_seconds"))
    out = direct.join(est, "cell", "full")
    return out.withColumns({"basis": F.when(F.col("mean").isNotNull(), "direct").otherwise("estimated"), "value": F.coalesce("mean", "estimated_mean")})


def route_points(fixes: DataFrame, pq: DataFrame, calls: DataFrame, metres: float) -> DataFrame:
    """Every fix of a call (perspective_id, ts, cached, latitude, longitude) with its cell and its second's score or the reason there is none."""
    rows = fixes.join(calls.select("perspective_id", "begin_us", "stop_us"), "perspective_id").withColumns({"_t": micros("ts"), "cell": grid_cell("latitude", "longitude", metres)})
    rows = rows.withColumn("bin", F.floor(F.col("_t") / SECOND))
    several = rows.groupBy("perspective_id", "bin").agg((F.countDistinct("cell") > 1).alias("_many"))
    scores = _scored(several, pq).drop("_many")
    rows = rows.join(several, ["perspective_id", "bin"]).join(scores, ["perspective_id", "bin"], "left")
    reason = F.when(F.col("cached"), "cached_position").when(F.col("_t") < F.col("begin_us"), "before_connect").when(F.col("_t") >= F.col("stop_us"), "at_or_after_end").when(F.col("_many"), "several_cells_in_second").when(F.coalesce(F.col("_n") != 1, F.lit(True)), "no_unique_series")
    return rows.withColumns({"reason": reason, "pq": F.when(reason.isNull(), F.col("pq"))}).drop("_t", "_many", "_n", "begin_us", "stop_us")


def telemetry_places(intervals: DataFrame, fixes: DataFrame, networks: DataFrame, key: list[str], most_ms: int = 30_000) -> DataFrame:
    """Monotonic intervals cut at fixes, their expiry and network changes; only pieces at a valid fix are placed."""
    as_time = lambda df, *cols: df.withColumns({c: from_micros(F.round(F.col(s) * 1000).cast("long")) for c, s in cols})
    rows = as_time(intervals, ("start", "start_ms"), ("end", "end_ms")).drop("start_ms", "end_ms")
    at = as_time(fixes, ("ts", "mono_ms")).drop("mono_ms")
    net = as_time(networks, ("ts", "mono_ms")).drop("mono_ms")
    rows = split_at_states(rows, at, key, ["latitude", "longitude"], most_ms * 1000)
    rows = split_at_states(rows, net, key, ["access"], most_ms * 1000)
    return rows.where("latitude IS NOT NULL").withColumn("access", F.coalesce("access", F.lit("unknown")))
