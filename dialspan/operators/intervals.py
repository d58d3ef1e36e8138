"""Interval algebra: unions, lengths, overlaps, holds and cuts. Intervals are half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, micros
from .joins import row_hash
from .windows import SECOND, coalesce_segments, islands


def union_intervals(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of a key as one; empty spans are dropped."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(start) < F.col(end)).withColumn("_reach", F.max(end).over(before))
    rows = islands(rows, key, [start, end], F.col("_reach").isNull() | (F.col("_reach") < F.col(start)))
    return rows.groupBy(*key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("island")


def union_length(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """key and length (of integer spans): what the spans cover together."""
    return union_intervals(df, key, start, end).groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def overlap_per_window(df: DataFrame, key: list[str], width: int, anchor: Column | int = 0, start: str = "start", end: str = "end") -> DataFrame:
    """key, bin and covered: how much of each bin of ``width`` from ``anchor`` the union of integer spans covers."""
    anchor = anchor if isinstance(anchor, Column) else F.lit(anchor)
    merged = union_intervals(df, key, start, end)
    first = F.floor((F.col("start") - anchor) / width)
    last = F.floor((F.col("end") - 1 - anchor) / width)
    rows = merged.withColumn("bin", F.explode(F.sequence(first, last)))
    low = anchor + F.col("bin") * width
    piece = F.least("end", low + width) - F.greatest("start", low)
    return rows.groupBy(*key, "bin").agg(F.sum(piece).alias("covered"))


def hold_intervals(df: DataFrame, key: list[str], ts: str = "ts", value: str = "value", valid: Column | None = None, hold_us: int = 30 * SECOND, begin: str | None = None, stop: str | None = None) -> DataFrame:
    """key, start, end and value: a sample holds until the next time of its series, ``hold_us``, or ``stop``.

    A time counts if all its samples are valid and agree; one that doesn't gives nothing and
    still ends the hold before it. ``begin`` and ``stop`` are columns of the key's window.
    """
    usable = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    edges = [F.min(c).alias(c) for c in (begin, stop) if c]
    at = df.groupBy(*key, ts).agg(F.min(usable).alias("_ok"), F.min(value).alias("_low"), F.max(value).alias("value"), F.count(value).alias("_n"), F.count("*").alias("_all"), *edges)
    good = F.col("_ok") & (F.col("_n") == F.col("_all")) & (F.col("_low") == F.col("value"))
    by = Window.partitionBy(*key).orderBy(ts)
    at = at.withColumn("_next", F.lead(ts).over(by))
    ends = [from_micros(micros(ts) + hold_us), F.col("_next"), *([F.col(stop)] if stop else [])]
    starts = [F.col(ts), *([F.col(begin)] if begin else [])]
    at = at.where(good).select(*key, (F.greatest(*starts) if begin else starts[0]).alias("start"), F.least(*ends).alias("end"), "value")
    return at.where("start < end")


def clip(df: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """The parts of the intervals inside [low, high)."""
    rows = df.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})
    return rows.where(F.col(start) < F.col(end))


def overlaps_within(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended (an error in a series)."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(end).over(before)).where(F.col("_reach") > F.col(start)).drop("_reach")


def split_at_states(df: DataFrame, states: DataFrame, key: list[str], fields: list[str], expiry_us: int = 30 * SECOND, start: str = "start", end: str = "end", ts: str = "ts") -> DataFrame:
    """Each interval cut where a state of its key changes or expires inside; pieces have the state at their left edge.

    ``states`` has one row a time with ``ok``; a bad one is a barrier: from there on the fields
    are NULL, never those of an older state. Boundaries are spread over the intervals by time
    buckets of the expiry, so that a key with long history isn't one group.
    """
    width = expiry_us
    by = Window.partitionBy(*key).orderBy(ts)
    spans = states.withColumn("_from", micros(ts)).withColumn("_next", micros(F.lead(ts).over(by)))
    spans = spans.withColumn("_to", F.least(F.col("_from") + expiry_us, F.col("_next"))).where("_from < _to")
    spans = spans.select(*key, "_from", "_to", "ok", *fields).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    same = row_hash(df.columns)
    twin = F.row_number().over(Window.partitionBy("_same", start, end).orderBy(start))  # equal rows are interchangeable
    rows = df.withColumn("_same", same).withColumn("_row", F.xxhash64("_same", twin)).drop("_same").withColumns({"_a": micros(start), "_b": micros(end)})
    pieces = rows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor((F.col("_b") - 1) / width))))
    low, high = F.greatest("_a", F.col("_bucket") * width), F.least("_b", (F.col("_bucket") + 1) * width)
    pieces = pieces.withColumns({"_low": low, "_high": high})
    met = pieces.join(spans, [*key, "_bucket"], "left").where("_from IS NULL OR (_from < _high AND _to > _low)")
    known = met.where("_from IS NOT NULL").select(*[c for c in df.columns if c not in (start, end)], "_row", F.greatest("_low", "_from").alias("_s"), F.least("_high", "_to").alias("_e"), *[F.when(F.col("ok"), F.col(f)).alias(f) for f in fields])
    names = [c for c in df.columns if c not in (start, end)]
    edges = known.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_s", "_e"))).alias("_known"))
    rest = rows.join(edges, "_row", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<struct<_s:bigint,_e:bigint>>")))
    cuts = F.concat(F.array(F.struct(F.col("_a").alias("_s"), F.col("_a").alias("_e"))), F.col("_known"), F.array(F.struct(F.col("_b").alias("_s"), F.col("_b").alias("_e"))))
    rest = rest.withColumn("_cuts", cuts)
    gaps = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), lambda i: F.struct(F.get("_cuts", i)["_e"].alias("_s"), F.get("_cuts", i + 1)["_s"].alias("_e")))
    rest = rest.withColumn("_gap", F.explode(F.filter(gaps, lambda g: g["_s"] < g["_e"])))
    types = dict(states.dtypes)
    unknown = rest.select(*names, "_row", F.col("_gap._s").alias("_s"), F.col("_gap._e").alias("_e"), *[F.lit(None).cast(types[f]).alias(f) for f in fields])
    joined = known.unionByName(unknown).withColumns({start: from_micros("_s"), end: from_micros("_e")}).drop("_s", "_e")
    return coalesce_segments(joined, ["_row", *names], fields, start, end).drop("_row")
