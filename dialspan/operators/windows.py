"""Operators over ordered series: counters, islands, segments, passes and copies.

Every operator partitions by the caller's key and needs one sort of it. Times are
TIMESTAMP_NTZ; gaps are compared in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros

SECOND = 1_000_000
#: 30 s and the tolerance of the status rule.
GAP_US = 30_000_010


def counter_intervals(df: DataFrame, key: list[str], order: list[str], ts: str = "ts", value: str = "value", valid: Column | str = "valid", gap_us: int = GAP_US) -> DataFrame:
    """Each sample with its predecessor, a status and, where that is ok, the increase.

    The first that holds: initial (no predecessor), invalid (either), conflict (several samples at
    either time, or equal times), reset (a decrease), gap (more than ``gap_us``), ok. Nothing is
    dropped; scopes are applied afterwards, so that a scope's edge isn't a series' beginning.
    """
    valid = F.col(valid) if isinstance(valid, str) else valid
    by = Window.partitionBy(*key).orderBy(ts, *order)
    rows = df.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_many", F.count("*").over(Window.partitionBy(*key, ts)))
    rows = rows.withColumns({f"_p{c}": F.lag(c).over(by) for c in ("_valid", "_many")} | {"previous_ts": F.lag(ts).over(by), "previous_value": F.lag(value).over(by)})
    gap = micros(ts) - micros("previous_ts")
    status = (
        F.when(F.col("previous_ts").isNull(), "initial")
        .when(~F.col("_valid") | ~F.col("_p_valid"), "invalid")
        .when((F.col("_many") > 1) | (F.col("_p_many") > 1) | (gap == 0), "conflict")
        .when(F.col(value) < F.col("previous_value"), "reset")
        .when(gap > gap_us, "gap")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("delta", F.when(F.col("status") == "ok", F.col(value) - F.col("previous_value"))).drop("_valid", "_many", "_p_valid", "_p_many")


def counter_deltas(df: DataFrame, key: list[str], order: list[str], ts: str = "ts", value: str = "value", valid: Column | str = "valid", gap_us: int = 30 * SECOND) -> DataFrame:
    """Only the pairs of consecutive samples that are valid, uncontested, near and not decreasing."""
    return counter_intervals(df, key, order, ts, value, valid, gap_us).where("status = 'ok'")


def located_deltas(df: DataFrame, key: list[str], same: list[str], ts: str = "ts", value: str = "value", valid: Column | str = "valid", gap_us: int = 30 * SECOND) -> DataFrame:
    """Increases between consecutive good times that agree in ``same``.

    A time with an invalid sample or with several values clears the predecessor; any other time
    becomes the predecessor, whether or not the pair counts.
    """
    valid = F.col(valid) if isinstance(valid, str) else valid
    at = df.groupBy(*key, ts).agg(F.min(F.coalesce(valid, F.lit(False))).alias("_ok"), F.min(value).alias("_low"), F.max(value).alias("_high"), *[F.first(c).alias(c) for c in same])
    at = at.withColumn("_good", F.col("_ok") & (F.col("_low") == F.col("_high")))
    by = Window.partitionBy(*key).orderBy(ts)
    at = at.withColumn("_run", F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(by)).where("_good")
    run = Window.partitionBy(*key, "_run").orderBy(ts)
    at = at.withColumns({"previous_ts": F.lag(ts).over(run), "_before": F.lag("_low").over(run)} | {f"_p{c}": F.lag(c).over(run) for c in same})
    gap = micros(ts) - micros("previous_ts")
    kept = at.where((gap > 0) & (gap <= gap_us) & (F.col("_low") >= F.col("_before")))
    for c in same:
        kept = kept.where(F.col(c).eqNullSafe(F.col(f"_p{c}")))
    return kept.select(*key, "previous_ts", F.col(ts).alias("ts"), *same, (F.col("_low") - F.col("_before")).alias("delta"))


def islands(df: DataFrame, key: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """``df`` with the number of the run that a row belongs to; ``begins`` tells where one begins."""
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(by))


def bad_episodes(df: DataFrame, key: list[str], bad: Column, start: str = "start", end: str = "end", least_us: int = 0, extra: list[Column] | None = None) -> DataFrame:
    """Runs of bad intervals that follow one another without a gap: key, start, end, intervals (and ``extra`` aggregates).

    Runs shorter than ``least_us`` are dropped after they were joined.
    """
    by = Window.partitionBy(*key).orderBy(start, end)
    rows = df.where(bad).withColumn("_end", F.lag(end).over(by))
    rows = islands(rows, key, [start, end], ~F.col("_end").eqNullSafe(F.col(start)))
    out = rows.groupBy(*key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("intervals"), *(extra or [])).drop("island")
    return out.where(micros("end") - micros("start") >= least_us)


def coalesce_segments(df: DataFrame, key: list[str], same: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Neighbouring segments that touch and agree in ``same`` as one."""
    by = Window.partitionBy(*key).orderBy(start)
    differs = ~F.lag(end).over(by).eqNullSafe(F.col(start))
    for c in same:
        differs = differs | ~F.lag(c).over(by).eqNullSafe(F.col(c))
    rows = df.withColumn("_new", differs)
    rows = islands(rows, key, [start], F.col("_new"))
    return rows.groupBy(*key, "island", *same).agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("island")


def route_segments(df: DataFrame, key: list[str], ts: str = "ts", gap_us: int = 30 * SECOND) -> DataFrame:
    """``df`` with ``segment``: a new one after more than ``gap_us`` without a row."""
    by = Window.partitionBy(*key).orderBy(ts)
    rows = df.withColumn("_gap", micros(ts) - micros(F.lag(ts).over(by)))
    return islands(rows, key, [ts], F.col("_gap").isNull() | (F.col("_gap") > gap_us), "segment").drop("_gap")


def cell_passes(df: DataFrame, key: list[str], cell: str = "cell", ts: str = "ts", gap_us: int = 120 * SECOND) -> DataFrame:
    """key, cell and passes: how often a cell was entered (another cell before, or more than ``gap_us``)."""
    by = Window.partitionBy(*key).orderBy(ts)
    new = ~F.lag(cell).over(by).eqNullSafe(F.col(cell)) | (micros(ts) - micros(F.lag(ts).over(by)) > gap_us)
    return df.withColumn("_new", new).groupBy(*key, cell).agg(F.count_if("_new").alias("passes"))


def copy_ranking(df: DataFrame, content: list[str], source: str, order: list[str]) -> DataFrame:
    """The n-th occurrence of a content in each source; of equal numbers the newest source stays, with how many copies there are."""
    nth = df.withColumn("occurrence", F.row_number().over(Window.partitionBy(source, *content).orderBy(*order)))
    copies = Window.partitionBy(*content, "occurrence")
    ranked = nth.withColumn("copies", F.count("*").over(copies)).withColumn("_rank", F.row_number().over(copies.orderBy(F.col(source).desc())))
    return ranked.where("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, key: list[str], order: list[str], columns: list[str], newest: bool = False) -> DataFrame:
    """The first (or newest) row's columns of each key by an aggregate, which is combined before it is shuffled."""
    rank = F.struct(*order)
    pick = F.max_by if newest else F.min_by
    return df.groupBy(*key).agg(*[pick(c, rank).alias(c) for c in columns])


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the page, whether there is more) in a stable order."""
    ahead = df.orderBy(*order).offset(offset).limit(limit + 1)
    return ahead.limit(limit), ahead.agg((F.count("*") > limit).alias("more"))
