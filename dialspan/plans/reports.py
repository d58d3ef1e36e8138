"""Summaries over intervals: series, cells, networks and calendar bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_keys, micros


def seconds(start: str = "start", end: str = "end") -> Column:
    return (micros(end) - micros(start)) / 1e6


def series_summary(df: DataFrame, key: list[str], threshold: float, value: str = "mos", window: Column | None = None) -> DataFrame:
    """Covered and bad seconds, the duration-weighted mean, and the coverage of ``window`` seconds (NULL if unknown or 0)."""
    s = seconds()
    bad = F.sum(F.when(F.col(value) < threshold, s).otherwise(0.0))
    out = [F.sum(s).alias("covered"), bad.alias("bad"), (100 * bad / F.nullif(F.sum(s), F.lit(0.0))).alias("bad_percent")]
    out += [(F.sum(F.col(value) * s) / F.nullif(F.sum(s), F.lit(0.0))).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")]
    if window is not None:
        out.append((100 * F.sum(s) / F.nullif(F.max(window), F.lit(0.0))).alias("coverage"))
    return df.groupBy(*key).agg(*out)


def cell_summary(df: DataFrame, cell: str = "cell", value: str = "mos", known: Column | None = None) -> DataFrame:
    """Per cell: seconds, weighted mean, extremes, distinct days (all that an interval touches), first and last; ``limited`` under 60 s or 2 days."""
    s = seconds()
    rows = df.where(F.col(cell).isNotNull()).withColumn("_s", s)
    extra = [(100 * F.sum(F.when(known, F.col("_s")).otherwise(0.0)) / F.sum("_s")).alias("known_percent")] if known is not None else []
    sums = rows.groupBy(cell).agg(F.sum("_s").alias("seconds"), (F.sum(F.col(value) * F.col("_s")) / F.sum("_s")).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.min("start").alias("first"), F.max("end").alias("last"), *extra)
    last = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("end")).cast("date")
    days = rows.select(cell, F.explode(F.sequence(F.col("start").cast("date"), last)).alias("day")).distinct().groupBy(cell).agg(F.count("*").alias("days"))
    return sums.join(days, cell).withColumn("limited", (F.col("seconds") < 60) | (F.col("days") < 2))


def network_breakdown(df: DataFrame, fields: list[str], value: str = "mos", threshold: float = 3.0) -> DataFrame:
    """Seconds, and those below the threshold, by access, upstream or operator; unknown is a group of its own."""
    s = seconds()
    keys = [F.coalesce(F.col(f), F.lit("unknown")).alias(f) for f in fields]
    return df.groupBy(*keys).agg(F.sum(s).alias("seconds"), F.sum(F.when(F.col(value) < threshold, s).otherwise(0.0)).alias("bad"))


def hour_pieces(df: DataFrame) -> DataFrame:
    """Intervals cut at hours: a row an hour (``_h``) with the seconds inside (``_s``); an interval without length stays in its hour."""
    end = F.greatest("start", F.timestamp_add("MICROSECOND", F.lit(-1), F.col("end")))
    hours = F.sequence(F.date_trunc("hour", F.col("start")).cast("timestamp_ntz"), end, F.expr("interval 1 hour"))
    rows = df.where("start <= end").withColumn("_h", F.explode(hours))
    low, high = F.greatest("start", "_h"), F.least("end", F.timestamp_add("HOUR", F.lit(1), F.col("_h")))
    return rows.withColumn("_s", (micros(high) - micros(low)) / 1e6)


def hour_bins() -> dict[str, Column]:
    """The calendar bins of an hour (``_h``), as text."""
    k = calendar_keys("_h")
    return {"day": k["day"].cast("string"), "hour": F.lpad(k["hour"].cast("string"), 2, "0"), "weekday": k["weekday"].cast("string"), "week_hour": F.lpad(k["week_hour"].cast("string"), 3, "0"), "month": F.lpad(k["month"].cast("string"), 2, "0"), "history_week": k["week"].cast("string"), "history_month": F.date_format("_h", "yyyy-MM"), "history_year": k["year"].cast("string")}


def with_bins(hourly: DataFrame) -> DataFrame:
    """A row for each calendar bin of an hour: kind, bin and ``_day``."""
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("bin")) for n, c in hour_bins().items()]))
    return hourly.withColumns({"_bin": made, "_day": F.col("_h").cast("date")}).withColumns({"kind": F.col("_bin.kind"), "bin": F.col("_bin.bin")}).drop("_bin", "_h")


def temporal_profile(df: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Per calendar bin: seconds, weighted mean, the mean of the days' means, days; intervals are cut at hours.

    Hours are summed up before they feed eight kinds of bins (weeks, months and years of the history
    among them); sums per (bin, day) come next, so that the last aggregation sees a row a day.
    """
    rows = hour_pieces(df).where("_s > 0")
    hourly = rows.groupBy(*key, "_h").agg(F.sum("_s").alias("_s"), F.sum(F.col(value) * F.col("_s")).alias("_w"))
    daily = with_bins(hourly).groupBy(*key, "kind", "bin", "_day").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w"))
    return daily.groupBy(*key, "kind", "bin").agg(F.sum("_s").alias("seconds"), (F.sum("_w") / F.sum("_s")).alias("mean"), F.avg(F.col("_w") / F.col("_s")).alias("day_mean"), F.count("*").alias("days"))


#: Bins that every place has, whether anything was observed in them or not: how many, from which on, and how many digits.
SPINE = {"hour": (24, 0, 2), "weekday": (7, 0, 1), "week_hour": (168, 0, 3), "month": (12, 1, 2)}
#: Days, sources and calls from which on a bin isn't ``limited``.
ENOUGH = {"days": 7, "sources": 3, "calls": 10}


def calendar_profile(df: DataFrame, key: list[str], measure: str = "mean", value: str = "value", call: str = "call", source: str = "source") -> DataFrame:
    """Per calendar bin of values that hold (``measure`` mean) or of counter deltas (delta), with the bins that hold nothing.

    mean: the time-weighted mean and that of the days' means; low and high. delta: the total and its
    rate per observed second; deltas don't cross hours (see ``located_deltas``). Both: seconds, distinct
    days, calls and sources, and ``limited`` where these are too few to compare.
    Hours, calls and sources are summed up once; a day's mean is that of its first row, so that
    days, calls and sources are counted in one aggregation of what is left.
    """
    if measure not in ("mean", "delta"):
        raise ValueError(f"unknown measure {measure}")
    rows = hour_pieces(df)
    weight = F.col("_s") if measure == "mean" else F.lit(1.0)
    rows = rows.where("_s > 0") if measure == "mean" else rows
    sums = [F.sum("_s").alias("_s"), F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high")]
    rows = rows.withColumns({"_w": F.col(value) * weight, "_n": weight, "_low": F.col(value), "_high": F.col(value)})
    hourly = rows.groupBy(*key, "_h", F.col(call).alias("_call"), F.col(source).alias("_source")).agg(*sums)
    daily = with_bins(hourly).groupBy(*key, "kind", "bin", "_day", "_call", "_source").agg(*sums)
    day = Window.partitionBy(*key, "kind", "bin", "_day")
    first = F.row_number().over(day.orderBy("_call", "_source")) == 1
    daily = daily.withColumn("_mean", F.when(first, F.sum("_w").over(day) / F.sum("_n").over(day)))
    made = daily.groupBy(*key, "kind", "bin").agg(
        F.sum("_s").alias("seconds"), F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.avg("_mean").alias("day_mean"), F.min("_low").alias("low"), F.max("_high").alias("high"),
        F.count_distinct("_day").alias("days"), F.count_distinct("_call").alias("calls"), F.count_distinct("_source").alias("sources"),
    )
    numbered = lambda kind, digits: lambda i: F.struct(F.lit(kind).alias("kind"), F.lpad(i.cast("string"), digits, "0").alias("bin"))
    bins = F.concat(*[F.transform(F.sequence(F.lit(low), F.lit(low + n - 1)), numbered(kind, digits)) for kind, (n, low, digits) in SPINE.items()])
    spine = made.select(*key).distinct().withColumn("_b", F.explode(bins)).select(*key, "_b.*")
    made = made.join(spine, [*key, "kind", "bin"], "full")
    none, counts = F.lit(None).cast("double"), ["days", "calls", "sources"]
    made = made.withColumns({"seconds": F.coalesce("seconds", F.lit(0.0)), **{c: F.coalesce(c, F.lit(0)) for c in counts}})
    few = (F.col("days") < ENOUGH["days"]) | (F.col("sources") < ENOUGH["sources"]) | (F.col("calls") < ENOUGH["calls"])
    if measure == "mean":
        told = {"mean": F.col("_w") / F.col("_n"), "total": none, "rate": none}
    else:
        told = {"mean": none, "day_mean": none, "total": F.col("_w"), "rate": F.when(F.col("seconds") > 0, F.col("_w") / F.col("seconds"))}
    return made.withColumns({**told, "limited": few}).select(*key, "kind", "bin", "seconds", "mean", "day_mean", "total", "rate", "low", "high", *counts, "limited")


def receiver_ranking(df: DataFrame, receiver: list[str], call: str, threshold: float = 3.0, value: str = "mos") -> DataFrame:
    """Bad share of the covered seconds per receiver, with distinct calls."""
    s = seconds()
    bad = F.sum(F.when(F.col(value) < threshold, s).otherwise(0.0))
    return df.groupBy(*receiver).agg(F.countDistinct(call).alias("calls"), F.sum(s).alias("covered"), bad.alias("bad"), (100 * bad / F.nullif(F.sum(s), F.lit(0.0))).alias("bad_percent"))
