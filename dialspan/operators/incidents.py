"""Episodes of audio incidents, their windows and the continuity score.

Signals of a key (kind, device, observer or flow, and the latest creations of its devices) are
cut where an episode begins: at a start, or after an end. What an episode knows is then an
aggregate over its own signals, so that no key is walked row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_per_window, union_intervals, union_length
from .windows import SECOND


def reconstruct_incidents(signals: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Episodes of (key, phase, t_us, duration_ms) signals; phase is start, missing, ongoing or end.

    Columns: start_us, end_us, last_us, duration_ms, duration_basis, start_basis, status, signals.
    Repeated signals count once. ``missing`` carries the length of the silence before it and
    moves the start back. An end without an episode is one that ends there. Episodes without an
    end are open.
    """
    same = [*key, "phase", "t_us", "duration_ms"]
    once = signals.groupBy(*same).agg(*[F.min(c).alias(c) for c in order]) if order else signals.select(*same).distinct()
    rank = F.when(F.col("phase") == "end", 1).otherwise(0)
    by = Window.partitionBy(*key).orderBy("t_us", *(order or []), rank, "duration_ms")
    before = F.lag("phase").over(by)
    rows = once.withColumn("_new", before.isNull() | (F.col("phase") == "start") | (before == "end"))
    rows = rows.withColumn("_e", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(by))
    own = Window.partitionBy(*key, "_e").orderBy("t_us", *(order or []), rank, "duration_ms")
    back = F.col("t_us") - F.round(F.coalesce("duration_ms", F.lit(0.0)) * 1000).cast("long")
    began = F.when(F.col("phase") == "missing", back).when(F.col("_new"), F.when(F.col("phase") == "start", F.col("t_us")).otherwise(back))
    rows = rows.withColumn("_start", F.min(began).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.when(F.col("phase") == "missing", F.when(F.col("_new"), F.col("duration_ms")).otherwise((F.col("t_us") - F.col("_start")) / 1000)).when(F.col("phase") == "ongoing", F.col("duration_ms"))
    basis = F.when(F.col("_new") & (F.col("phase") == "missing"), "minimum").when((F.col("phase") == "ongoing") & F.col("duration_ms").isNotNull(), "minimum")
    first = F.when(F.col("phase") == "start", "observed").when(F.col("phase") == "missing", "threshold").when(F.col("phase") == "ongoing", "reported_elapsed").when(F.col("duration_ms").isNotNull(), "reported_duration").otherwise("unknown")
    at = F.struct("t_us", *(order or []), rank.alias("_rank"), "duration_ms")
    ends = F.col("phase") == "end"
    e = rows.withColumns({"_length": length, "_basis": basis}).groupBy(*key, "_e").agg(
        F.min("_start").alias("start_us"),
        F.max(F.when(ends, F.col("t_us"))).alias("end_us"),
        F.max("t_us").alias("last_us"),
        F.max_by("_length", F.when(F.col("_length").isNotNull(), at)).alias("_length"),
        F.max_by("_basis", F.when(F.col("_basis").isNotNull(), at)).alias("_basis"),
        F.min_by(first, at).alias("start_basis"),
        F.max(F.when(ends, F.col("duration_ms"))).alias("_reported"),
        F.count("*").alias("signals"),
    )
    closed = F.col("end_us").isNotNull()
    span = F.greatest((F.col("end_us") - F.col("start_us")) / 1000, F.lit(0.0))
    timed = F.col("start_basis").isin("threshold", "observed")
    duration = F.when(~closed, F.col("_length")).when(F.col("_reported").isNotNull(), F.col("_reported")).when(timed, span)
    why = F.when(~closed, F.coalesce("_basis", F.lit("unknown"))).when(F.col("_reported").isNotNull(), "reported").when(F.col("start_basis") == "threshold", "minimum").when(F.col("start_basis") == "observed", "timestamps").otherwise("unknown")
    return e.withColumns({"duration_ms": duration, "duration_basis": why, "status": F.when(closed, "closed").otherwise("open")}).drop("_e", "_length", "_basis", "_reported")


def place_incidents(episodes: DataFrame, mode: str = "reported_end") -> DataFrame:
    """``episodes`` with a_us and b_us: the reported duration before the end, or the messages' times (``log_span``); NULL where it can't be placed."""
    if mode == "log_span":
        ok = (F.col("status") == "closed") & (F.col("start_basis") != "unknown")
        return episodes.withColumns({"a_us": F.when(ok, F.col("start_us")), "b_us": F.when(ok, F.col("end_us"))})
    ok = (F.col("status") == "closed") & (F.col("duration_basis") == "reported")
    return episodes.withColumns({"a_us": F.when(ok, F.col("end_us") - F.round(F.col("duration_ms") * 1000).cast("long")), "b_us": F.when(ok, F.col("end_us"))})


def incident_windows(placed: DataFrame, bounds: DataFrame, key: list[str], width_us: int) -> DataFrame:
    """Every bin of a series with episodes: start_us, end_us, known_percent, and percent unless an episode there is open or unplaced.

    ``bounds``: key, anchor_us, begin_us, stop_us of the series' windows. Bins are cut at the
    bounds and measured by their own length; a series without episodes has none.
    """
    rows = placed.join(bounds, key)
    fixed = rows.where("a_us IS NOT NULL").select(*key, "anchor_us", (F.greatest("a_us", "begin_us") - F.col("anchor_us")).alias("start"), (F.least("b_us", "stop_us") - F.col("anchor_us")).alias("end"))
    loose = rows.where("a_us IS NULL")
    left = F.when(F.col("start_basis") == "unknown", F.col("anchor_us")).otherwise(F.col("start_us"))
    right = F.coalesce("end_us", "stop_us")
    loose = loose.select(*key, (F.greatest(left, "begin_us") - F.col("anchor_us")).alias("start"), (F.least(right, "stop_us") - F.col("anchor_us")).alias("end"))
    covered = overlap_per_window(fixed, key, width_us)
    unsure = overlap_per_window(loose, key, width_us).select(*key, "bin", F.lit(True).alias("unsure"))
    spine = placed.select(*key).distinct().join(bounds, key).where("begin_us < stop_us")
    spine = spine.withColumn("bin", F.explode(F.sequence(F.floor((F.col("begin_us") - F.col("anchor_us")) / width_us), F.floor((F.col("stop_us") - 1 - F.col("anchor_us")) / width_us))))
    low = F.greatest(F.col("anchor_us") + F.col("bin") * width_us, "begin_us")
    high = F.least(F.col("anchor_us") + (F.col("bin") + 1) * width_us, "stop_us")
    out = spine.select(*key, "bin", low.alias("start_us"), high.alias("end_us")).join(covered, [*key, "bin"], "left").join(unsure, [*key, "bin"], "left")
    known = 100 * F.coalesce("covered", F.lit(0)) / (F.col("end_us") - F.col("start_us"))
    return out.withColumns({"known_percent": known, "percent": F.when(F.col("unsure").isNull(), known), "occupied_ms": F.coalesce("covered", F.lit(0)) / 1000}).drop("covered", "unsure")


def incident_call_summary(placed: DataFrame, perspectives: DataFrame, key: list[str]) -> DataFrame:
    """Episodes, closed and unresolved ones and the length of their union; perspectives without any have a zero row and no union."""
    sums = placed.groupBy(*key).agg(F.count("*").alias("episodes"), F.count_if(F.col("status") == "closed").alias("closed"), F.count_if(F.col("a_us").isNull()).alias("unresolved"))
    length = union_length(placed.where("a_us IS NOT NULL"), key, "a_us", "b_us").withColumn("union_ms", F.col("length") / 1000).drop("length")
    out = sums.join(length, key, "left")
    rows = perspectives.select("perspective_id").join(out, "perspective_id", "left")
    return rows.fillna(0, subset=["episodes", "closed", "unresolved"])


def incident_coverage(perspectives: DataFrame, episodes: DataFrame, samples: DataFrame) -> DataFrame:
    """Per perspective: episodes, reader samples, and whether absence of episodes can be told."""
    e = episodes.groupBy("perspective_id").agg(F.count("*").alias("episodes"))
    s = samples.groupBy("perspective_id").agg(F.count("*").alias("reader_samples"))
    out = perspectives.select("perspective_id", "line_id").join(e, "perspective_id", "left").join(s, "perspective_id", "left").fillna(0, subset=["episodes", "reader_samples"])
    return out.withColumn("evaluable", F.col("line_id").isNotNull() & ((F.col("episodes") > 0) | (F.col("reader_samples") > 0)))


def pq_runs(episodes: DataFrame, calls: DataFrame, series: list[str], width_us: int = SECOND) -> DataFrame:
    """Continuity of every clock bin of a call as runs of equal bins: perspective_id, series, first_bin, last_bin, pq, begin_us and stop_us.

    ``calls``: perspective_id, begin_us, stop_us. ``episodes`` have perspective_id, ``series`` and,
    optionally, active_until_us (the next creation of their device). An open episode lasts until
    the call ends; one with an unknown start isn't placed. A call without series is one assumed
    series at 100. Bins that an episode fills, and those between episodes, are one row a run, so
    that rows grow with the episodes and not with the length of the calls.
    """
    key = ["perspective_id", *series]
    until = F.col("active_until_us") if "active_until_us" in episodes.columns else F.lit(None).cast("long")
    rows = episodes.join(calls, "perspective_id").where("start_basis <> 'unknown'")
    b = F.least(F.coalesce("end_us", "stop_us"), F.coalesce(until, F.col("stop_us")), F.col("stop_us"))
    by_duration = (F.col("start_basis") != "observed") & (F.col("status") == "closed") & (F.col("duration_ms") >= 0)
    a = F.when(by_duration, b - F.round(F.col("duration_ms") * 1000).cast("long")).otherwise(F.col("start_us"))
    merged = union_intervals(rows.select(*key, F.greatest(a, F.col("begin_us")).alias("start"), b.alias("end")), key)
    first, last = F.floor(F.col("start") / width_us), F.floor((F.col("end") - 1) / width_us)
    piece = lambda x, y, us: F.struct(x.alias("first_bin"), y.alias("last_bin"), us.cast("long").alias("covered"))
    head, tail = (first + 1) * width_us - F.col("start"), F.col("end") - last * width_us
    filled = F.when(last - first > 1, piece(first + 1, last - 1, F.lit(None)))
    parts = F.when(first == last, F.array(piece(first, first, F.col("end") - F.col("start")))).otherwise(F.array_compact(F.array(piece(first, first, head), filled, piece(last, last, tail))))
    busy = merged.select(*key, F.explode(parts).alias("_p")).select(*key, "_p.*").groupBy(*key, "first_bin", "last_bin").agg(F.sum("covered").alias("covered"))
    known = episodes.select(*key).distinct()
    spine = calls.where("begin_us < stop_us").join(known, "perspective_id", "left").withColumns({c: F.coalesce(c, F.lit("assumed")) for c in series})
    over = F.floor((F.col("stop_us") - 1) / width_us) + 1
    ends = spine.select(*key, "begin_us", "stop_us", over.alias("first_bin"), over.alias("last_bin"), F.lit(True).alias("_over"))
    every = busy.join(spine.select(*key, "begin_us", "stop_us"), key).unionByName(ends, allowMissingColumns=True)
    before = F.coalesce(F.lag("last_bin").over(Window.partitionBy(*key).orderBy("first_bin")), F.floor(F.col("begin_us") / width_us) - 1)
    length = F.least((F.col("first_bin") + 1) * width_us, "stop_us") - F.greatest(F.col("first_bin") * width_us, "begin_us")
    run = lambda x, y, pq: F.struct(x.alias("first_bin"), y.alias("last_bin"), pq.cast("double").alias("pq"))
    gap = F.when(F.col("first_bin") > F.col("_before") + 1, run(F.col("_before") + 1, F.col("first_bin") - 1, F.lit(100)))
    own = F.when(F.col("_over").isNull(), run(F.col("first_bin"), F.col("last_bin"), F.when(F.col("covered").isNull(), F.lit(0.0)).otherwise(100 - 100 * F.col("covered") / length)))
    every = every.withColumn("_before", before).withColumn("_r", F.explode(F.array_compact(F.array(gap, own))))
    return every.select(*key, "begin_us", "stop_us", "_r.*")


def pq_windows(episodes: DataFrame, calls: DataFrame, series: list[str], blanks: DataFrame | None = None, width_us: int = SECOND) -> DataFrame:
    """Every clock bin (a second) of a call with its continuity: 100 minus the percentage that episodes occupy.

    The runs of ``pq_runs``, bin by bin. ``blanks`` (perspective_id, start, end in microseconds) blank the bins they touch.
    """
    rows = pq_runs(episodes, calls, series, width_us).withColumn("bin", F.explode(F.sequence("first_bin", "last_bin")))
    low, high = F.greatest(F.col("bin") * width_us, "begin_us"), F.least((F.col("bin") + 1) * width_us, "stop_us")
    out = rows.select("perspective_id", *series, "bin", low.alias("start_us"), high.alias("end_us"), "pq")
    if blanks is not None:
        gone = overlap_per_window(blanks, ["perspective_id"], width_us).select("perspective_id", "bin")
        out = out.join(gone, ["perspective_id", "bin"], "left_anti")
    return out
