"""Listings, contexts, evidence and summaries of calls, metrics and notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, mapped, micros, mos_score, series_key, unit_label
from ..operators.intervals import clip, hold_intervals, overlaps_within, split_at_states
from ..operators.joins import asof_latest, row_hash, state_stamps, within_tolerance_join
from ..operators.network import connectivity_timeline, notices_to_calls
from ..operators.windows import SECOND
from .dictionary import dictionary
from .reports import seconds


def call_context(events: DataFrame, windows: DataFrame, families: list[str]) -> DataFrame:
    """Events of each call, and events of the given families of its import inside its window, which are marked as context."""
    own = events.where("call_id IS NOT NULL").withColumn("is_context", F.lit(False))
    rest = events.where(F.col("family").isin(*families) & F.col("call_id").isNull()).drop("call_id")
    w = windows.select("import_id", "call_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    width = 3600 * SECOND
    w = w.withColumn("_k", F.explode(F.sequence(F.floor(micros("_a") / width), F.floor(micros("_b") / width))))
    met = rest.withColumn("_k", F.floor(micros("ts") / width)).join(w, ["import_id", "_k"]).where("ts >= _a AND ts <= _b")
    return own.unionByName(met.drop("_k", "_a", "_b").withColumn("is_context", F.lit(True)))


def evidence(ids: DataFrame, events: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of the ids with their metrics, the ids that no event has)."""
    m = metrics.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("metric", "value", "unit"))).alias("metrics"))
    return ids.join(events, "event_id").join(m, "event_id", "left"), ids.join(events, "event_id", "left_anti")


def call_signaling(sip: DataFrame, call_id: str) -> DataFrame:
    return sip.where(F.col("call_id") == call_id).select("ts", "direction", "method", "response", "title", "name", "line_no").orderBy("ts", "name", "line_no")


def perspective_listing(perspectives: DataFrame, versions: DataFrame, profiles: DataFrame, roles: DataFrame) -> DataFrame:
    """Perspectives with the app version at their start, profile, role and canonical duplicate."""
    rows = asof_latest(perspectives.withColumnRenamed("start", "ts"), versions, ["import_id"], ["version"]).withColumnRenamed("ts", "start").drop("seen")
    rows = rows.join(profiles, "import_id", "left").join(roles.select("perspective_id", "role"), "perspective_id", "left")
    return rows.withColumn("role", F.coalesce("role", F.lit("unknown")))


def peer_reception(intervals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both ways of each local perspective, as it receives them and as its peer does.

    ``pairs``: perspective_id, peer_id (NULL for none), role (app or gw). What the local side receives is
    downstream. Upstream is what the peer receives (``peer_local``), and only without a peer what the
    own reports say of it (``remote_rtcp``): a peer's gaps aren't filled from there. A gateway sees the
    ways the other way round.
    """
    own = intervals.join(pairs, "perspective_id")
    received = own.where("direction = 'incoming'").withColumns({"way": F.lit("downstream"), "basis": F.lit("local")})
    reported = own.where("direction = 'outgoing' AND peer_id IS NULL").withColumns({"way": F.lit("upstream"), "basis": F.lit("remote_rtcp")})
    theirs = pairs.where("peer_id IS NOT NULL").withColumnRenamed("perspective_id", "_local").withColumn("perspective_id", F.col("peer_id"))
    theirs = intervals.where("direction = 'incoming'").join(theirs, "perspective_id").withColumn("perspective_id", F.col("_local")).drop("_local").withColumns({"way": F.lit("upstream"), "basis": F.lit("peer_local")})
    rows = received.unionByName(reported).unionByName(theirs)
    swapped = F.when(F.col("way") == "upstream", "downstream").otherwise("upstream")
    return rows.withColumn("way", F.when(F.col("role") == "gw", swapped).otherwise(F.col("way"))).drop("peer_id", "role")


def metric_catalog(metrics: DataFrame) -> DataFrame:
    """The dictionary with the units that were seen; unknown names are kept as reported statistics of no confirmed meaning."""
    known = dictionary(metrics.sparkSession)
    seen = metrics.groupBy("metric").agg(F.array_sort(F.collect_set("unit")).alias("seen_units"), F.count("*").alias("samples"))
    out = known.join(seen, "metric", "full")
    unnamed = {"kind": "reported statistic", "domain": "unspecified", "rule": "unconfirmed"}
    return out.withColumns({"known": F.col("meaning").isNotNull(), "label": unit_label("unit"), "samples": F.coalesce("samples", F.lit(0)), **{c: F.coalesce(c, F.lit(x)) for c, x in unnamed.items()}})


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and imports that each domain's table has."""
    counts = [d.agg(F.count("*").alias("rows"), F.countDistinct("import_id").alias("imports")).withColumn("domain", F.lit(n)) for n, d in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def call_listing(calls: DataFrame, perspectives: DataFrame, metrics: DataFrame, mos: DataFrame, n: int | None = None) -> DataFrame:
    """Calls with perspectives, metrics, statuses, score and the first rejection; the newest ``n`` if asked for."""
    p = perspectives.groupBy("call_key").agg(F.count("*").alias("perspectives"), F.array_sort(F.collect_set("status")).alias("statuses"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("start"))).alias("rejection"))
    m = metrics.groupBy("call_key").agg(F.count("*").alias("metrics"))
    q = mos.groupBy("call_key").agg((F.sum(F.col("mos") * seconds()) / F.sum(seconds())).alias("mos"))
    out = calls.join(p, "call_key", "left").join(m, "call_key", "left").join(q, "call_key", "left").fillna(0, subset=["metrics"])
    return out.orderBy(F.col("start").desc(), "call_key").limit(n) if n else out


def mos_intervals(losses: DataFrame, perspectives: DataFrame, networks: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Scored holds of loss samples per perspective and series, clipped to the scope, cut by network."""
    rows = losses.drop("import_id").join(perspectives.select("perspective_id", "import_id", F.coalesce("connected", "start").alias("begin"), F.col("end").alias("stop")), "perspective_id")
    key = ["import_id", "perspective_id", "direction", "flow", "ssrc"]
    ok = F.col("valid") & (F.col("unit") == "%") & mos_score("value").isNotNull()
    held = hold_intervals(rows, key, valid=ok, begin="begin", stop="stop").withColumnRenamed("value", "loss").withColumn("mos", mos_score("loss"))
    if start is not None and end is not None:
        held = clip(held, start, end)
    held = held.withColumn("series", series_key(*key))
    return split_at_states(held, state_stamps(networks, ["import_id"], ["access"], valid=F.col("valid")), ["import_id"], ["access"])


def overlap_errors(intervals: DataFrame) -> DataFrame:
    """Intervals that overlap inside one series: an error of the input."""
    return overlaps_within(intervals, ["series"])


def mos_call_summary(intervals: DataFrame, perspectives: DataFrame) -> DataFrame:
    """Per call and direction, from the newest perspective that isn't a duplicate: mean, extremes (with their events, if intervals have an ``event_id``) and coverage; several streams or another role than the app's have none, with the reason."""
    newest = perspectives.where("duplicate_of IS NULL").groupBy("call_key").agg(F.max_by(F.struct("perspective_id", "role", F.coalesce("connected", "start").alias("a"), F.col("end").alias("b")), F.struct("import_seq", "perspective_id")).alias("p"))
    rows = newest.select("call_key", "p.*").join(intervals, "perspective_id", "left")
    s = seconds()
    ids = [F.min_by("event_id", F.struct("mos", "event_id")).alias("low_id"), F.max_by("event_id", F.struct("mos", -F.col("event_id"))).alias("high_id")] if "event_id" in rows.columns else []
    out = rows.groupBy("call_key", "direction").agg(F.first("role").alias("role"), F.countDistinct("flow", "ssrc").alias("streams"), (F.sum(F.col("mos") * s) / F.sum(s)).alias("mean"), F.min("mos").alias("low"), F.max("mos").alias("high"), F.sum(s).alias("covered"), F.first(seconds("a", "b")).alias("window"), *ids)
    reason = F.when(F.coalesce("role", F.lit("app")) != "app", "declared_role").when(F.col("streams") > 1, "several_streams").when(F.col("streams") == 0, "no_intervals")
    out = out.withColumns({"reason": reason, "coverage": 100 * F.col("covered") / F.nullif("window", F.lit(0.0))})
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("mean", "low", "high", "low_id", "high_id") if c in out.columns}).drop("window", "role")


def transient_summary(counters: DataFrame, notices: DataFrame, types: list[str], series: list[str], key: list[str], tolerance_us: int) -> DataFrame:
    """Per series and each type: ok intervals, those near a notice, those with an increase and a notice, those with an increase and none.

    Every interval is flagged once per type; a busy perspective multiplies no rows.
    """
    ok = counters.where("status = 'ok'").select(*series, F.col("previous_ts").alias("start"), F.col("ts").alias("end"), "delta").withColumn("_i", row_hash([*series, "start", "end"]))
    met = within_tolerance_join(notices.select(*key, "ts", "type"), ok, key, tolerance_us).select("_i", "type").distinct().withColumn("_near", F.lit(True))
    rows = ok.withColumn("type", F.explode(F.array(*[F.lit(t) for t in types]))).join(met, ["_i", "type"], "left")
    near, up = F.col("_near").isNotNull(), F.col("delta") > 0
    return rows.groupBy(*series, "type").agg(F.count("*").alias("intervals"), F.count_if(near).alias("with_notice"), F.count_if(near & up).alias("positive_with"), F.count_if(~near & up).alias("positive_without"))


def transient_coverage(perspectives: DataFrame, notices: DataFrame) -> DataFrame:
    n = notices.groupBy("perspective_id").agg(F.count("*").alias("notices"), F.countDistinct("name").alias("files"))
    return perspectives.select("perspective_id").join(n, "perspective_id", "left").fillna(0)


def initial_observations(counters: DataFrame, creations: DataFrame, key: list[str]) -> DataFrame:
    """First counter values with the latest creation before them: the value grew since then at the earliest."""
    first = counters.where("status = 'initial' AND valid")
    return asof_latest(first, creations, key, ["device"]).withColumnRenamed("seen", "created")


def with_call_edges(notices: DataFrame, perspectives: DataFrame) -> DataFrame:
    """Notices and the synthetic ones of a call's connection and end."""
    edges = perspectives.select("perspective_id", "import_id", F.explode(F.array(F.struct(F.col("connected").alias("ts"), F.lit("call_connected").alias("type")), F.struct(F.col("end").alias("ts"), F.lit("call_ended").alias("type")))).alias("e"))
    edges = edges.select("perspective_id", "import_id", "e.*").where("ts IS NOT NULL")
    return notices.unionByName(edges, allowMissingColumns=True)


def transients_to_calls(notices: DataFrame, perspectives: DataFrame, signature: list[str], row_id: str) -> DataFrame:
    """Notices with their calls (copies are one row), and the synthetic ones of the calls' edges, which no proof stands for."""
    placed = notices_to_calls(notices, perspectives, signature, row_id)
    edges = with_call_edges(perspectives.limit(0).select("perspective_id", "import_id"), perspectives).withColumn("proofs", F.lit(0).cast("long"))
    return placed.unionByName(edges, allowMissingColumns=True)


def transient_inventory(notices: DataFrame) -> DataFrame:
    """Occurrences by platform, file family, type and detail, with the first proof."""
    return notices.groupBy("platform", "family", "type", "detail").agg(F.count("*").alias("occurrences"), F.min_by(F.struct("name", "line_no"), F.struct("ts", "name", "line_no")).alias("first"))


def mobility_summary(movement: DataFrame, networks: DataFrame) -> DataFrame:
    """Sequences and samples of an import, and its distinct operators."""
    m = movement.groupBy("import_id").agg(F.countDistinct("part").alias("sequences"), F.count("*").alias("samples"))
    operators = networks.select("import_id", F.col("sim_operator").alias("o")).union(networks.select("import_id", "serving_operator")).where("o IS NOT NULL").distinct()
    return m.join(operators.groupBy("import_id").agg(F.count("*").alias("operators")), "import_id", "left").fillna(0)


def tag_lifecycle(samples: DataFrame, creations: DataFrame, ts: str = "ts") -> DataFrame:
    """Samples with the latest creation of their output and of their input device."""
    out = samples
    for name in ("output_device", "input_device"):
        made = creations.select("import_id", F.col("device").alias(name), "ts", F.col("event_id").alias(f"{name}_created"))
        out = asof_latest(out, made, ["import_id", name], [f"{name}_created"], ts).drop("seen")
    return out


def shifted(df: DataFrame, offset_us: Column, ts: str = "ts") -> DataFrame:
    """``df`` with its times moved."""
    return df.withColumn(ts, from_micros(micros(ts) + offset_us))


def on_one_clock(a: DataFrame, b: DataFrame, offset_us: int) -> DataFrame:
    """The rows of both sides, b's moved by the offset, with their ``side``."""
    return a.withColumn("side", F.lit("a")).unionByName(shifted(b, F.lit(offset_us)).withColumn("side", F.lit("b")))


def aligned_lanes(events: DataFrame, bounds: DataFrame, key: list[str], offset_us: Column, start: Column | None = None, end: Column | None = None, ttl_us: int = 30 * SECOND, most_us: int | None = 86_400 * SECOND) -> DataFrame:
    """The connectivity lanes of several perspectives on one clock, each between its call's edges and inside [start, end) of that clock.

    ``events``: key, ts, ord, layer, state (and what else lanes carry); ``bounds``: key, start, end of the
    perspectives. One that isn't known to end ends with its last event. ``offset_us`` is the key's distance
    to the common clock. Perspectives without any time inside, or with more than ``most_us`` of it, have no
    lanes, nor have those whose key is NULL. What was said before an edge holds inside, as long as it
    holds at all.
    """
    moved = shifted(events, offset_us)
    bounds = bounds.dropna(subset=key)
    last = moved.groupBy(*key).agg(F.max(micros("ts")).alias("_last"))
    edges = bounds.select(*key, (micros("start") + offset_us).alias("_a"), (micros("end") + offset_us).alias("_b")).join(last, key, "left")
    edges = edges.withColumn("_b", F.coalesce("_b", "_last"))
    for c, pick, edge in (("_a", F.greatest, start), ("_b", F.least, end)):
        if edge is not None:
            edges = edges.withColumn(c, F.when(F.col(c).isNotNull(), pick(c, micros(edge))))
    edges = edges.where("_a < _b")
    if most_us is not None:
        edges = edges.where(F.col("_b") - F.col("_a") <= most_us)
    spans = edges.select(*key, from_micros("_a").alias("begin"), from_micros("_b").alias("stop"))
    return connectivity_timeline(moved.join(spans.select(*key), key, "left_semi"), spans, key, ttl_us)


def peaks(both: DataFrame, limit: float) -> DataFrame:
    """The greatest valid value of each side and metric (of equal ones the earliest), and whether it passes a limit."""
    best = F.struct("value", -micros("ts"))
    return both.where("valid").groupBy("side", "metric", "unit").agg(F.max("value").alias("peak"), F.max_by("ts", best).alias("peak_ts"), F.count("*").alias("samples")).withColumn("over", F.col("peak") > limit)


def worst_cells(cells: DataFrame, n: int, value: str = "mean", least_seconds: float = 0.0) -> DataFrame:
    """The ``n`` cells with the lowest mean that were observed for at least ``least_seconds``; of equal ones the longer observed."""
    return cells.where(F.col("seconds") >= least_seconds).orderBy(F.col(value), F.col("seconds").desc(), "cell").limit(n)


def metric_summary(metrics: DataFrame, key: list[str]) -> DataFrame:
    """Valid samples with their extremes and mean, and the number of invalid ones, per key."""
    ok = F.when(F.col("valid"), F.col("value"))
    return metrics.groupBy(*key).agg(F.count(ok).alias("samples"), F.min(ok).alias("low"), F.avg(ok).alias("mean"), F.max(ok).alias("high"), F.count_if(~F.col("valid")).alias("invalid"))


def metric_inventory(metrics: DataFrame, key: list[str], of: str) -> DataFrame:
    """Samples and distinct ``of`` per key."""
    return metrics.groupBy(*key).agg(F.count("*").alias("samples"), F.countDistinct(of).alias("sources"))


def search_events(events: DataFrame, text: str | None = None, equal: dict[str, object] | None = None, start: Column | None = None, end: Column | None = None, least_severity: int | None = None) -> DataFrame:
    """Events whose text holds ``text`` (letters of either case), whose columns equal the given values, inside [start, end), of at least a severity.

    ``equal`` takes any of the columns (import_id, name, parser, line_id, call_id, level and so on); None fits nulls.
    """
    rows = events
    if text is not None:
        rows = rows.where(F.contains(F.lower("text"), F.lit(text.lower())))
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") < end)
    if least_severity is not None:
        rows = rows.where(severity("level") >= least_severity)
    return rows


def severity(level: Column | str) -> Column:
    """0 for debug up to 5 for fatal; NULL for an unknown level."""
    levels = {"DEBUG": 0, "INFO": 1, "NOTICE": 2, "WARN": 3, "WARNING": 3, "ERROR": 4, "FATAL": 5}
    return mapped(levels, F.upper(F.col(level) if isinstance(level, str) else level))


def search_calls(calls: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Calls any of whose columns holds ``text`` (letters of either case; no wildcards)."""
    hit = reduce(Column.__or__, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in columns])
    return calls.where(hit)


def with_and_without(left: DataFrame, right: DataFrame, key: list[str], column: str = "has") -> DataFrame:
    """``left`` with whether ``right`` has its key: a semi and an anti join, nothing is multiplied."""
    keys = right.select(*key)
    return left.join(keys, key, "left_semi").withColumn(column, F.lit(True)).unionByName(left.join(keys, key, "left_anti").withColumn(column, F.lit(False)))


def union_sources(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The rows of several tables with the name of their table."""
    return reduce(DataFrame.unionByName, [d.select(*columns).withColumn("source", F.lit(n)) for n, d in tables.items()])


def missing_ids(asked: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """The ids that were asked for and aren't there."""
    return asked.select(column).distinct().join(known.select(column), column, "left_anti")
