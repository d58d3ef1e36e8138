"""Whole jobs: from archives to tables, and the reports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import elapsed_seconds, from_micros, micros, mos_score, series_key
from ..operators import attempts as U
from ..operators import calls as C
from ..operators import extract as X
from ..operators import geo as G
from ..operators import incidents as N
from ..operators import joins as J
from ..operators import marks as M
from ..operators import network as K
from ..operators import telemetry as T
from ..operators import windows as W
from ..sources import archives as A
from ..sources.staging import staged
from . import listings as L
from . import reports as R


def build_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the archives below ``path``: files, events, metrics, perspectives, calls and the extracted domains."""
    files = A.read_archives(spark, path).withColumn("parser", A.classify_file("name"))
    return tables_of(files)


# What engine logs say of the legs of a line.
LEG_SENTENCES = [
    ("added", "added to the call list"),
    ("connected", "status changed to 1"),
    ("ended", "removed from list"),
    ("ended", "call terminated"),
    ("summary", "Info about call finished on line"),
]


def lifecycle_of(records: DataFrame) -> DataFrame:
    """What engine logs say of the legs of a line: added, connected, ended, and the summary with its Call-ID."""
    text = F.col("text")
    event = F.coalesce(*[F.when(text.contains(said), event) for event, said in LEG_SENTENCES])
    line = F.coalesce("line_id", X.group(X.first_line(), X.sentence("on line {d}")).cast("int"))
    call_id = F.nullif(F.get_json_object(F.regexp_extract("text", r"(?s)(\{.*\})", 1), "$.callInfo.call-id"), F.lit(""))
    rows = records.where("parser = 'kpe' AND ts IS NOT NULL").where(event.isNotNull())
    return rows.select("import_id", line.alias("line_id"), "ts", F.col("line_no").alias("ord"), event.alias("event"), call_id.alias("call_id")).where("line_id IS NOT NULL")


def callinfo_of(records: DataFrame) -> DataFrame:
    """Connections and terminations of lines that call information files name."""
    event = F.when(F.col("text").contains("connected line id:"), "connected").when(F.col("text").contains("terminated line id:"), "terminated")
    return records.where("parser = 'callinfo' AND ts IS NOT NULL AND line_id IS NOT NULL").where(event.isNotNull()).select("import_id", "line_id", "ts", F.col("line_no").alias("ord"), event.alias("event"))


def tables_of(files: DataFrame, held: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of files (import_id, name, parser, text, warning).

    Events carry the Call-ID that they name and the perspective that owns them; what is extracted
    from an event carries both on. Observations that an import repeats count once, perspectives
    that the same producer brought before are marked, and the sequence of imports is that of
    their first event. Records and owned events are laid out by what extractors have to read (``marks``). Records, perspectives and owned events are written on the way, because
    everything after them reads them again.

    ``held`` (producer, call_id): calls that tables of earlier archives have. What the same
    producer brings of them again is left out, with the rows that are theirs alone.
    """
    good = files.where("warning IS NULL").select("import_id", "name", "parser", "text")
    records = X.flag_rotation_duplicates(X.parse_level_line(X.split_records(good)))
    records = staged(M.with_marks(records.withColumn("event_id", F.xxhash64("import_id", "name", "line_no"))), by="marks")
    live = records.where("NOT duplicate")
    sip = staged(X.decode_sip(M.marked(live, "sip")).withColumn("ord", F.col("line_no")))
    of_legs = M.marked(live, "legs")
    legs = C.reconstruct_legs(lifecycle_of(of_legs))
    legs = staged(legs.unionByName(C.callinfo_legs(callinfo_of(of_legs), legs), allowMissingColumns=True))
    every = legs.unionByName(C.sip_only_legs(sip, legs).select("import_id", "call_id", "start"), allowMissingColumns=True)
    perspectives = C.build_perspectives(every, sip)
    perspectives = perspectives.withColumn("perspective_id", J.row_hash(["import_id", "call_id", *[c for c in ("line_id", "leg", "start")]])).withColumn("call_key", C.call_key(perspectives))
    order = live.where("ts IS NOT NULL").groupBy("import_id").agg(F.struct(F.min("ts"), "import_id").alias("import_seq"))
    producers = staged(X.producer_identity(X.identity_markers(good, M.marked(live, "producers"))))
    perspectives = staged(C.mark_duplicates(perspectives.join(order, "import_id", "left"), producers.select("import_id", "status", "producer")))
    dated = live.where("ts IS NOT NULL").withColumn("call_id", X.call_id_of("text"))
    owned = C.attribute_events(dated, perspectives)
    if held is not None:
        every, perspectives = perspectives, staged(C.skip_known_calls(perspectives, held))
        skipped = staged(every.join(perspectives.select("perspective_id"), "perspective_id", "left_anti"))
        owned = C.drop_known_events(staged(owned), skipped)
    owned = staged(owned.withColumnRenamed("owner", "perspective_id"), by="marks")
    of = lambda *names: M.marked(owned, *names)
    made = [X.extract_rtcp(of("rtcp")), X.extract_flow_stats(of("flow_stats")), X.extract_ping(of("ping")), X.extract_device_metrics(of("devices", "rtcp")).drop("offset", "device"), X.extract_missing_packets(of("gaps")).drop("offset", "device", "current_sn")]
    metrics = made[0]
    for more in made[1:]:
        metrics = metrics.unionByName(more, allowMissingColumns=True)
    periodic, states = X.extract_periodic(of("devices")), X.extract_periodic_states(of("devices", "rtcp"))
    if held is not None:  # of blocks that stay, the values of known calls' lines go
        numbered = lambda df: staged(df.withColumn("_n", F.monotonically_increasing_id()))
        metrics, periodic, states = (C.drop_known_rows(numbered(df), skipped, perspectives, "_n").drop("_n") for df in (metrics, periodic, states))
    signature = ["import_id", "ts", "metric", "direction", "flow", "ssrc", "statistic", "value"]
    return {
        "files": A.file_coverage(records),
        "profiles": X.source_profile(good, M.marked(live, "info")),
        "producers": producers,
        "events": owned.drop("marks"),
        "metrics": C.dedup_metrics(metrics, signature, ["name", "line_no"]),
        "periodic": periodic,
        "periodic_states": states,
        "perspectives": perspectives,
        "calls": C.build_calls(perspectives),
        "identities": X.identity_candidates(sip),
        "uuids": X.extract_call_uuid(sip),
        "outcomes": X.extract_leg_outcome(sip),
        "versions": X.extract_app_versions(M.marked(live, "versions")),
        "positions": X.extract_positions(of("positions")),
        "config_positions": X.extract_config_positions(M.marked(live, "config_positions")),
        "networks": X.extract_network_obs(of("networks")),
        "connectivity": X.extract_connectivity(of("connectivity")),
        "transients": X.extract_transients(of("transients")),
        "switches": X.extract_network_switches(of("switches")),
        "signals": X.extract_incident_signals(of("signals")),
        "attempts": U.user_attempts(U.attempt_lines(of("attempts"))).join(order, "import_id", "left"),
    }


def mos_report(losses: DataFrame, perspectives: DataFrame, networks: DataFrame, threshold: float = 3.0) -> dict[str, DataFrame]:
    """Scored intervals, bad episodes, and summaries per series, receiver and network."""
    rows = L.mos_intervals(losses, perspectives, networks)
    return {
        "intervals": rows,
        "episodes": W.bad_episodes(rows, ["perspective_id", "series"], F.col("mos") < threshold),
        "series": R.series_summary(rows, ["perspective_id", "series"], threshold),
        "receivers": R.receiver_ranking(rows, ["import_id"], "perspective_id", threshold),
        "networks": R.network_breakdown(rows, ["access"], threshold=threshold),
    }


def mos_of_tables(tables: dict[str, DataFrame], threshold: float = 3.0) -> dict[str, DataFrame]:
    """The report over the tables of archives: losses that a perspective owns."""
    losses = tables["metrics"].where("metric = 'rtcp.loss' AND perspective_id IS NOT NULL")
    networks = tables["networks"].select("import_id", "ts", "access").withColumn("valid", F.lit(True))
    return mos_report(losses, tables["perspectives"], networks, threshold)


def movement_of(positions: DataFrame) -> DataFrame:
    """Sequences of the fresh fixes of each import; times with contradicting or invalid fixes break them."""
    fresh = positions.where("kind = 'fresh'")
    first = fresh.groupBy("import_id", "ts").agg(F.min_by(F.struct("elapsed", "accuracy"), F.struct("name", "line_no", "offset")).alias("_f"))
    fixes = G.fix_stamps(fresh, ["import_id"]).drop("accuracy").join(first, ["import_id", "ts"])
    fixes = fixes.select("import_id", micros("ts").alias("t_us"), "ok", "latitude", "longitude", "_f.accuracy", "_f.elapsed", elapsed_seconds("_f.elapsed").alias("elapsed_s"))
    return K.movement_sequences(fixes)


def conversations_of(uuids: DataFrame, perspectives: DataFrame, manual: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Groups of calls over all archives, with each call's first start."""
    starts = perspectives.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("start").alias("start"))
    return C.conversation_groups(uuids.select("uuid", "call_id").distinct().join(starts, "call_id", "left"), perspectives, manual, sessions)


def attempt_report(tables: dict[str, DataFrame], families: list[str], roles: DataFrame | None = None) -> dict[str, DataFrame]:
    """Attempts of users over the tables of archives, once for each source with ``copies`` counted; what proves them and what the log ``families`` say around them; how many were blocked.

    ``roles``: import_id, role of perspectives, where they are declared.
    """
    once = U.attempts_once(U.source_of(tables["attempts"], tables["producers"], roles)).withColumn("attempt_id", F.col("event_id"))
    events = tables["events"].withColumn("family", A.file_family("name"))
    return {
        "attempts": once,
        "context": U.attempt_context(events, once, families),
        "statuses": once.groupBy("source", "status").agg(F.count("*").alias("attempts"), F.sum("copies").alias("observations")),
    }


def with_lifecycles(signals: DataFrame, creations: DataFrame) -> DataFrame:
    """``signals`` (import_id, t_us, observer, device) with the latest creation (import_id, device, ts, event_id) of the device that is observed and of the one that is read."""
    name = F.regexp_replace("observer", r"^AWT - ", "")
    rows = signals.withColumns({"ts": from_micros("t_us"), "output_device": F.when(name == "AWT", "Default Audio Output").otherwise(name), "input_device": F.col("device")})
    return L.tag_lifecycle(rows, creations).drop("ts", "output_device", "input_device")


def incident_report(signals: DataFrame, bounds: DataFrame, perspectives: DataFrame, key: list[str], width_us: int, mode: str = "reported_end", samples: DataFrame | None = None, creations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Episodes, their windows, sums of the calls and, with the ``samples`` of readers, where their absence can be told.

    With ``creations`` of devices an episode belongs to the devices as they were then: one that is created again closes none.
    """
    if creations is None:
        episodes = N.reconstruct_incidents(signals, key)
    else:
        made = ["output_device_created", "input_device_created"]
        episodes = N.reconstruct_incidents(with_lifecycles(signals, creations), [*key, *made])
    placed = N.place_incidents(episodes, mode)
    out = {"episodes": placed, "windows": N.incident_windows(placed, bounds, key, width_us), "calls": N.incident_call_summary(placed, perspectives, key)}
    return out if samples is None else out | {"coverage": N.incident_coverage(perspectives, placed, samples)}


def transient_report(samples: DataFrame, notices: DataFrame, series: list[str], key: list[str], types: list[str], tolerance_us: int, perspectives: DataFrame | None = None, creations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Counter intervals and how their increases meet notices; with ``perspectives`` the edges of their calls are notices, too."""
    counters = W.counter_intervals(samples, series, ["ord"])
    out = {"counters": counters}
    if perspectives is not None:
        notices = L.with_call_edges(notices, perspectives)
        out["coverage"] = L.transient_coverage(perspectives, notices)
    if creations is not None:
        out["initial"] = L.initial_observations(counters, creations, key)
    return out | {"summary": L.transient_summary(counters, notices, types, series, key, tolerance_us), "inventory": L.transient_inventory(notices)}


def geo_report(intervals: DataFrame, positions: DataFrame, metres: float, context: list[str], evidence: list[str] | None = None) -> dict[str, DataFrame]:
    """Located intervals without copies, and their cells, networks and calendar.

    Copies of one observation, in whichever imports, have one signature (``evidence``, see
    ``geo.lineage``) and count once; where they contradict each other in place or score they don't
    count. Intervals of a call (``call_id``) at positions with a ``kind`` are located twice: at fresh fixes,
    and at fresh and the call's declared ones (``quality`` fresh and declared).
    """
    if "kind" in positions.columns and "call_id" in intervals.columns:
        sets = {"fresh": (positions.where("kind = 'fresh'").drop("call_id"), ["import_id"]), "declared": (G.declared_positions(positions, intervals, "call_id"), ["import_id", "call_id"])}
    else:
        sets = {"all": (positions, ["import_id"])}
    found = None
    for quality, (fixes, key) in sets.items():
        located = G.locate_intervals(intervals, fixes, key, evidence=evidence).withColumn("quality", F.lit(quality))
        found = located if found is None else found.unionByName(located)
    apart = found.withColumn("signature", F.struct("quality", "signature"))  # a set of fixes contradicts itself alone
    rows = G.canonical_intervals(apart, ["latitude", "longitude", "mos"], context).withColumns({"quality": F.col("signature.quality"), "signature": F.col("signature.signature")})
    rows = rows.withColumn("cell", G.grid_cell("latitude", "longitude", metres))
    by_cell = R.cell_summary(rows.withColumn("_c", F.struct("quality", "cell")), "_c")
    cells = by_cell.select("_c.quality", "_c.cell", *[c for c in by_cell.columns if c != "_c"])
    return {"intervals": rows, "cells": cells, "networks": R.network_breakdown(rows, ["quality", *context]), "profile": R.temporal_profile(rows, ["quality", "cell"], "mos")}


def pq_map(episodes: DataFrame, calls: DataFrame, series: list[str], fixes: DataFrame, metres: float) -> dict[str, DataFrame]:
    """Continuity per cell, direct and estimated, and the routes of the calls with their seconds' scores."""
    pq = N.pq_windows(episodes, calls, series)
    cells = G.pq_cells_estimated(G.route_samples(fixes, pq), G.pq_cells_direct(fixes.where("ok"), pq, metres), metres)
    cached = fixes if "cached" in fixes.columns else fixes.withColumn("cached", F.lit(False))
    return {"cells": cells, "route": G.route_points(cached, pq, calls, metres)}


def connectivity_report(records: DataFrame, bounds: DataFrame) -> DataFrame:
    """The lanes of every import between its bounds, from what its records prove."""
    events = X.extract_connectivity(records).withColumn("ord", F.col("line_no"))
    return K.connectivity_timeline(events, bounds, ["import_id"])


def connectivity_job(records: DataFrame, bounds: DataFrame, windows: DataFrame, positions: DataFrame) -> dict[str, DataFrame]:
    """Lanes whose segments name the records behind them (``event_id``), and the switch requests of the same imports."""
    events = X.extract_connectivity(records).withColumns({"ord": F.col("line_no"), "evidence_id": F.col("event_id")})
    return {"lanes": K.connectivity_timeline(events, bounds, ["import_id"]), "switches": switch_report(records, windows, positions)}


def switch_report(records: DataFrame, windows: DataFrame, positions: DataFrame, context: dict[str, str] | None = None) -> DataFrame:
    """Switch requests with their call, the transition that is declared near them, and the place between fixes.

    ``context`` keeps those whose columns fit, from_state or to_state for example.
    """
    text = records.select("import_id", "name", "line_no", X.first_line().alias("text"))
    asked = X.extract_network_switches(records).join(text, ["import_id", "name", "line_no"]).withColumn("request_id", F.xxhash64("import_id", "name", "line_no"))
    rest = [c for c in asked.columns if c not in ("import_id", "ts", "text")]
    once = asked.groupBy("import_id", "ts", "text").agg(F.min_by(F.struct(*rest), F.struct("name", "line_no")).alias("_r"), F.count("*").alias("proofs"))
    once = once.select("import_id", "ts", "text", "_r.*", "proofs")  # copies of one request are one, with all proofs counted
    states = X.extract_network_obs(records).select("import_id", "ts", F.col("access").alias("state"))
    seen = K.nearby_transition(once, states, ["import_id"])
    called = K.notices_to_calls(once, windows, ["request_id"], "request_id").select("request_id", "perspective_id", "call_id")
    fixes = G.fix_stamps(positions, ["import_id"])
    return J.bracket_interpolate(seen.drop("perspective_id", "call_id"), fixes, ["import_id"], ["latitude", "longitude"]).join(called, "request_id", "left").where(K.matches(context or {}))


def compare_ab(a: DataFrame, b: DataFrame, offset_us: int, limit: float, signals: DataFrame | None = None, versions: DataFrame | None = None, connectivity: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Two perspectives' samples (metric, unit, ts, ord, value, valid) on one aligned clock.

    peaks: of each side and metric. counters: increases between neighbouring samples of each side.
    together: the sum of both, where both are known. With ``signals`` (side, phase, t_us,
    duration_ms) their incidents, with ``versions`` (side, ts, version) each sample's version, with ``connectivity`` (events and bounds by
    side, see ``listings.aligned_lanes``) the lanes of both sides.
    """
    both = L.on_one_clock(a, b, offset_us)
    out = {
        "peaks": L.peaks(both, limit),
        "counters": W.counter_deltas(both, ["side", "metric"], ["ord"]).select("side", "metric", "previous_ts", "ts", "delta"),
        "together": J.series_sum_interpolated(*[both.where(F.col("valid") & (F.col("side") == s)).groupBy("metric", "ts").agg(F.max("value").alias("value")) for s in "ab"], ["metric"]),
    }
    if signals is not None:
        moved = signals.withColumn("t_us", F.col("t_us") + F.when(F.col("side") == "b", offset_us).otherwise(0))
        out["incidents"] = N.reconstruct_incidents(moved, ["side"])
    if versions is not None:
        moved = L.shifted(versions, F.when(F.col("side") == "b", offset_us).otherwise(0))
        out["versions"] = J.asof_latest(both, moved, ["side"], ["version"]).drop("seen")
    if connectivity is not None:
        out["lanes"] = L.aligned_lanes(*connectivity, ["side"], F.when(F.col("side") == "b", offset_us).otherwise(0))
    return out


def telemetry_job(lines: DataFrame, order: list[str], semantics: tuple[str, ...] = ("rtp-sequence-window/1",)) -> dict[str, DataFrame]:
    """Validated, canonical records with the guards of their clock domains, and what follows from the usable ones.

    intervals: loss of media windows and of consecutive receiver reports, windows before reports
    where they overlap; refused: those that give none, with their issues; reused: windows whose sequence numbers
    another one uses, too (neither counts); places: intervals at fixes with their access; plans:
    references to plans with their issues; references: of every event that refers to a request, plan, position or
    configuration, what isn't declared then.
    """
    checked = staged(T.validate_telemetry(lines))
    good = checked.where(F.size("issues") == 0).drop("issues")
    canonical = T.telemetry_canonical(good, order)
    records = staged(T.clock_guards(canonical.where("NOT conflict")))
    fit = (F.col("validity") == "valid") & (F.size(F.array_except("issues", F.array(F.lit("sequence_gap")))) == 0)
    usable = records.where(fit)
    windows = T.media_intervals(T.media_records(usable), T.config_records(usable), T.gap_records(usable), list(semantics))
    again = T.reused_sequences(windows.where("loss IS NOT NULL"), [*T.DOMAIN, "stream_id", "counter_epoch"]).where("reused").select(*T.DOMAIN, "stream_id", "start_ms", "end_ms")
    again = staged(again.withColumns({"direction": F.lit("local_receive"), "method": F.lit("media_window")}).distinct())
    reports = T.rtcp_intervals(T.rtcp_records(usable), [*T.DOMAIN, "stream_id", "transport_direction"])
    every = windows.select(*T.DOMAIN, "stream_id", F.lit("local_receive").alias("direction"), F.lit("media_window").alias("method"), "start_ms", "end_ms", "loss", "issues")
    way = F.when(F.col("transport_direction") == "sent", "local_receive").otherwise("local_send")
    every = every.unionByName(reports.select(*T.DOMAIN, "stream_id", way.alias("direction"), F.lit("rtcp").alias("method"), "start_ms", "end_ms", "loss", F.array_compact(F.array("issue")).alias("issues")))
    every = staged(every)
    scored = every.where("loss IS NOT NULL").drop("issues")
    key = [*T.DOMAIN, "stream_id", "direction"]
    once = [*key, "method", "start_ms", "end_ms"]
    again = again.hint("merge")  # intervals are small as files and large in memory: neither side is broadcast
    kept = scored.join(T.suppress_overlaps(scored.select(*once), key).hint("merge"), once, "left_semi").join(again, once, "left_anti")
    fixes, networks = T.fix_records(usable), T.network_records(usable)
    return {
        "invalid": checked.where(F.size("issues") > 0),
        "records": records,
        "conflicts": canonical.where("conflict"),
        "intervals": kept.withColumn("series", series_key(*key)),
        "refused": every.where("loss IS NULL"),
        "places": G.telemetry_places(kept, fixes, networks, T.DOMAIN),
        "reused": scored.join(again, once, "left_semi"),
        "plans": T.plan_audit(T.plan_references(usable), T.plan_records(usable)),
        "references": T.audit_references(T.referring(records), T.declared(records.withColumn("usable", fit))),
    }


def telemetry_mos(records: DataFrame, intervals: DataFrame) -> DataFrame:
    """Telemetry intervals as scored ones on the wall clock beside those of logs: domain, series, start, end, loss and mos.

    The wall clock of a domain is the least difference of its records' observed and monotonic times.
    """
    observed = micros(F.to_timestamp("observed_utc").cast("timestamp_ntz"))
    zero = records.groupBy(*T.DOMAIN).agg(F.min(observed - F.round(F.col("mono_ms") * 1000).cast("long")).alias("zero_us"))
    at = lambda ms: from_micros(F.col("zero_us") + F.round(F.col(ms) * 1000).cast("long"))
    rows = intervals.join(zero, T.DOMAIN)
    return rows.select(*T.DOMAIN, "series", at("start_ms").alias("start"), at("end_ms").alias("end"), "loss", mos_score("loss").alias("mos"))
