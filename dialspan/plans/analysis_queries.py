"""Queries of joins by time, incidents, lanes, places, telemetry, listings and jobs, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calls as C
from ..operators import geo as G
from ..operators import incidents as N
from ..operators import joins as J
from ..operators import network as K
from ..operators import telemetry as T
from ..operators import windows as W
from ..sources.staging import new_path
from ..streaming import jobs as streams
from . import jobs as Z
from . import listings as L
from . import reports as R
from .core_queries import HOUR, MINUTE, read
from .dictionary import entries
from .log_queries import rendered

SECOND = 1_000_000
BASE_US = 1_704_067_200_000_000  # 2024-01-01, when the events begin


def events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin(*types)) if types else e


def squeezed(spark: SparkSession, sf_dir: str, by: int = 1000) -> DataFrame:
    """Events a thousand times as dense, so that seconds are what hours were: event_id, user_id, event_type, value, t_us and ts."""
    t = F.floor((S.micros("ts") - BASE_US) / by) + BASE_US
    return read(spark, sf_dir, "events").withColumn("t_us", t).withColumn("ts", S.from_micros("t_us"))


SQUEEZED = f"q AS (SELECT event_id, user_id, event_type, value, CAST(floor((epoch_us(ts) - {BASE_US}) / 1000.0) AS BIGINT) + {BASE_US} AS t FROM events)"


def as_time(us: str) -> str:
    return f"(TIMESTAMP '1970-01-01' + to_microseconds({us}))"


# --- joins by time ------------------------------------------------------------------------


def j3_position_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = events(spark, sf_dir, "view").select("user_id", "ts", (F.col("event_id") / 1000).alias("latitude"), F.col("user_id").cast("double").alias("longitude"), F.lit(5.0).alias("accuracy"), (F.col("event_id") % 11 > 0).alias("valid"))
    return G.position_at(events(spark, sf_dir, "purchase").select("user_id", "ts", "event_id"), fixes, ["user_id"], most_us=24 * HOUR).select("event_id", "latitude", "longitude")


def j9_series_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (events(spark, sf_dir, t).select("user_id", "ts", "value") for t in ("click", "view"))
    return J.series_sum_interpolated(a, b, ["user_id"], most_us=72 * HOUR).select("user_id", "ts", F.round("value", 3).alias("value"))


def j10_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = events(spark, sf_dir, "error").select("user_id", "ts", F.col("event_id").alias("request_id"))
    states = events(spark, sf_dir, "click", "view").select("user_id", "ts", F.floor(F.col("value") / 20).cast("string").alias("state"))
    return K.nearby_transition(asked, states, ["user_id"], 12 * HOUR, 18 * HOUR).select("request_id", "from_state", "to_state")


def j11_reception(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("perspective_id"), F.when(F.col("event_id") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), "event_id")
    pairs = events(spark, sf_dir).select(F.col("user_id").alias("perspective_id"), F.when(F.col("user_id") % 3 == 0, F.col("user_id") + 1).alias("peer_id"), F.when(F.col("user_id") % 5 == 0, "gw").otherwise("app").alias("role")).distinct()
    return L.peer_reception(e, pairs).select("perspective_id", "event_id", "way", "basis")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "view").select(F.col("user_id").cast("string").alias("import_id"), F.col("event_id").alias("perspective_id"), F.concat(F.lit("c"), "event_id").alias("call_id"), F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(8), F.col("ts")).alias("end"), F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("connected"))


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and clicks of the hour as notices; copies have one time and text; every eighth has a view's perspective of its own."""
    e = events(spark, sf_dir, "error", "click")
    return e.select(F.col("user_id").cast("string").alias("import_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("type"), "event_id", F.when(F.col("event_id") % 8 == 0, F.col("event_id") + 1).alias("perspective_id"))


def j13_switches_to_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.notices_to_calls(_notices(spark, sf_dir), _windows(spark, sf_dir), ["import_id", "ts", "type"], "event_id")


def j14_transients_to_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.transients_to_calls(_notices(spark, sf_dir).drop("perspective_id"), _windows(spark, sf_dir), ["import_id", "ts", "type"], "event_id")
    return out.select("import_id", "ts", "type", "perspective_id", "proofs")


def w6_movement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense fixes with barriers, gaps and jumps, and an elapsed time that runs back at times."""
    q = squeezed(spark, sf_dir)
    fixes = q.select(F.col("user_id").cast("string").alias("import_id"), "t_us", (F.col("event_id") % 13 > 0).alias("ok"), (45 + F.col("value") / 20000).alias("latitude"), F.lit(9.0).alias("longitude"), F.lit(5.0).alias("accuracy"), F.lit(None).cast("string").alias("elapsed"), (F.col("event_id") % 50).cast("double").alias("elapsed_s"))
    out = K.movement_sequences(fixes, gap_us=60 * SECOND)
    return out.select("import_id", "t_us", "part", "ordinal", "reason")


def c8_kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows more than a day after the last row of their user that was kept."""
    return C.dedup_within_gap(events(spark, sf_dir).select("user_id", "ts", "event_id"), ["user_id"], gap_us=24 * HOUR).select("user_id", "event_id")


# --- incidents ----------------------------------------------------------------------------


def _signals(spark: SparkSession, sf_dir: str, reported: bool = False) -> DataFrame:
    e = events(spark, sf_dir, "error", "purchase")
    length = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), F.col("value") * 1000) if reported else F.lit(None)
    return e.select("user_id", F.when(F.col("event_type") == "error", "start").otherwise("end").alias("phase"), S.micros("ts").alias("t_us"), length.cast("double").alias("duration_ms"))


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "error", "purchase")
    return e.groupBy("user_id").agg(S.micros(F.min("ts")).alias("anchor_us"), (S.micros(F.max("ts")) + 1).alias("stop_us")).withColumn("begin_us", F.col("anchor_us"))


def i8_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.reconstruct_incidents(_signals(spark, sf_dir, True), ["user_id"])
    return out.select("user_id", "start_us", "end_us", F.round("duration_ms", 3).alias("duration_ms"), "duration_basis", "start_basis", "status")


def i9_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = N.reconstruct_incidents(_signals(spark, sf_dir, True), ["user_id"])
    both = [N.place_incidents(e, m).select("user_id", "start_us", "status", F.lit(m).alias("mode"), "a_us", "b_us") for m in ("log_span", "reported_end")]
    return both[0].unionByName(both[1])


def i10_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = N.place_incidents(N.reconstruct_incidents(_signals(spark, sf_dir), ["user_id"]), "log_span")
    out = N.incident_windows(placed, _bounds(spark, sf_dir), ["user_id"], 24 * HOUR)
    return out.select("user_id", "bin", F.round("known_percent", 5).alias("known_percent"), F.col("percent").isNotNull().alias("known"))


def i11_hourly_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = N.reconstruct_incidents(_signals(spark, sf_dir).withColumnRenamed("user_id", "perspective_id").withColumn("observer", F.lit("o")), ["perspective_id", "observer"])
    calls = _bounds(spark, sf_dir).select(F.col("user_id").alias("perspective_id"), "begin_us", "stop_us")
    out = N.pq_windows(e, calls, ["observer"], width_us=HOUR)
    return out.select("perspective_id", "bin", F.round("pq", 5).alias("pq"))


def a10_incident_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = N.place_incidents(N.reconstruct_incidents(_signals(spark, sf_dir), ["user_id"]), "log_span").withColumnRenamed("user_id", "perspective_id")
    perspectives = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("perspective_id"))
    out = N.incident_call_summary(placed, perspectives, ["perspective_id"])
    return out.select("perspective_id", "episodes", "closed", "unresolved", F.round("union_ms", 3).alias("union_ms"))


def a11_incident_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    perspectives = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("perspective_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey").cast("int")).alias("line_id"))
    own = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("perspective_id"))
    return N.incident_coverage(perspectives, own("error"), own("click")).select("perspective_id", "episodes", "reader_samples", "evaluable")


# --- lanes --------------------------------------------------------------------------------


def i12_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the lanes of every user, with their reasons."""
    e = events(spark, sf_dir)
    layer = F.element_at(F.array(*[F.lit(x) for x in ("stun", "cti", "sip", "device", "app")]), (F.col("event_id") % 5).cast("int") + 1)
    said = e.select("user_id", "ts", F.col("event_id").alias("ord"), layer.alias("layer"), F.when(F.col("value") < 60, "up").otherwise("down").alias("state"))
    bounds = e.groupBy("user_id").agg(F.min("ts").alias("begin"), F.max("ts").alias("stop"))
    return K.connectivity_timeline(said, bounds, ["user_id"], 6 * HOUR).select("user_id", "lane", "start", "end", "state")


# --- telemetry ----------------------------------------------------------------------------


def _domain(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """Events as records of clock domains, a user each; a second of theirs is a millisecond here."""
    e = events(spark, sf_dir, *types)
    mono = (S.micros("ts") - BASE_US) / 1e6
    return e.withColumns({"source_id": F.col("user_id").cast("string"), "session_id": F.lit("x"), "boot_id": F.lit("b"), "mono_ms": mono, "stream_id": F.lit("s")})


def i13_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _domain(spark, sf_dir, "click")
    config = F.concat(F.lit("c"), F.floor(F.col("value") / 40))
    windows = d.select(*T.DOMAIN, "stream_id", "event_id", config.alias("config_id"), F.col("mono_ms").alias("start_ms"), (F.col("mono_ms") + 20_000 + 1000 * (F.col("event_id") % 15)).alias("end_ms"), (F.col("event_id") % 10).alias("expected"), F.lit(0).cast("long").alias("received"), (F.col("event_id") % 7 > 0).alias("complete"), F.when(F.col("event_id") % 5 == 0, "other").otherwise("w").alias("semantics_id"), F.when(F.col("event_id") % 4 == 0, "local_send").otherwise("local_receive").alias("direction"))
    configs = _domain(spark, sf_dir, "view").select(*T.DOMAIN, "stream_id", config.alias("config_id"), "mono_ms", (F.col("event_id") % 2).cast("string").alias("body"))
    gaps = _domain(spark, sf_dir, "error").select(*T.DOMAIN, "mono_ms")
    return T.media_intervals(windows, configs, gaps, ["w"]).select("event_id", F.array_join("issues", ",").alias("issues"), "loss")


def i14_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _domain(spark, sf_dir)
    spans = d.select("source_id", F.when(F.col("event_id") % 2 == 0, "media_window").otherwise("rtcp").alias("method"), F.floor("mono_ms").alias("start_ms"), (F.floor("mono_ms") + 20_000).alias("end_ms"))
    return T.suppress_overlaps(spans, ["source_id"])


def i15_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each user's intervals at fixes, by access."""
    d = _domain(spark, sf_dir, "click").select(*T.DOMAIN, "event_id", F.round("mono_ms", 3).alias("start_ms"), (F.round("mono_ms", 3) + 30_000).alias("end_ms"))
    fixes = _domain(spark, sf_dir, "view").groupBy(*T.DOMAIN, F.round("mono_ms", 3).alias("mono_ms")).agg(F.lit(True).alias("ok"), F.min("event_id").cast("double").alias("latitude"), F.lit(9.0).alias("longitude"))
    nets = _domain(spark, sf_dir, "error").groupBy(*T.DOMAIN, F.round("mono_ms", 3).alias("mono_ms")).agg((F.min(F.col("event_id") % 6) > 0).alias("ok"), F.min(F.when(F.col("event_id") % 2 == 0, "wifi").otherwise("cellular")).alias("access"))
    rows = G.telemetry_places(d, fixes, nets, T.DOMAIN)
    return rows.groupBy("event_id", "latitude", "access").agg(F.round(F.sum((S.micros("end") - S.micros("start")) / 1e6), 3).alias("seconds"))


def i16_guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of every record: numbers with repeats and gaps, times that run back, drift and two roles in some domains."""
    d = _domain(spark, sf_dir)
    seq = F.col("event_id") - F.when(F.col("event_id") % 40 == 0, F.lit(1)).otherwise(0)
    rows = d.select("source_id", F.lit("x").alias("session_id"), F.lit("b").alias("boot_id"), "event_id", seq.alias("seq"), F.when((F.col("user_id") % 9 == 0) & (F.col("event_id") % 2 == 0), "gw").otherwise("app").alias("role"), F.when(F.col("user_id") % 5 == 0, -F.col("mono_ms")).when(F.col("user_id") % 5 == 1, F.col("mono_ms") * 1000 + F.col("event_id")).otherwise(F.col("mono_ms") * 1000).alias("mono_ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_utc"))
    return T.clock_guards(rows).select("event_id", F.array_join("issues", ",").alias("issues"))


def i17_plan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda *t: _domain(spark, sf_dir, *t).withColumns({"source_id": (F.col("user_id") % 3).cast("string"), "plan_id": F.concat(F.lit("p"), F.col("user_id") % 40), "revision": F.col("event_id") % 4})
    plans = part("view").select(*T.DOMAIN, "plan_id", "revision", "mono_ms", (F.col("mono_ms") + 1e6).alias("valid_until_ms"), F.when(F.col("value") > 200, "b").otherwise("a").alias("body"))
    return T.plan_audit(part("click").select(*T.DOMAIN, "event_id", "plan_id", "revision", "mono_ms"), plans).select("event_id", F.array_join("issues", ",").alias("issues"))


def a22_telemetry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    records = e.select((F.col("event_id") % 3 == 0).alias("conflict"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return T.telemetry_status(records, e.where("event_type = 'view'"))


# --- places -------------------------------------------------------------------------------


def i5_scored_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of users as scored intervals inside their windows, without networks."""
    q = squeezed(spark, sf_dir)
    losses = q.select(F.col("user_id").alias("perspective_id"), F.when(F.col("event_id") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), F.lit("0").alias("flow"), F.lit("7").alias("ssrc"), "ts", F.round(F.col("value") % 120, 2).alias("value"), F.lit("%").alias("unit"), (F.col("event_id") % 6 > 0).alias("valid"))
    at = lambda us: S.from_micros(F.lit(BASE_US + us))
    p = q.select(F.col("user_id").alias("perspective_id"), F.lit("i").alias("import_id"), at(300 * SECOND).alias("connected"), at(0).alias("start"), at(2000 * SECOND).alias("end")).distinct()
    none = spark.createDataFrame([], "import_id string, ts timestamp_ntz, access string, valid boolean")
    return L.mos_intervals(losses, p, none).select("perspective_id", "direction", "start", "end", F.round("mos", 6).alias("mos"), "access")


def i6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the lines of a supplier and line number on which all discounts agree; the flag is unknown where it doesn't."""
    day = F.col("l_shipdate").cast("date").cast("timestamp_ntz")
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_suppkey", "l_linenumber").alias("signature"), day.alias("start"), F.timestamp_add("DAY", F.col("l_quantity").cast("int"), day).alias("end"), F.col("l_discount").alias("value"), F.col("l_returnflag").alias("flag"))
    return G.canonical_intervals(rows, ["value"], ["flag"])


def i7_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = squeezed(spark, sf_dir)
    spans = q.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("import_id"), "event_id", F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(90), F.col("ts")).alias("end"))
    fixes = q.where("event_type IN ('view', 'click')").select(F.col("user_id").cast("string").alias("import_id"), "ts", F.col("event_id").cast("double").alias("latitude"), F.lit(9.0).alias("longitude"), F.lit(5.0).alias("accuracy"), (F.col("event_id") % 7 > 0).alias("valid"))
    return G.locate_intervals(spans, fixes, ["import_id"], 60 * SECOND).select("event_id", "start", "end", "latitude")


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense fixes of users; ok, cached and places follow from the event's number."""
    q = squeezed(spark, sf_dir)
    return q.select(F.col("user_id").alias("perspective_id"), "ts", "event_id", (F.col("event_id") % 9 > 0).alias("ok"), (F.col("event_id") % 10 == 0).alias("cached"), (45 + (F.col("event_id") % 7) / 500).alias("latitude"), (9 + (F.col("user_id") % 5) / 500).alias("longitude"))


def _pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every second of a user, and a second series in every hundredth."""
    q = squeezed(spark, sf_dir).groupBy(F.col("user_id").alias("perspective_id")).agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    rows = q.select("perspective_id", F.explode(F.sequence(F.floor(F.col("a") / SECOND), F.floor(F.col("b") / SECOND))).alias("bin"))
    rows = rows.withColumn("n", F.explode(F.when(F.col("bin") % 100 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("perspective_id", "bin", (F.col("bin") % 101).cast("double").alias("pq"))


def i18_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.route_samples(_fixes(spark, sf_dir), _pq(spark, sf_dir), most_us=30 * SECOND)
    return out.select("perspective_id", "bin", F.round("latitude", 7).alias("latitude"), "pq")


def i19_route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = squeezed(spark, sf_dir).select(F.col("user_id").alias("perspective_id"), F.lit(BASE_US + 300 * SECOND).alias("begin_us"), F.lit(BASE_US + 2000 * SECOND).alias("stop_us")).distinct()
    return G.route_points(_fixes(spark, sf_dir), _pq(spark, sf_dir), calls, 200.0).select("event_id", "bin", "reason", "pq")


def a18_direct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.pq_cells_direct(_fixes(spark, sf_dir).where("ok"), _pq(spark, sf_dir), 200.0)
    return out.select("cell", F.round("mean", 6).alias("mean"), "seconds", "days", "passes", "limited")


def a19_estimated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes, pq = _fixes(spark, sf_dir), _pq(spark, sf_dir)
    out = G.pq_cells_estimated(G.route_samples(fixes, pq, most_us=30 * SECOND), G.pq_cells_direct(fixes.where("ok"), pq, 200.0), 200.0)
    return out.select("cell", "basis", F.round("value", 6).alias("value"), "seconds", "estimated_seconds")


def a16_position_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select((F.col("user_id") % 100).cast("double").alias("latitude"), F.floor("value").cast("double").alias("longitude"), (F.col("event_id") % 2 == 0).alias("valid"))
    return G.position_cells(e, 50_000.0)


def t5_worst_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = e.select((F.col("user_id") % 60).cast("double").alias("lat"), F.floor("value").cast("double").alias("lon"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(20), F.col("ts")).alias("end"), F.floor(F.col("value") % 5).alias("mos"))
    cells = R.cell_summary(rows.withColumn("cell", S.grid_cell("lat", "lon", 1_000_000.0)))
    return L.worst_cells(cells, 20, "mean", 100.0).select("cell", F.round("mean", 6).alias("mean"), "seconds")


# --- listings -----------------------------------------------------------------------------


def p3_call_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = e.select(F.col("user_id").cast("string").alias("import_id"), "event_id", "ts", F.col("event_type").alias("family"), F.when(F.col("event_type") == "view", F.concat(F.lit("c"), "event_id")).alias("call_id"))
    return L.call_context(rows, _windows(spark, sf_dir), ["click", "error"]).select("event_id", "call_id", "is_context")


def p4_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 > 0, F.when(F.col("event_id") % 3 == 1, "wifi").otherwise("cellular")).alias("access"), F.lit("direct").alias("upstream"))
    return rows.where(K.matches({"access": "unknown", "upstream": "all"})).select("event_id")


def p5_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked orders with their lines; the ones that aren't there are told apart."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    asked = o.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("event_id"))
    metrics = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("string").alias("metric"), F.col("l_quantity").alias("value"), F.lit("pieces").alias("unit"))
    there, missing = L.evidence(asked, o.select(F.col("o_orderkey").alias("event_id"), "o_custkey"), metrics)
    return there.select("event_id", F.coalesce(F.size("metrics"), F.lit(0)).alias("metrics")).unionByName(missing.select("event_id", F.lit(None).cast("int").alias("metrics")))


def p7_canned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the example analyses over views made of events."""
    from .views import CANNED, run_sql

    e = events(spark, sf_dir)
    mos = e.select((F.col("user_id") % 20).alias("receiver"), F.concat(F.lit("k"), "user_id").alias("call_key"), F.col("event_type").alias("access"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(30), F.col("ts")).alias("end"), (F.col("value") % 5).alias("mos"))
    bad = run_sql(spark, {"a_mos": mos}, CANNED["bad_receivers"], {"threshold": 3.0})
    nets = run_sql(spark, {"a_mos": mos}, CANNED["network_quality"], {"threshold": 3.0})
    return bad.select(F.col("receiver").cast("string").alias("group"), "calls", "seconds").unionByName(nets.select(F.col("access").alias("group"), F.lit(None).cast("long").alias("calls"), "seconds"))


def p9_signaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    sip = e.select(F.concat(F.lit("c"), "user_id").alias("call_id"), "ts", F.lit("incoming").alias("direction"), F.col("event_type").alias("method"), F.lit(None).cast("int").alias("response"), F.lit("t").alias("title"), F.lit("n").alias("name"), F.col("event_id").alias("line_no"))
    return L.call_signaling(sip, "c42").select("ts", "method", "line_no")


def p10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir, "view").select(F.col("user_id").cast("string").alias("import_id"), F.col("event_id").alias("perspective_id"), F.col("ts").alias("start"))
    versions = events(spark, sf_dir, "signup").select(F.col("user_id").cast("string").alias("import_id"), "ts", F.concat(F.lit("v"), "event_id").alias("version"))
    profiles = p.select("import_id", F.when(F.col("import_id").cast("int") % 2 == 0, "ios").otherwise("android").alias("platform")).distinct()
    roles = p.where("perspective_id % 3 = 0").select("perspective_id", F.lit("gw").alias("role"))
    return L.perspective_listing(p, versions, profiles, roles).select("perspective_id", "version", "platform", "role")


def a3_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("rtcp.loss", "rtcp.rtt", "mystery")]), (F.col("event_id") % 3).cast("int") + 1)
    out = L.metric_catalog(events(spark, sf_dir).select(name.alias("metric"), F.when(F.col("event_id") % 2 == 0, "ms").otherwise("%").alias("unit")))
    return out.select("metric", "unit", F.array_join("seen_units", ",").alias("seen"), "samples", "known")


def a4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("user_id", "import_id")
    return L.coverage({"events": e, "orders": read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "import_id"), "errors": e.where("event_type = 'error'")})


def a5_call_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as calls, orders as their perspectives and scores, dear orders as their metrics."""
    o = read(spark, sf_dir, "orders").withColumn("call_key", F.concat(F.lit("k"), "o_custkey"))
    at = F.timestamp_add("MICROSECOND", F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("timestamp_ntz"))
    p = o.select("call_key", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("r"), "o_orderkey")).alias("reason"), at.alias("start"))
    calls = p.groupBy("call_key").agg(F.min("start").alias("start"))
    mos = o.select("call_key", at.alias("start"), F.timestamp_add("SECOND", (1 + F.col("o_orderkey") % 9).cast("int"), at).alias("end"), (F.col("o_orderkey") % 5).cast("double").alias("mos"))
    out = L.call_listing(calls, p, o.where("o_totalprice > 200000").select("call_key"), mos)
    return out.select("call_key", "start", "perspectives", "metrics", F.array_join("statuses", ",").alias("statuses"), "rejection", F.round("mos", 6).alias("mos"))


def t1_newest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("call_key", F.concat(F.lit("k"), "o_custkey"))
    calls = o.groupBy("call_key").agg(F.max("o_orderdate").cast("timestamp_ntz").alias("start"))
    p = o.select("call_key", F.lit("s").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("o_orderdate").alias("start"))
    none = o.limit(0).select("call_key", F.col("o_orderdate").cast("timestamp_ntz").alias("start"), F.col("o_orderdate").cast("timestamp_ntz").alias("end"), F.lit(1.0).alias("mos"))
    return L.call_listing(calls, p, o.select("call_key"), none, 40).select("call_key", "start", "perspectives")


def a7_call_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's newest user that is no duplicate: mean, extremes with their events, and coverage; several flows or a gateway have none."""
    e = events(spark, sf_dir)
    rows = e.select(F.col("user_id").alias("perspective_id"), "event_id", F.when(F.col("event_id") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), F.when(F.col("user_id") % 4 == 0, F.col("event_id") % 3).otherwise(0).alias("flow"), F.lit("7").alias("ssrc"), (1 + F.col("event_id") % 4).cast("double").alias("mos"), F.col("ts").alias("start"), F.timestamp_add("SECOND", (10 + F.col("event_id") % 20).cast("int"), F.col("ts")).alias("end"))
    p = e.groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    p = p.select(F.col("user_id").alias("perspective_id"), (F.col("user_id") % 50).alias("call_key"), F.lit(None).cast("timestamp_ntz").alias("connected"), "start", "end", F.when(F.col("user_id") % 11 == 0, "gw").otherwise("app").alias("role"), F.col("user_id").alias("import_seq"), F.when(F.col("user_id") % 7 == 0, "i").alias("duplicate_of"))
    out = L.mos_call_summary(rows, p)
    return out.select("call_key", "direction", "streams", "reason", F.round("mean", 6).alias("mean"), "low", "low_id", "high", "high_id", F.round("coverage", 6).alias("coverage"))


def a9_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("n"), F.col("user_id") % 4)).alias("access"), F.col("event_type").alias("operator"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(30), F.col("ts")).alias("end"), (F.col("value") % 5).alias("mos"))
    return R.network_breakdown(rows, ["access", "operator"])


def a12_transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increases of users' counters near clicks and errors."""
    s = squeezed(spark, sf_dir).where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("ord"), F.floor("value").alias("value"), (F.col("event_id") % 12 > 0).alias("valid"))
    counters = W.counter_intervals(s, ["user_id"], ["ord"], gap_us=300 * SECOND)
    notices = squeezed(spark, sf_dir).where("event_type IN ('click', 'error')").select("user_id", "ts", F.col("event_type").alias("type"))
    return L.transient_summary(counters, notices, ["click", "error", "mute"], ["user_id"], ["user_id"], 10 * SECOND)


def a13_transient_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("perspective_id"))
    return L.transient_coverage(p, events(spark, sf_dir, "error").select(F.col("user_id").alias("perspective_id"), (F.col("event_id") % 4).alias("name")))


def a14_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir, "click").select("user_id", "ts", F.col("event_id").alias("ord"), "value", (F.col("event_id") % 3 > 0).alias("valid"))
    made = events(spark, sf_dir, "view").select("user_id", "ts", F.concat(F.lit("d"), "event_id").alias("device"))
    return L.initial_observations(W.counter_intervals(s, ["user_id"], ["ord"]), made, ["user_id"]).select("user_id", "ord", "device", "created")


def a17_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each cell's canonical pieces by flag."""
    rows = i6_canonical(spark, sf_dir).withColumnRenamed("value", "mos")
    return R.network_breakdown(rows, ["flag"], threshold=0.05)


def a21_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = e.select((F.col("user_id") % 3).cast("string").alias("platform"), F.concat(F.lit("f"), F.col("user_id") % 4).alias("family"), F.col("event_type").alias("type"), F.lit("d").alias("detail"), "ts", F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("line_no"))
    return L.transient_inventory(rows).select("platform", "family", "type", "occurrences", "first.line_no")


def a23_mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = squeezed(spark, sf_dir)
    fixes = q.select(F.col("user_id").cast("string").alias("import_id"), "t_us", F.lit(True).alias("ok"), F.lit(45.0).alias("latitude"), F.lit(9.0).alias("longitude"), F.lit(5.0).alias("accuracy"), F.lit(None).cast("string").alias("elapsed"), F.lit(None).cast("double").alias("elapsed_s"))
    nets = q.select(F.col("user_id").cast("string").alias("import_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("sim_operator"), F.when(F.col("event_id") % 3 == 0, F.lit("roaming")).alias("serving_operator"))
    return L.mobility_summary(K.movement_sequences(fixes, gap_us=60 * SECOND), nets)


# --- streams ------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that a stream over the events gives once it has read them all."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    single = all(x.endswith("/events.parquet") for x in spark.read.parquet(path).inputFiles())  # a stream reads folders
    source = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    made = plan(source.withColumn("ts", F.timestamp_micros(S.micros("ts"))))
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def r3_bad_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours before the watermark: seconds of intervals of 50 minutes, cut at the hours, and those of a score below 3."""
    plan = lambda e: streams.stream_bad_windows(e.select("event_type", "ts", F.lit(3000.0).alias("seconds"), F.floor(F.col("value") % 5).alias("mos")), ["event_type"], 3.0, 3600, "2 hours")
    out = _streamed(spark, sf_dir, plan)
    return out.select("event_type", S.from_micros(F.unix_micros("start")).alias("start"), F.round("covered", 3).alias("covered"), F.round("bad", 3).alias("bad"))


def r4_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of users that ended up to the watermark, by the next one or after six hours."""
    plan = lambda e: streams.stream_state_ttl(e.select(F.col("user_id").cast("string").alias("user"), "ts", F.col("event_type").alias("state")), "user", "10 seconds", 6 * HOUR // 1000)
    out = _streamed(spark, sf_dir, plan)
    at = lambda c: S.from_micros(F.unix_micros(c)).alias(c)
    return out.select("user", at("start"), at("end"), "state", "ended_by")


def r5_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes from an error to the next purchase of a user without another error between, up to the watermark."""
    plan = lambda e: streams.stream_incidents(e.where("event_type IN ('error', 'purchase')").select(F.col("user_id").cast("string").alias("user"), "ts", F.when(F.col("event_type") == "error", "start").otherwise("end").alias("phase")), "user")
    out = _streamed(spark, sf_dir, plan)
    at = lambda c: S.from_micros(F.unix_micros(c)).alias(c)
    return out.select("user", at("start"), at("end"))


# --- jobs ---------------------------------------------------------------------------------


def z2_mos_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad and covered seconds of the report over users' losses."""
    q = squeezed(spark, sf_dir)
    losses = q.select(F.col("user_id").alias("perspective_id"), F.when(F.col("event_id") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), F.lit("0").alias("flow"), F.lit("7").alias("ssrc"), "ts", F.round(F.col("value") % 100, 2).alias("value"), F.lit("%").alias("unit"), F.lit(True).alias("valid"))
    p = q.groupBy(F.col("user_id").alias("perspective_id")).agg(F.min("ts").alias("start"), F.max("ts").alias("end")).withColumns({"import_id": F.lit("i"), "connected": F.lit(None).cast("timestamp_ntz")})
    none = spark.createDataFrame([], "import_id string, ts timestamp_ntz, access string, valid boolean")
    out = Z.mos_report(losses, p, none)["series"].groupBy("perspective_id").agg(F.sum("covered").alias("covered"), F.sum("bad").alias("bad"))
    return out.select("perspective_id", F.round("covered", 3).alias("covered"), F.round("bad", 3).alias("bad"))


def z3_incident_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _signals(spark, sf_dir).withColumnRenamed("user_id", "perspective_id")
    bounds = _bounds(spark, sf_dir).withColumnRenamed("user_id", "perspective_id")
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("perspective_id"))
    out = Z.incident_report(signals, bounds, people, ["perspective_id"], 24 * HOUR, "log_span")
    return out["calls"].select("perspective_id", "episodes", "closed", "unresolved", F.round("union_ms", 3).alias("union_ms"))


def z4_transient_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the report, with the edges of calls as notices."""
    q = squeezed(spark, sf_dir)
    s = q.where("event_type = 'view'").select(F.col("user_id").alias("perspective_id"), "ts", F.col("event_id").alias("ord"), F.floor("value").alias("value"), (F.col("event_id") % 12 > 0).alias("valid"))
    notices = q.where("event_type = 'click'").select(F.col("user_id").alias("perspective_id"), F.lit("i").alias("import_id"), "ts", F.col("event_type").alias("type"), F.lit("n").alias("name"), F.lit("p").alias("platform"), F.lit("f").alias("family"), F.lit("d").alias("detail"), F.col("event_id").alias("line_no"))
    p = q.groupBy(F.col("user_id").alias("perspective_id")).agg(F.min("ts").alias("connected"), F.max("ts").alias("end")).withColumn("import_id", F.lit("i"))
    out = Z.transient_report(s, notices, ["perspective_id"], ["perspective_id"], ["click", "call_ended"], 10 * SECOND, p)
    return out["summary"].select("perspective_id", "type", "with_notice")


def z5_geo_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per cell of purchases' intervals at their users' fixes."""
    q = squeezed(spark, sf_dir)
    spans = q.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("import_id"), "event_id", F.lit("wifi").alias("access"), F.lit(4.0).alias("mos"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(90), F.col("ts")).alias("end"))
    fixes = q.where("event_type IN ('view', 'click')").select(F.col("user_id").cast("string").alias("import_id"), "ts", (F.col("event_id") % 50).cast("double").alias("latitude"), (F.col("user_id") % 50).cast("double").alias("longitude"), F.lit(5.0).alias("accuracy"), F.lit(True).alias("valid"))
    out = Z.geo_report(spans, fixes, 100_000.0, ["access"])
    return out["cells"].select("cell", F.round("seconds", 3).alias("seconds"))


def z6_pq_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and estimated cells of users' routes without episodes: every score is 100."""
    fixes = _fixes(spark, sf_dir)
    calls = squeezed(spark, sf_dir).groupBy(F.col("user_id").alias("perspective_id")).agg(F.min("t_us").alias("begin_us"), (F.max("t_us") + SECOND).alias("stop_us"))
    none = N.reconstruct_incidents(spark.createDataFrame([], "perspective_id long, observer string, phase string, t_us long, duration_ms double"), ["perspective_id", "observer"])
    return Z.pq_map(none, calls, ["observer"], fixes, 200.0)["cells"].select("cell", "basis", "value", "seconds")


def z7_connectivity_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of seven devices from rendered log records, with reasons."""
    r = rendered(spark, sf_dir, "vdklog", "raw", "x Network %s", "element_at(array('UP for both pingers', 'DOWN for ONE pingers', 'DOWN for BOTH pingers'), cast(event_id % 3 as int) + 1)").withColumn("name", F.lit("vdklog.txt"))
    bounds = r.groupBy("import_id").agg(F.min("ts").alias("begin"), F.timestamp_add("MINUTE", F.lit(1), F.max("ts")).alias("stop"))
    return Z.connectivity_report(r, bounds).where("lane IN ('stun', 'network')").select("import_id", "lane", "start", "end", "state", "reason")


def z8_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks and increases of errors and views as two sides, the second a minute later."""
    side = lambda t: events(spark, sf_dir, t).select(F.concat(F.lit("m"), F.col("user_id") % 10).alias("metric"), F.lit("ms").alias("unit"), "ts", F.col("event_id").alias("ord"), "value", (F.col("event_id") % 3 > 0).alias("valid"))
    out = Z.compare_ab(side("error"), side("view"), MINUTE, 250.0)
    up = out["counters"].groupBy("side", "metric").agg(F.count("*").alias("pairs"))
    return out["peaks"].select("side", "metric", "peak", "peak_ts", "samples", "over").join(up, ["side", "metric"], "left")


def z9_telemetry_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines rendered from events: a configuration at first, then media windows, every tenth of them written twice."""
    e = events(spark, sf_dir)
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = e.withColumn("n", F.row_number().over(by))
    head = '{"schema":"telemetry/1","type":"%s","event_id":"e%d","source_id":"u%d","session_id":"x","boot_id":"b","seq":%d,"role":"app","observed_utc":"2026-01-01T00:00:00.%06dZ","mono_ms":%d,"validity":"valid","invalid_reason":null,"payload":%s}'
    stream = '"stream":{"call_id":"c","sip_call_id":null,"stream_id":"t","ssrc":1,"direction":"local_receive"}'
    config = "{" + stream + ',"config_id":"k","codec":"c","rtp_clock_hz":8000,"packet_duration_ms":20,"channels":1,"plc":"n","fec":"n","redundancy":"n","dtx":false,"jitter_buffer_mode":"m","jitter_target_ms":null}'
    media = F.format_string("{" + stream + ',"network_id":null,"config_id":"k","counter_epoch":"e","start_mono_ms":%d,"end_mono_ms":%d,"expected_packets":50,"received_unique_packets":%d,"semantics_id":"rtp-sequence-window/1","complete":true}', F.col("n") * 1000, F.col("n") * 1000 + F.when(F.col("event_id") % 6 == 0, 0).otherwise(1000), 50 - F.col("event_id") % 50)
    kind = F.when(F.col("n") == 1, "media_config").otherwise("media_interval")
    raw = F.format_string(head, kind, F.col("event_id"), F.col("user_id"), F.col("n"), F.col("n"), F.col("n"), F.when(F.col("n") == 1, config).otherwise(media))
    lines = n.select(F.lit("i").alias("import_id"), F.col("user_id").cast("string").alias("name"), F.col("n").alias("line_no"), raw.alias("raw"))
    fields = "schema string, type string, event_id string, source_id string, session_id string, boot_id string, seq long, role string, observed_utc string, mono_ms double, validity string, invalid_reason string, payload string"
    rows = lines.unionByName(lines.where("line_no % 10 = 0")).withColumn("_e", F.from_json("raw", fields)).select("import_id", "name", "line_no", "raw", "_e.*")
    out = Z.telemetry_job(rows, ["name", "line_no"])
    return out["intervals"].select("source_id", "method", "start_ms", "end_ms", "loss")


def z10_switch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switch requests and declared networks rendered as records: the transition near a request, and its call."""
    said = "CASE WHEN event_type = 'error' THEN '[t] [KPECORE] [INFO] KPE was requested to handle a switchNetworkEvent' ELSE concat('x : Current network interface: ', CASE WHEN event_id % 2 = 0 THEN 'wifi' ELSE 'cellular' END) END"
    r = rendered(spark, sf_dir, "kpelog", "kpe", "%s", said).withColumns({"import_id": F.col("name"), "ts": S.from_micros(F.floor((S.micros("ts") - BASE_US) / 5000) + BASE_US)})
    w = r.where("line_no % 9 = 1").select("import_id", F.col("line_no").alias("perspective_id"), F.concat(F.lit("c"), "line_no").alias("call_id"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(20), F.col("ts")).alias("end"))
    none = spark.createDataFrame([], "import_id string, ts timestamp_ntz, latitude double, longitude double, accuracy double, valid boolean")
    return Z.switch_report(r, w, none).select(F.col("line_no").alias("event_id"), "from_state", "to_state", "perspective_id")


PHASES = """s AS (SELECT DISTINCT user_id, epoch_us(ts) AS t, event_type = 'error' AS s, {length} AS d FROM events WHERE event_type IN ('error', 'purchase')),
l AS (SELECT *, lag(s) OVER w AS ps, lag(t) OVER w AS pt, lead(s) OVER w AS ns FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, s DESC)),
ep AS (SELECT user_id, CASE WHEN ps THEN pt ELSE t - CAST(coalesce(round(d * 1000), 0) AS BIGINT) END AS a, t AS b, d AS said, 'closed' AS status,
              CASE WHEN ps THEN 'observed' WHEN d IS NOT NULL THEN 'reported_duration' ELSE 'unknown' END AS basis FROM l WHERE NOT s
       UNION ALL SELECT user_id, t, NULL, NULL, 'open', 'observed' FROM l WHERE s AND (ns IS NULL OR ns))"""
PLAIN = PHASES.format(length="CAST(NULL AS DOUBLE)")
SAID = PHASES.format(length="CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN value * 1000 END")
BOUNDS = "bo AS (SELECT user_id, min(epoch_us(ts)) AS anchor, max(epoch_us(ts)) + 1 AS stop FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id)"
WINDOWS = "w AS (SELECT user_id AS u, event_id AS pid, ts AS a, ts + INTERVAL 8 HOUR AS b FROM events WHERE event_type = 'view')"
NOTICES = "n AS (SELECT user_id AS u, date_trunc('hour', ts) AS ts, event_type, event_id FROM events WHERE event_type IN ('error', 'click'))"
OWNED = f"{WINDOWS}, {NOTICES}, m AS (SELECT n.event_id, any_value(pid) AS pid FROM n JOIN w ON n.u = w.u AND n.ts BETWEEN w.a AND w.b GROUP BY n.event_id HAVING count(*) = 1)"
LAYERS = ("stun", "cti", "sip", "device", "app")
STEP = "(200 / 111195.08)"


def cell_sql(lat: str, lon: str, metres: float) -> str:
    step = f"({metres} / 111195.08)"
    return f"CAST(floor({lat} / {step}) AS BIGINT) || ':' || CAST(floor({lon} / ({step} / cos(radians(greatest(least((floor({lat} / {step}) + 0.5) * {step}, 89.9), -89.9))))) AS BIGINT)"


FIXES = f"""{SQUEEZED}, fx AS (SELECT user_id AS p, t, event_id, event_id % 9 > 0 AS ok, event_id % 10 = 0 AS cached, 45 + (event_id % 7) / 500 AS lat, 9 + (user_id % 5) / 500 AS lon, t // 1000000 AS bin FROM q),
ends AS (SELECT user_id AS p, min(t) // 1000000 AS a, max(t) // 1000000 AS b FROM q GROUP BY user_id),
fc AS (SELECT *, {cell_sql("lat", "lon", 200.0)} AS cell FROM fx)"""
DIRECT = f"""{FIXES}, one AS (SELECT p, bin, min(cell) AS cell FROM fc WHERE ok GROUP BY p, bin HAVING count(DISTINCT cell) = 1),
sc AS (SELECT *, (bin % 101)::DOUBLE AS pq FROM one WHERE bin % 100 > 0),
ps AS (SELECT *, lag(cell) OVER w IS DISTINCT FROM cell OR bin - lag(bin) OVER w > 120 AS new FROM sc WINDOW w AS (PARTITION BY p ORDER BY bin)),
dc AS (SELECT cell, avg(pq) AS mean, count(*) AS seconds, count(DISTINCT bin // 86400) AS days, count(*) FILTER (WHERE new) AS passes FROM ps GROUP BY cell)"""
ROUTE = """nx AS (SELECT *, lead(t) OVER w AS nt, lead(ok) OVER w AS nok, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM fx WINDOW w AS (PARTITION BY p ORDER BY t)),
sp AS (SELECT *, unnest(generate_series(CAST(ceil(t / 1e6) AS BIGINT), nt // 1000000 - 1)) AS b FROM nx WHERE ok AND nok AND nt - t <= 30000000),
rt AS (SELECT p, b AS bin, lat + (nlat - lat) * ((b * 1000000 + 500000 - t) / (nt - t)) AS lat, ((lon + ((nlon - lon + 180) % 360 - 180) * ((b * 1000000 + 500000 - t) / (nt - t)) + 180) % 360) - 180 AS lon, (b % 101)::DOUBLE AS pq FROM sp WHERE b % 100 > 0)"""

ORACLE: dict[str, str] = {
    "j3_position_at": f"""WITH v AS (SELECT user_id, ts, event_id / 1000 AS lat, event_id % 11 > 0 AS ok FROM events WHERE event_type = 'view')
        SELECT p.event_id, CASE WHEN v.ok AND epoch_us(p.ts) - epoch_us(v.ts) < {24 * HOUR} THEN v.lat END AS latitude, CASE WHEN v.ok AND epoch_us(p.ts) - epoch_us(v.ts) < {24 * HOUR} THEN v.user_id::DOUBLE END AS longitude
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "j9_series_sum": f"""WITH a AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'), t AS (SELECT user_id, ts FROM a UNION SELECT user_id, ts FROM b),
        x AS (SELECT t.*, l.ts AS lt, l.value AS lv FROM t ASOF JOIN a l ON t.user_id = l.user_id AND t.ts >= l.ts), x2 AS (SELECT x.*, h.ts AS ht, h.value AS hv FROM x ASOF JOIN a h ON x.user_id = h.user_id AND x.ts <= h.ts),
        y AS (SELECT t.*, l.ts AS lt, l.value AS lv FROM t ASOF JOIN b l ON t.user_id = l.user_id AND t.ts >= l.ts), y2 AS (SELECT y.*, h.ts AS ht, h.value AS hv FROM y ASOF JOIN b h ON y.user_id = h.user_id AND y.ts <= h.ts),
        z AS (SELECT user_id, ts, lv + (hv - lv) * (CASE WHEN ht = lt THEN 0 ELSE (epoch_us(ts) - epoch_us(lt)) / (epoch_us(ht) - epoch_us(lt)) END) AS v FROM x2 WHERE epoch_us(ht) - epoch_us(lt) <= {72 * HOUR}),
        z2 AS (SELECT user_id, ts, lv + (hv - lv) * (CASE WHEN ht = lt THEN 0 ELSE (epoch_us(ts) - epoch_us(lt)) / (epoch_us(ht) - epoch_us(lt)) END) AS v FROM y2 WHERE epoch_us(ht) - epoch_us(lt) <= {72 * HOUR})
        SELECT z.user_id, z.ts, round(z.v + z2.v, 3) AS value FROM z JOIN z2 USING (user_id, ts)""",
    "j10_transitions": f"""WITH r AS (SELECT user_id AS u, ts, event_id AS id FROM events WHERE event_type = 'error'), s AS (SELECT user_id AS u, ts, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS state FROM events WHERE event_type IN ('click', 'view')),
        c AS (SELECT r.id, count(*) AS n FROM r JOIN r o ON r.u = o.u AND abs(epoch_us(r.ts) - epoch_us(o.ts)) <= {18 * HOUR} GROUP BY r.id),
        m AS (SELECT r.id, s.ts, s.state, lag(s.state) OVER (PARTITION BY r.id ORDER BY s.ts, s.state) AS p FROM r JOIN s ON r.u = s.u AND abs(epoch_us(r.ts) - epoch_us(s.ts)) <= {12 * HOUR}),
        k AS (SELECT id, arg_min(state, ts) AS a, arg_max(state, ts) AS b FROM m WHERE p IS DISTINCT FROM state GROUP BY id HAVING count(*) = 2)
        SELECT r.id AS request_id, CASE WHEN n = 1 THEN a END AS from_state, CASE WHEN n = 1 THEN b END AS to_state FROM r JOIN c USING (id) LEFT JOIN k USING (id)""",
    "j11_reception": """WITH e AS (SELECT user_id AS p, event_id, event_id % 2 = 0 AS inc FROM events), u AS (SELECT DISTINCT user_id AS p, user_id % 5 = 0 AS gw, user_id % 3 = 0 AS peer FROM events),
        r AS (SELECT u.p, e.event_id, gw, true AS down, 'local' AS basis FROM e JOIN u USING (p) WHERE inc
              UNION ALL SELECT u.p, e.event_id, gw, false, 'remote_rtcp' FROM e JOIN u USING (p) WHERE NOT inc AND NOT peer
              UNION ALL SELECT u.p, e.event_id, gw, false, 'peer_local' FROM u JOIN e ON e.p = u.p + 1 WHERE inc AND peer)
        SELECT p AS perspective_id, event_id, CASE WHEN down <> gw THEN 'downstream' ELSE 'upstream' END AS way, basis FROM r""",
    "j13_switches_to_calls": f"""WITH {OWNED}, o AS (SELECT n.*, CASE WHEN n.event_id % 8 = 0 THEN n.event_id + 1 ELSE m.pid END AS pid FROM n LEFT JOIN m USING (event_id))
        SELECT CAST(o.u AS VARCHAR) AS import_id, o.ts, event_type AS type, o.pid AS perspective_id, CASE WHEN w.pid IS NOT NULL THEN 'c' || w.pid END AS call_id, count(*) AS proofs, min(event_id) AS first_proof FROM o LEFT JOIN w ON w.pid = o.pid GROUP BY ALL""",
    "j14_transients_to_calls": f"""WITH {OWNED} SELECT CAST(n.u AS VARCHAR) AS import_id, n.ts, event_type AS type, m.pid AS perspective_id, count(*) AS proofs FROM n LEFT JOIN m USING (event_id) GROUP BY ALL
        UNION ALL SELECT CAST(u AS VARCHAR), a + INTERVAL 1 HOUR, 'call_connected', pid, 0 FROM w UNION ALL SELECT CAST(u AS VARCHAR), b, 'call_ended', pid, 0 FROM w""",
    "w6_movement_rows": f"""WITH {SQUEEZED}, f AS (SELECT user_id AS u, t, event_id % 13 > 0 AS ok, 45 + value / 20000 AS lat, (event_id % 50)::DOUBLE AS el FROM q),
        g AS (SELECT *, max(CASE WHEN NOT ok THEN t END) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS bad FROM f),
        k AS (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(el) OVER w AS pel FROM g WHERE ok WINDOW w AS (PARTITION BY u ORDER BY t)),
        d AS (SELECT *, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)))) AS far FROM k),
        r AS (SELECT u, t, CASE WHEN bad IS NOT NULL AND (pt IS NULL OR bad > pt) THEN 'ambiguous_or_invalid' WHEN pt IS NULL THEN 'first_sample' WHEN el < pel THEN 'monotonic_reset' WHEN t - pt > 60000000 THEN 'time_gap' WHEN t <= pt OR far > 150.0 * (t - pt) / 1e6 + 10 THEN 'implausible_jump' END AS reason FROM d),
        p AS (SELECT *, count(reason) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS part FROM r)
        SELECT CAST(u AS VARCHAR) AS import_id, t AS t_us, part, row_number() OVER (PARTITION BY u, part ORDER BY t) AS ordinal, reason FROM p""",
    "c8_kept_rows": f"""WITH RECURSIVE k AS (SELECT user_id, min(epoch_us(ts)) AS t FROM events GROUP BY user_id
        UNION ALL SELECT k.user_id, (SELECT min(epoch_us(e.ts)) FROM events e WHERE e.user_id = k.user_id AND epoch_us(e.ts) > k.t + {24 * HOUR}) FROM k WHERE k.t IS NOT NULL)
        SELECT e.user_id, e.event_id FROM events e JOIN k ON e.user_id = k.user_id AND epoch_us(e.ts) = k.t""",
    "i8_episodes": f"""WITH {SAID} SELECT user_id, a AS start_us, b AS end_us, round(CASE WHEN status = 'open' THEN NULL WHEN said IS NOT NULL THEN said WHEN basis = 'observed' THEN (b - a) / 1000 END, 3) AS duration_ms,
        CASE WHEN status = 'open' THEN 'unknown' WHEN said IS NOT NULL THEN 'reported' WHEN basis = 'observed' THEN 'timestamps' ELSE 'unknown' END AS duration_basis, basis AS start_basis, status FROM ep""",
    "i9_places": f"""WITH {SAID} SELECT user_id, a AS start_us, status, 'log_span' AS mode, CASE WHEN status = 'closed' AND basis <> 'unknown' THEN a END AS a_us, CASE WHEN status = 'closed' AND basis <> 'unknown' THEN b END AS b_us FROM ep
        UNION ALL SELECT user_id, a, status, 'reported_end', CASE WHEN said IS NOT NULL THEN b - CAST(round(said * 1000) AS BIGINT) END, CASE WHEN said IS NOT NULL THEN b END FROM ep""",
    "i10_daily_windows": f"""WITH {PLAIN}, {BOUNDS}, e AS (SELECT ep.*, anchor, stop FROM ep JOIN bo USING (user_id)),
        bins AS (SELECT user_id, anchor, stop, unnest(generate_series(CAST(0 AS BIGINT), (stop - 1 - anchor) // {24 * HOUR})) AS bin FROM bo),
        sure AS (SELECT b.user_id, b.bin, sum(least(e.b, anchor + (bin + 1) * {24 * HOUR}, b.stop) - greatest(e.a, b.anchor + bin * {24 * HOUR})) AS us FROM bins b JOIN (SELECT user_id, a, ep.b FROM ep WHERE status = 'closed' AND basis <> 'unknown') e ON e.user_id = b.user_id AND e.a < b.anchor + (bin + 1) * {24 * HOUR} AND e.b > b.anchor + bin * {24 * HOUR} GROUP BY ALL),
        loose AS (SELECT user_id, (greatest(CASE WHEN basis = 'unknown' THEN anchor ELSE a END, anchor) - anchor) AS x, least(coalesce(b, stop), stop) - anchor AS y FROM e WHERE NOT (status = 'closed' AND basis <> 'unknown')),
        unsure AS (SELECT DISTINCT user_id, unnest(generate_series(x // {24 * HOUR}, (y - 1) // {24 * HOUR})) AS bin FROM loose WHERE x < y)
        SELECT b.user_id, b.bin, round(100.0::DOUBLE * coalesce(us, 0) / (least(anchor + (b.bin + 1) * {24 * HOUR}, stop) - (anchor + b.bin * {24 * HOUR})), 5) AS known_percent, u.bin IS NULL AS known FROM bins b LEFT JOIN sure s ON s.user_id = b.user_id AND s.bin = b.bin LEFT JOIN unsure u ON u.user_id = b.user_id AND u.bin = b.bin""",
    "i11_hourly_pq": f"""WITH {PLAIN}, {BOUNDS}, s0 AS (SELECT user_id AS u, a, coalesce(ep.b, stop) AS b FROM ep JOIN bo USING (user_id) WHERE basis <> 'unknown'),
        x AS (SELECT *, max(b) OVER (PARTITION BY u ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s0 WHERE a < b),
        y AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < a THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM x),
        m AS (SELECT u, min(a) AS a, max(b) AS b FROM y GROUP BY u, isl),
        c AS (SELECT u, bin, sum(least(b, (bin + 1) * {HOUR}) - greatest(a, bin * {HOUR})) AS us FROM (SELECT *, unnest(generate_series(a // {HOUR}, (b - 1) // {HOUR})) AS bin FROM m) GROUP BY u, bin),
        bins AS (SELECT user_id AS u, anchor, stop, unnest(generate_series(anchor // {HOUR}, (stop - 1) // {HOUR})) AS bin FROM bo)
        SELECT bins.u AS perspective_id, bins.bin, round(100 - 100.0::DOUBLE * coalesce(us, 0) / (least((bins.bin + 1) * {HOUR}, stop) - greatest(bins.bin * {HOUR}, anchor)), 5) AS pq FROM bins LEFT JOIN c ON c.u = bins.u AND c.bin = bins.bin""",
    "a10_incident_sums": f"""WITH {PLAIN}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE NOT (status = 'closed' AND basis <> 'unknown')) AS lost, sum(b - a) FILTER (WHERE status = 'closed' AND basis <> 'unknown') AS us FROM ep GROUP BY user_id)
        SELECT c_custkey AS perspective_id, coalesce(n, 0) AS episodes, coalesce(closed, 0) AS closed, coalesce(lost, 0) AS unresolved, round(us / 1000, 3) AS union_ms FROM customer LEFT JOIN g ON user_id = c_custkey""",
    "a11_incident_coverage": """WITH g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'click') AS r FROM events GROUP BY user_id)
        SELECT c_custkey AS perspective_id, coalesce(e, 0) AS episodes, coalesce(r, 0) AS reader_samples, c_custkey % 4 > 0 AND (coalesce(e, 0) > 0 OR coalesce(r, 0) > 0) AS evaluable FROM customer LEFT JOIN g ON user_id = c_custkey""",
    "i12_lanes": f"""WITH v AS (SELECT user_id AS u, epoch_us(ts) AS t, CASE event_id % 5 WHEN 0 THEN 'stun' WHEN 1 THEN 'cti' WHEN 2 THEN 'sip' WHEN 3 THEN 'device' ELSE 'app' END AS layer, CASE WHEN value < 60 THEN 'up' ELSE 'down' END AS state FROM events),
        b AS (SELECT u, min(t) AS a, max(t) AS z FROM v GROUP BY u), c AS (SELECT DISTINCT v.u, x.t FROM (SELECT u, t FROM v UNION SELECT u, t + {6 * HOUR} FROM v) x JOIN v USING (u) JOIN b ON b.u = x.u WHERE x.t >= a AND x.t < z),
        lay AS (SELECT unnest(['stun', 'cti', 'sip', 'device', 'app', 'media']) AS layer), cl AS (SELECT c.*, layer FROM c, lay),
        f AS (SELECT cl.u, cl.t, cl.layer, CASE WHEN cl.t < v.t + {6 * HOUR} THEN v.state ELSE 'unknown' END AS state FROM cl ASOF LEFT JOIN v ON cl.u = v.u AND cl.layer = v.layer AND cl.t >= v.t),
        n AS (SELECT u, t, 'network' AS layer, bool_or(layer IN ('stun', 'cti', 'sip', 'media') AND state = 'up') AS up, bool_or(layer IN ('device', 'stun') AND state = 'down') AS dn FROM f GROUP BY u, t),
        al AS (SELECT u, t, layer, coalesce(state, 'unknown') AS state FROM f UNION ALL SELECT u, t, layer, CASE WHEN up AND dn THEN 'transient' WHEN dn THEN 'down' WHEN up THEN 'up' ELSE 'unknown' END FROM n),
        ch AS (SELECT *, lag(state) OVER (PARTITION BY u, layer ORDER BY t) IS DISTINCT FROM state AS new FROM al),
        se AS (SELECT u, layer, t, state, lead(t) OVER (PARTITION BY u, layer ORDER BY t) AS nt FROM ch WHERE new)
        SELECT se.u AS user_id, layer AS lane, {as_time("t")} AS start, {as_time("coalesce(nt, z)")} AS "end", state FROM se JOIN b ON b.u = se.u""",
    "i13_media": f"""WITH d AS (SELECT user_id AS u, event_type, event_id, value, (epoch_us(ts) - {BASE_US}) / 1e6 AS m FROM events),
        w AS (SELECT *, m AS a, m + 20000 + 1000 * (event_id % 15) AS b, floor(value / 40) AS c FROM d WHERE event_type = 'click'),
        k AS (SELECT u, floor(value / 40) AS c, count(DISTINCT event_id % 2) AS bodies, min(m) AS since FROM d WHERE event_type = 'view' GROUP BY u, floor(value / 40)),
        x AS (SELECT w.event_id, EXISTS (SELECT 1 FROM d WHERE d.u = w.u AND d.event_type IN ('view', 'error') AND d.m > w.a AND d.m < w.b) AS cut, coalesce(bodies <> 1, true) OR since > a AS lost, NOT (event_id % 7 > 0) OR b - a > 30000 AS long FROM w LEFT JOIN k ON k.u = w.u AND k.c = w.c),
        i AS (SELECT event_id, concat_ws(',', CASE WHEN lost THEN 'config_reference_unresolved' END, CASE WHEN long THEN 'incomplete_or_long_interval' END, CASE WHEN cut THEN 'interval_crosses_configuration_or_collection_gap' END, CASE WHEN event_id % 5 = 0 THEN 'loss_semantics_unverified' END, CASE WHEN event_id % 4 = 0 THEN 'receive_counters_required' END, CASE WHEN event_id % 10 = 0 THEN 'no_expected_packets' END) AS issues FROM x)
        SELECT event_id, issues, CASE WHEN issues = '' THEN 100.0::DOUBLE END AS loss FROM i""",
    "i14_suppressed": f"""WITH d AS (SELECT user_id AS u, CASE WHEN event_id % 2 = 0 THEN 'media_window' ELSE 'rtcp' END AS method, CAST(floor((epoch_us(ts) - {BASE_US}) / 1e6) AS BIGINT) AS a, event_id FROM events),
        x AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.u = d.u AND o.method = d.method AND o.event_id <> d.event_id AND o.a < d.a + 20000 AND o.a + 20000 > d.a))
        SELECT CAST(u AS VARCHAR) AS source_id, method, a AS start_ms, a + 20000 AS end_ms FROM x WHERE method = 'media_window' OR NOT EXISTS (SELECT 1 FROM d o WHERE o.u = x.u AND o.method = 'media_window' AND o.a < x.a + 20000 AND o.a + 20000 > x.a)""",
    "i15_places": f"""WITH d AS (SELECT user_id AS u, event_type, event_id, CAST(round(round((epoch_us(ts) - {BASE_US}) / 1e6, 3) * 1000) AS BIGINT) AS t FROM events),
        f AS (SELECT u, t, event_id, least(t + 30000000, coalesce(lead(t) OVER (PARTITION BY u ORDER BY t), t + 30000000)) AS z FROM d WHERE event_type = 'view'),
        n AS (SELECT u, t, event_id % 6 > 0 AS ok, CASE WHEN event_id % 2 = 0 THEN 'wifi' ELSE 'cellular' END AS access, least(t + 30000000, coalesce(lead(t) OVER (PARTITION BY u ORDER BY t), t + 30000000)) AS z FROM d WHERE event_type = 'error'),
        p AS (SELECT i.event_id, f.event_id AS fix, i.u, greatest(i.t, f.t) AS a, least(i.t + 30000000, f.z) AS b FROM d i JOIN f ON f.u = i.u AND f.t < i.t + 30000000 AND f.z > i.t WHERE i.event_type = 'click'),
        k AS (SELECT p.*, n.ok, n.access, least(p.b, n.z) - greatest(p.a, n.t) AS us FROM p JOIN n ON n.u = p.u AND n.t < p.b AND n.z > p.a),
        g AS (SELECT event_id, fix, CASE WHEN ok THEN access ELSE 'unknown' END AS access, us FROM k UNION ALL SELECT event_id, fix, 'unknown', b - a - coalesce((SELECT sum(us) FROM k WHERE k.event_id = p.event_id AND k.fix = p.fix), 0) FROM p)
        SELECT event_id, fix::DOUBLE AS latitude, access, round(sum(us) / 1e6, 3) AS seconds FROM g GROUP BY ALL HAVING sum(us) > 0""",
    "i16_guard_rows": f"""WITH d AS (SELECT user_id AS u, event_id, event_id - CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END AS seq, CASE WHEN user_id % 9 = 0 AND event_id % 2 = 0 THEN 'gw' ELSE 'app' END AS role, (epoch_us(ts) - {BASE_US}) / 1e6 AS m0, epoch_us(ts) / 1000 AS wall FROM events),
        e AS (SELECT *, CASE u % 5 WHEN 0 THEN -m0 WHEN 1 THEN m0 * 1000 + event_id ELSE m0 * 1000 END AS m FROM d),
        g AS (SELECT *, count(*) OVER (PARTITION BY u, seq) > 1 AS same, seq - lag(seq) OVER w > 1 AS gap, m < lag(m) OVER w AS back, wall - m AS dr FROM e WINDOW w AS (PARTITION BY u ORDER BY seq, m)),
        h AS (SELECT event_id, same, gap, bool_or(back) OVER (PARTITION BY u) AS back, max(dr) OVER (PARTITION BY u) - min(dr) OVER (PARTITION BY u) > 1000 AS drift, min(role) OVER (PARTITION BY u) <> max(role) OVER (PARTITION BY u) AS roles FROM g)
        SELECT event_id, concat_ws(',', CASE WHEN same THEN 'duplicate_sequence' END, CASE WHEN back THEN 'monotonic_decrease' END, CASE WHEN drift THEN 'clock_drift' END, CASE WHEN roles THEN 'mixed_roles' END, CASE WHEN gap THEN 'sequence_gap' END) AS issues FROM h""",
    "i17_plan_audit": f"""WITH d AS (SELECT user_id % 3 AS s, user_id % 40 AS p, event_id % 4 AS r, event_type, event_id, value, (epoch_us(ts) - {BASE_US}) / 1e6 AS m FROM events),
        k AS (SELECT s, p, r, min(m) AS since, max(m + 1e6) AS until, count(DISTINCT value > 200) AS bodies FROM d WHERE event_type = 'view' GROUP BY s, p, r)
        SELECT event_id, concat_ws(',', CASE WHEN coalesce(since > m, true) THEN 'plan_reference_unresolved' END, CASE WHEN bodies > 1 THEN 'plan_revision_conflict' END, CASE WHEN until < m THEN 'plan_expired' END) AS issues FROM d LEFT JOIN k USING (s, p, r) WHERE event_type = 'click'""",
    "a22_telemetry_status": "SELECT count(*) AS records, count(*) FILTER (WHERE event_id % 3 = 0) AS conflicts, count(*) FILTER (WHERE event_id % 4 = 0) AS with_issues, count(*) FILTER (WHERE event_type = 'view') AS intervals FROM events",
    "i5_scored_intervals": f"""WITH {SQUEEZED}, n AS (SELECT *, event_id % 2 = 0 AS inc, lead(t) OVER (PARTITION BY user_id, event_id % 2 ORDER BY t) AS nt, round(value % 120, 2) AS l FROM q),
        h AS (SELECT user_id, inc, l, greatest(t, {BASE_US} + 300000000) AS a, least(t + 30000000, coalesce(nt, t + 30000000), {BASE_US} + 2000000000) AS b FROM n WHERE event_id % 6 > 0 AND l <= 100),
        r AS (SELECT *, greatest(least(93.2 - 95.0 * l / (l + 25.1), 100), 0) AS r FROM h WHERE a < b)
        SELECT user_id AS perspective_id, CASE WHEN inc THEN 'incoming' ELSE 'outgoing' END AS direction, {as_time("a")} AS start, {as_time("b")} AS "end", round(1 + 0.035 * r + 7e-6 * r * (r - 60) * (100 - r), 6) AS mos, CAST(NULL AS VARCHAR) AS access FROM r""",
    "i6_canonical": """WITH r AS (SELECT DISTINCT l_suppkey || ':' || l_linenumber AS s, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS a, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_days(CAST(l_quantity AS INT)) AS b, l_discount AS v, l_returnflag AS f FROM lineitem),
        c AS (SELECT s, a AS t FROM r UNION SELECT s, b FROM r), k AS (SELECT s, t, lead(t) OVER (PARTITION BY s ORDER BY t) AS n FROM c)
        SELECT k.s AS signature, t AS start, n AS "end", min(v) AS value, CASE WHEN count(DISTINCT f) = 1 THEN min(f) ELSE 'unknown' END AS flag FROM k JOIN r ON r.s = k.s AND r.a <= t AND r.b >= n WHERE n IS NOT NULL AND r.a < r.b GROUP BY k.s, t, n HAVING min(v) = max(v)""",
    "i7_located": f"""WITH {SQUEEZED}, f AS (SELECT user_id, t, event_id, event_id % 7 > 0 AS ok, least(t + 60000000, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t + 60000000)) AS z FROM q WHERE event_type IN ('view', 'click'))
        SELECT p.event_id, {as_time("greatest(p.t, f.t)")} AS start, {as_time("least(p.t + 90000000, f.z)")} AS "end", f.event_id::DOUBLE AS latitude FROM q p JOIN f ON f.user_id = p.user_id AND f.t < p.t + 90000000 AND f.z > p.t AND f.ok WHERE p.event_type = 'purchase' AND greatest(p.t, f.t) < least(p.t + 90000000, f.z)""",
    "i18_route": f"WITH {FIXES}, {ROUTE} SELECT p AS perspective_id, bin, round(lat, 7) AS latitude, pq FROM rt",
    "i19_route_points": f"""WITH {FIXES}, s AS (SELECT p, bin, count(DISTINCT cell) > 1 AS many FROM fc GROUP BY p, bin),
        r AS (SELECT fc.event_id, fc.bin, CASE WHEN cached THEN 'cached_position' WHEN t < {BASE_US} + 300000000 THEN 'before_connect' WHEN t >= {BASE_US} + 2000000000 THEN 'at_or_after_end' WHEN many THEN 'several_cells_in_second' WHEN fc.bin % 100 = 0 THEN 'no_unique_series' END AS reason FROM fc JOIN s USING (p, bin))
        SELECT event_id, bin, reason, CASE WHEN reason IS NULL THEN (bin % 101)::DOUBLE END AS pq FROM r""",
    "a18_direct_cells": f"WITH {DIRECT} SELECT cell, round(mean, 6) AS mean, seconds, days, passes, seconds < 60 OR days < 2 AS limited FROM dc",
    "a19_estimated_cells": f"""WITH {DIRECT}, {ROUTE}, es AS (SELECT {cell_sql("lat", "lon", 200.0)} AS cell, avg(pq) AS mean, count(*) AS seconds FROM rt GROUP BY ALL)
        SELECT cell, CASE WHEN dc.mean IS NOT NULL THEN 'direct' ELSE 'estimated' END AS basis, round(coalesce(dc.mean, es.mean), 6) AS value, dc.seconds, es.seconds AS estimated_seconds FROM dc FULL JOIN es USING (cell)""",
    "a16_position_cells": f"""WITH e AS (SELECT (user_id % 100)::DOUBLE AS lat, floor(value) AS lon FROM events WHERE event_id % 2 = 0)
        SELECT DISTINCT CASE WHEN lat <= 90 AND lon <= 180 THEN {cell_sql("lat", "lon", 50000.0)} END AS cell FROM e""",
    "t5_worst_cells": f"""WITH e AS (SELECT (user_id % 60)::DOUBLE AS lat, floor(value) AS lon, floor(value % 5) AS mos FROM events), c AS (SELECT {cell_sql("lat", "lon", 1000000.0)} AS cell, mos FROM e WHERE lon <= 180),
        s AS (SELECT cell, round(avg(mos), 6) AS mean, count(*) * 20.0::DOUBLE AS seconds FROM c GROUP BY cell) SELECT * FROM s WHERE seconds >= 100 ORDER BY mean, seconds DESC, cell LIMIT 20""",
    "p3_call_context": """WITH w AS (SELECT user_id AS u, event_id AS pid, ts AS a, ts + INTERVAL 8 HOUR AS b FROM events WHERE event_type = 'view')
        SELECT event_id, 'c' || event_id AS call_id, false AS is_context FROM events WHERE event_type = 'view' UNION ALL SELECT e.event_id, 'c' || pid, true FROM events e JOIN w ON e.user_id = w.u AND e.ts BETWEEN a AND b WHERE event_type IN ('click', 'error')""",
    "p4_matching": "SELECT event_id FROM events WHERE event_id % 3 = 0",
    "p5_evidence": """WITH a AS (SELECT o_orderkey * 2 AS id FROM orders WHERE o_orderkey % 3 = 0), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
        SELECT id AS event_id, CAST(CASE WHEN o.o_orderkey IS NOT NULL THEN coalesce(n, 0) END AS INT) AS metrics FROM a LEFT JOIN orders o ON o.o_orderkey = id LEFT JOIN l ON l_orderkey = id""",
    "p7_canned": """SELECT CAST(user_id % 20 AS VARCHAR) AS "group", count(DISTINCT user_id) AS calls, count(*) * 30.0::DOUBLE AS seconds FROM events WHERE value % 5 < 3 GROUP BY user_id % 20
        UNION ALL SELECT event_type, NULL, count(*) * 30.0::DOUBLE FROM events WHERE value % 5 < 3 GROUP BY event_type""",
    "p9_signaling": "SELECT ts, event_type AS method, event_id AS line_no FROM events WHERE user_id = 42",
    "p10_perspectives": """SELECT p.event_id AS perspective_id, CASE WHEN v.event_id IS NOT NULL THEN 'v' || v.event_id END AS version, CASE WHEN p.user_id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform, CASE WHEN p.event_id % 3 = 0 THEN 'gw' ELSE 'unknown' END AS role
        FROM (SELECT * FROM events WHERE event_type = 'view') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "a3_catalog": "WITH k(metric, unit) AS (VALUES " + ", ".join(f"('{m}', '{u}')" for m, u, _, _ in entries()) + """), s AS (SELECT ['rtcp.loss', 'rtcp.rtt', 'mystery'][CAST(event_id % 3 AS INT) + 1] AS metric, string_agg(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'ms' ELSE '%' END, ',' ORDER BY CASE WHEN event_id % 2 = 0 THEN 'ms' ELSE '%' END) AS seen, count(*) AS n FROM events GROUP BY 1)
        SELECT metric, k.unit, seen, coalesce(n, 0) AS samples, k.unit IS NOT NULL AS known FROM k FULL JOIN s USING (metric)""",
    "a4_coverage": "SELECT count(*) AS rows, count(DISTINCT user_id) AS imports, 'events' AS domain FROM events UNION ALL SELECT count(*), count(DISTINCT o_custkey), 'orders' FROM orders UNION ALL SELECT count(*), count(DISTINCT user_id), 'errors' FROM events WHERE event_type = 'error'",
    "a5_call_listing": """WITH o AS (SELECT *, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_microseconds(o_orderkey) AS a FROM orders)
        SELECT 'k' || o_custkey AS call_key, min(a) AS start, count(*) AS perspectives, count(*) FILTER (WHERE o_totalprice > 200000) AS metrics, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses,
        'r' || arg_min(o_orderkey, a) FILTER (WHERE starts_with(o_orderpriority, '1')) AS rejection, round(sum((o_orderkey % 5) * (1 + o_orderkey % 9)) / sum(1 + o_orderkey % 9), 6) AS mos FROM o GROUP BY o_custkey""",
    "t1_newest_calls": "SELECT 'k' || o_custkey AS call_key, CAST(max(o_orderdate) AS TIMESTAMP) AS start, count(*) AS perspectives FROM orders GROUP BY o_custkey ORDER BY start DESC, call_key LIMIT 40",
    "a7_call_scores": """WITH p AS (SELECT user_id % 50 AS k, max(user_id) AS u FROM events WHERE user_id % 7 > 0 GROUP BY user_id % 50), b AS (SELECT user_id AS u, epoch_us(max(ts)) - epoch_us(min(ts)) AS w FROM events GROUP BY user_id),
        e AS (SELECT k, p.u, w, event_id, event_id % 2 AS d, CASE WHEN p.u % 4 = 0 THEN event_id % 3 ELSE 0 END AS flow, (1 + event_id % 4)::DOUBLE AS mos, 10 + event_id % 20 AS s FROM p JOIN events ON user_id = p.u JOIN b USING (u)),
        g AS (SELECT k, d, any_value(u) AS u, any_value(w) AS w, count(DISTINCT flow) AS streams, sum(mos * s) / sum(s) AS mean, min(mos) AS low, max(mos) AS high, sum(s) AS s, arg_min(event_id, (mos, event_id)) AS lo, arg_max(event_id, (mos, -event_id)) AS hi FROM e GROUP BY k, d),
        r AS (SELECT *, CASE WHEN u % 11 = 0 THEN 'declared_role' WHEN streams > 1 THEN 'several_streams' END AS reason FROM g)
        SELECT k AS call_key, CASE WHEN d = 0 THEN 'incoming' ELSE 'outgoing' END AS direction, streams, reason, CASE WHEN reason IS NULL THEN round(mean, 6) END AS mean, CASE WHEN reason IS NULL THEN low END AS low, CASE WHEN reason IS NULL THEN lo END AS low_id, CASE WHEN reason IS NULL THEN high END AS high, CASE WHEN reason IS NULL THEN hi END AS high_id, round(100 * s / nullif(w / 1e6, 0), 6) AS coverage FROM r""",
    "a9_networks": "SELECT CASE WHEN user_id % 4 > 0 THEN 'n' || user_id % 4 ELSE 'unknown' END AS access, event_type AS operator, count(*) * 30.0::DOUBLE AS seconds, count(*) FILTER (WHERE value % 5 < 3) * 30.0::DOUBLE AS bad FROM events GROUP BY ALL",
    "a12_transients": f"""WITH {SQUEEZED}, l AS (SELECT user_id AS u, t, floor(value) AS v, event_id % 12 > 0 AS ok, lag(t) OVER w AS pt, lag(floor(value)) OVER w AS pv, lag(event_id % 12 > 0) OVER w AS pok, count(*) OVER (PARTITION BY user_id, t) AS n FROM q WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
        i AS (SELECT u, pt AS a, t AS b, v > pv AS up FROM l WHERE ok AND pok AND n = 1 AND t > pt AND v >= pv AND t - pt <= 300000000), y AS (SELECT unnest(['click', 'error', 'mute']) AS type),
        f AS (SELECT i.*, type, EXISTS (SELECT 1 FROM q WHERE q.user_id = u AND q.event_type = type AND q.t BETWEEN a - 10000000 AND b + 10000000) AS near FROM i, y)
        SELECT u AS user_id, type, count(*) AS intervals, count(*) FILTER (WHERE near) AS with_notice, count(*) FILTER (WHERE near AND up) AS positive_with, count(*) FILTER (WHERE NOT near AND up) AS positive_without FROM f GROUP BY ALL""",
    "a13_transient_coverage": "SELECT c_custkey AS perspective_id, count(event_id) AS notices, count(DISTINCT event_id % 4) AS files FROM customer LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') ON user_id = c_custkey GROUP BY c_custkey",
    "a14_initial": """WITH f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS ord, min(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY user_id)
        SELECT f.user_id, f.ord, CASE WHEN v.event_id IS NOT NULL THEN 'd' || v.event_id END AS device, v.ts AS created FROM (SELECT * FROM f WHERE ord % 3 > 0) f ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON f.user_id = v.user_id AND f.ts >= v.ts""",
    "a21_inventory": "SELECT CAST(user_id % 3 AS VARCHAR) AS platform, 'f' || user_id % 4 AS family, event_type AS type, count(*) AS occurrences, arg_min(event_id, ts) AS line_no FROM events GROUP BY ALL",
    "a23_mobility": f"""WITH {SQUEEZED}, g AS (SELECT user_id AS u, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 60000000 THEN 1 ELSE 0 END AS new FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t)),
        o AS (SELECT user_id AS u, event_type AS o FROM q WHERE event_id % 2 = 0 UNION SELECT user_id, 'roaming' FROM q WHERE event_id % 3 = 0), n AS (SELECT u, count(*) AS n FROM o GROUP BY u)
        SELECT CAST(g.u AS VARCHAR) AS import_id, CAST(sum(new) AS BIGINT) AS sequences, count(*) AS samples, coalesce(any_value(n), 0) AS operators FROM g LEFT JOIN n USING (u) GROUP BY g.u""",
    "r3_bad_windows": f"""WITH e AS (SELECT event_type, epoch_us(ts) AS a, epoch_us(ts) + 3000000000 AS b, floor(value % 5) AS mos FROM events), p AS (SELECT *, unnest(generate_series(a // {HOUR}, (b - 1) // {HOUR})) AS k FROM e),
        l AS (SELECT max(greatest(a, k * {HOUR})) - {2 * HOUR} AS mark FROM p)
        SELECT event_type, {as_time(f"k * {HOUR}")} AS start, round(sum(least(b, (k + 1) * {HOUR}) - greatest(a, k * {HOUR})) / 1e6, 3) AS covered, round(coalesce(sum(least(b, (k + 1) * {HOUR}) - greatest(a, k * {HOUR})) FILTER (WHERE mos < 3), 0) / 1e6, 3) AS bad
        FROM p, l WHERE (k + 1) * {HOUR} <= mark // 1000 * 1000 GROUP BY event_type, k""",
    "r4_states": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_type, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), x AS (SELECT *, least(t + {6 * HOUR}, coalesce(n, t + {6 * HOUR})) AS z FROM e)
        SELECT CAST(user_id AS VARCHAR) AS "user", {as_time("t")} AS start, {as_time("z")} AS "end", event_type AS state, CASE WHEN z = t + {6 * HOUR} THEN 'expiry' ELSE 'next' END AS ended_by FROM x WHERE z <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 10000000 FROM events)""",
    "r5_incidents": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_type = 'error' AS s FROM events WHERE event_type IN ('error', 'purchase')),
        g AS (SELECT *, lag(s) OVER w AS ps, lag(t) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, NOT s))
        SELECT CAST(user_id AS VARCHAR) AS "user", {as_time("pt")} AS start, {as_time("t")} AS "end" FROM g WHERE NOT s AND ps AND t <= (SELECT max(t) // 1000 * 1000 - 10000000 FROM e)""",
    "z2_mos_job": f"""WITH {SQUEEZED}, n AS (SELECT *, lead(t) OVER (PARTITION BY user_id, event_id % 2 ORDER BY t) AS nt, max(t) OVER (PARTITION BY user_id) AS stop, round(value % 100, 2) AS l FROM q),
        h AS (SELECT user_id, least(t + 30000000, coalesce(nt, t + 30000000), stop) - t AS us, greatest(least(93.2 - 95.0 * l / (l + 25.1), 100), 0) AS r FROM n), v AS (SELECT *, 1 + 0.035 * r + 7e-6 * r * (r - 60) * (100 - r) AS mos FROM h WHERE us > 0)
        SELECT user_id AS perspective_id, round(sum(us) / 1e6, 3) AS covered, round(coalesce(sum(us) FILTER (WHERE mos < 3), 0) / 1e6, 3) AS bad FROM v GROUP BY user_id""",
    "z7_connectivity_job": f"""WITH v AS (SELECT user_id % 7 AS u, epoch_us(ts) AS t, event_id % 3 AS s FROM events), b AS (SELECT u, min(t) AS a, max(t) + 60000000 AS z FROM v GROUP BY u), n AS (SELECT *, lead(t) OVER (PARTITION BY u ORDER BY t) AS nt FROM v),
        sp AS (SELECT u, t AS a, least(t + 30000000, coalesce(nt, t + 30000000)) AS b, s FROM n UNION ALL SELECT n.u, t + 30000000, coalesce(nt, z), -1 FROM n JOIN b USING (u) WHERE t + 30000000 < coalesce(nt, z)),
        c AS (SELECT *, lag(s) OVER (PARTITION BY u ORDER BY a) IS DISTINCT FROM s AS new FROM sp), k AS (SELECT *, sum(new::INT) OVER (PARTITION BY u ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM c), m AS (SELECT u, min(a) AS a, max(b) AS b, any_value(s) AS s FROM k GROUP BY u, i)
        SELECT 'u' || u AS import_id, unnest(['stun', 'network']) AS lane, {as_time("a")} AS start, {as_time("b")} AS "end", CASE s WHEN 0 THEN 'up' WHEN 1 THEN 'transient' WHEN 2 THEN 'down' ELSE 'unknown' END AS state,
        CASE WHEN s >= 0 THEN unnest([CASE s WHEN 0 THEN 'both_probes_answer' WHEN 1 THEN 'one_probe_silent' ELSE 'both_probes_silent' END, 'stun']) END AS reason FROM m""",
    "z8_compare": f"""WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 'a' ELSE 'b' END AS side, 'm' || user_id % 10 AS metric, event_id, value, event_id % 3 > 0 AS ok, epoch_us(ts) + CASE WHEN event_type = 'view' THEN 60000000 ELSE 0 END AS t FROM events WHERE event_type IN ('error', 'view')),
        l AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv, lag(ok) OVER w AS pok FROM e WINDOW w AS (PARTITION BY side, metric ORDER BY t)), u AS (SELECT side, metric, count(*) AS pairs FROM l WHERE ok AND pok AND t > pt AND t - pt <= 30000000 AND value >= pv GROUP BY side, metric),
        g AS (SELECT side, metric, max(value) AS peak, arg_max(t, (value, -t)) AS pt, count(*) AS samples FROM e WHERE ok GROUP BY side, metric)
        SELECT side, metric, peak, {as_time("pt")} AS peak_ts, samples, peak > 250 AS over, pairs FROM g LEFT JOIN u USING (side, metric)""",
    "z9_telemetry_job": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        SELECT 'u' || user_id AS source_id, 'media_window' AS method, n * 1000.0::DOUBLE AS start_ms, n * 1000.0::DOUBLE + 1000 AS end_ms, 100.0::DOUBLE * (event_id % 50) / 50 AS loss FROM n WHERE n > 1 AND event_id % 6 > 0""",
}
ORACLE["a17_contexts"] = f"WITH i AS ({ORACLE['i6_canonical']}) SELECT flag, sum(date_diff('second', start, \"end\"))::DOUBLE AS seconds, coalesce(sum(date_diff('second', start, \"end\")) FILTER (WHERE value < 0.05), 0)::DOUBLE AS bad FROM i GROUP BY flag"
ORACLE["z3_incident_job"] = ORACLE["a10_incident_sums"]
ORACLE["z4_transient_job"] = ORACLE["a12_transients"].replace("unnest(['click', 'error', 'mute'])", "unnest(['click', 'call_ended'])").replace("q.user_id = u AND q.event_type = type AND", "q.user_id = u AND (q.event_type = type OR (type = 'call_ended' AND q.t = (SELECT max(t) FROM q z WHERE z.user_id = u))) AND").replace("u AS user_id, type, count(*) AS intervals, count(*) FILTER (WHERE near) AS with_notice, count(*) FILTER (WHERE near AND up) AS positive_with, count(*) FILTER (WHERE NOT near AND up) AS positive_without", "u AS perspective_id, type, count(*) FILTER (WHERE near) AS with_notice").replace("t - pt <= 300000000", "t - pt <= 30000010")
ORACLE["z5_geo_job"] = f"""WITH {SQUEEZED}, f AS (SELECT user_id, t, (event_id % 50)::DOUBLE AS lat, (user_id % 50)::DOUBLE AS lon, least(t + 120000000, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t + 120000000)) AS z FROM q WHERE event_type IN ('view', 'click'))
        SELECT {cell_sql("lat", "lon", 100000.0)} AS cell, round(sum(least(p.t + 90000000, f.z) - greatest(p.t, f.t)) / 1e6, 3) AS seconds FROM q p JOIN f ON f.user_id = p.user_id AND f.t < p.t + 90000000 AND f.z > p.t WHERE p.event_type = 'purchase' GROUP BY ALL"""
ORACLE["z6_pq_map"] = f"""WITH {DIRECT.replace("WHERE bin % 100 > 0", "").replace("(bin % 101)::DOUBLE AS pq", "100.0::DOUBLE AS pq")}, {ROUTE.replace("WHERE b % 100 > 0", "").replace("30000000", "120000000").replace("(b % 101)::DOUBLE AS pq", "100.0::DOUBLE AS pq")}, es AS (SELECT {cell_sql("lat", "lon", 200.0)} AS cell, count(*) AS n FROM rt GROUP BY ALL)
        SELECT cell, CASE WHEN dc.mean IS NOT NULL THEN 'direct' ELSE 'estimated' END AS basis, 100.0::DOUBLE AS value, dc.seconds FROM dc FULL JOIN es USING (cell)"""
ORACLE["z10_switch_job"] = f"""WITH e AS (SELECT user_id AS u, event_id, event_type = 'error' AS r, CASE WHEN event_id % 2 = 0 THEN 'wifi' ELSE 'cellular' END AS state, CAST(floor((epoch_us(ts) - {BASE_US}) / 5000.0) AS BIGINT) + {BASE_US} AS t FROM events),
        c AS (SELECT a.event_id, count(*) AS n FROM e a JOIN e b ON a.u = b.u AND b.r AND abs(a.t - b.t) <= 6000000 WHERE a.r GROUP BY a.event_id),
        m AS (SELECT a.event_id, s.t, s.state, lag(s.state) OVER (PARTITION BY a.event_id ORDER BY s.t, s.state) AS p FROM e a JOIN e s ON a.u = s.u AND NOT s.r AND abs(a.t - s.t) <= 3000000 WHERE a.r),
        k AS (SELECT event_id, arg_min(state, t) AS x, arg_max(state, t) AS y FROM m WHERE p IS DISTINCT FROM state GROUP BY event_id HAVING count(*) = 2),
        w AS (SELECT a.event_id, any_value(b.event_id) AS pid FROM e a JOIN e b ON a.u = b.u AND b.event_id % 9 = 1 AND a.t BETWEEN b.t AND b.t + 20000000 WHERE a.r GROUP BY a.event_id HAVING count(*) = 1)
        SELECT e.event_id, CASE WHEN n = 1 THEN x END AS from_state, CASE WHEN n = 1 THEN y END AS to_state, pid AS perspective_id FROM e JOIN c USING (event_id) LEFT JOIN k USING (event_id) LEFT JOIN w USING (event_id) WHERE e.r"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE}

#: SQL of queries of other modules, made of the same parts.
MORE_ORACLES: dict[str, str] = {
    "c8_dedup_within_gap": f"WITH k AS ({ORACLE['c8_kept_rows'].replace(str(24 * HOUR), str(2 * HOUR))}) SELECT user_id, count(*) AS kept FROM k GROUP BY user_id",
    "i10_incident_windows": f"""WITH {PLAIN}, {BOUNDS}, w AS ({ORACLE['i10_daily_windows']}), o AS (SELECT user_id, sum(b - a) AS us FROM ep WHERE status = 'closed' AND basis <> 'unknown' GROUP BY user_id)
        SELECT user_id, count(*) AS bins, count(*) FILTER (WHERE known) AS known, round(coalesce(any_value(us), 0) / 1000, 3) AS occupied_ms FROM w LEFT JOIN o USING (user_id) GROUP BY user_id""",
    "i12_connectivity": f"WITH s AS ({ORACLE['i12_lanes']}) SELECT lane, state, count(*) AS segments, round(sum((epoch_us(\"end\") - epoch_us(start)) / 1e6), 3) AS seconds FROM s GROUP BY lane, state",
    "i16_clock_guards": """WITH d AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id * 1.0::DOUBLE AS m, epoch_us(ts) / 1000 AS wall FROM events),
        g AS (SELECT u, m < lag(m) OVER (PARTITION BY u ORDER BY seq) AS back, wall - m AS dr FROM d), h AS (SELECT bool_or(back) OVER (PARTITION BY u) AS b, max(dr) OVER (PARTITION BY u) - min(dr) OVER (PARTITION BY u) > 1000 AS far FROM g)
        SELECT 'monotonic_decrease' AS issue, count(*) AS records FROM h WHERE b HAVING count(*) > 0 UNION ALL SELECT 'clock_drift', count(*) FROM h WHERE far HAVING count(*) > 0""",
    "w6_movement": f"""WITH k AS (SELECT user_id, epoch_us(ts) AS t, 45 + value / 10000 AS lat, lag(epoch_us(ts)) OVER w AS pt, lag(45 + value / 10000) OVER w AS plat FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        r AS (SELECT CASE WHEN pt IS NULL THEN 'first_sample' WHEN t - pt > {12 * HOUR} THEN 'time_gap' WHEN t <= pt OR 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)))) > 150.0 * (t - pt) / 1e6 + 10 THEN 'implausible_jump' END AS reason FROM k)
        SELECT reason, count(*) AS samples FROM r GROUP BY reason""",
}
