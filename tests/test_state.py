"""Calls, incidents, continuity, connectivity, movement, telemetry and streams: hand-checked cases."""

import json
import struct

from pyspark.sql import functions as F

from dialspan.operators import calls as C
from dialspan.operators import incidents as N
from dialspan.operators import intervals as I
from dialspan.operators import network as K
from dialspan.operators import telemetry as T
from dialspan.operators import windows as W
from dialspan.streaming import jobs

SEC = 1_000_000


def times(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("ts", "start", "end", "connected", "begin", "stop") else F.col(c) for c in df.columns])


def at(second):
    return f"2026-01-02 10:{int(second) // 60:02d}:{second % 60:09.6f}"


def test_counter_status(spark):
    rows = [("a", at(t), n, float(v), v >= 0) for n, (t, v) in enumerate([(0, 10), (5, 30), (10, 2), (15, -1), (17, 4), (20, 5), (20, 6), (22, 7), (80, 8)])]
    df = times(spark, rows, "k string, ts string, ord long, value double, valid boolean")
    got = [r.status for r in W.counter_intervals(df, ["k"], ["ord"]).orderBy("ord").collect()]
    assert got == ["initial", "ok", "reset", "invalid", "invalid", "conflict", "conflict", "conflict", "gap"]
    located = W.located_deltas(df.withColumn("h", F.lit(1)), ["k"], ["h"]).collect()
    assert [r.delta for r in located] == [20.0]


def test_hold_and_episodes(spark):
    df = times(spark, [("p", at(5), 2.0, True), ("p", at(10), 12.0, True), ("q", at(0), 30.0, True), ("q", at(5), -1.0, False), ("q", at(10), 30.0, True)], "k string, ts string, value double, valid boolean")
    held = I.hold_intervals(df.withColumn("stop", F.lit("2026-01-02 10:00:20").cast("timestamp_ntz")), ["k"], valid=F.col("valid"), stop="stop")
    got = {(r.k, str(r.start)[-2:], str(r.end)[-2:], r.value) for r in held.collect()}
    assert got == {("p", "05", "10", 2.0), ("p", "10", "20", 12.0), ("q", "00", "05", 30.0), ("q", "10", "20", 30.0)}
    bad = W.bad_episodes(held, ["k"], F.col("value") > 10).groupBy("k").count().collect()
    assert {(r[0], r[1]) for r in bad} == {("p", 1), ("q", 2)}


def test_incidents(spark):
    signals = [("m", "missing", 10 * SEC, 5000.0), ("m", "end", 12 * SEC, None), ("u", "start", 1 * SEC, None), ("u", "start", 1 * SEC, None), ("u", "ongoing", 2 * SEC, 900.0), ("u", "end", 3 * SEC, 600.0), ("o", "end", 5 * SEC, 400.0), ("x", "end", 5 * SEC, None), ("y", "start", 1 * SEC, None), ("y", "start", 4 * SEC, None)]
    df = spark.createDataFrame(signals, "k string, phase string, t_us long, duration_ms double")
    got = {(r.k, r.start_us // SEC): r for r in N.reconstruct_incidents(df, ["k"]).collect()}
    assert (got["m", 5].duration_ms, got["m", 5].duration_basis, got["m", 5].start_basis) == (7000.0, "minimum", "threshold")
    assert (got["u", 1].duration_ms, got["u", 1].duration_basis, got["u", 1].signals) == (600.0, "reported", 3)
    assert (got["o", 4].start_us, got["o", 4].start_basis) == (4_600_000, "reported_duration")
    assert (got["x", 5].start_basis, got["x", 5].duration_ms) == ("unknown", None)
    assert got["y", 1].status == got["y", 4].status == "open"
    e = spark.createDataFrame([("s", 2_800_000, 3_400_000, 600.0, "reported", "observed", "closed")], "k string, start_us long, end_us long, duration_ms double, duration_basis string, start_basis string, status string")
    bounds = spark.createDataFrame([("s", 0, 0, 5 * SEC)], "k string, anchor_us long, begin_us long, stop_us long")
    rows = N.incident_windows(N.place_incidents(e), bounds, ["k"], SEC).orderBy("bin").collect()
    assert [round(r.percent, 6) for r in rows] == [0, 0, 20, 40, 0]
    still = e.withColumns({"status": F.lit("open"), "end_us": F.lit(None).cast("long")})
    rows = N.incident_windows(N.place_incidents(still), bounds, ["k"], SEC).orderBy("bin").collect()
    assert [r.percent for r in rows] == [0, 0, None, None, None]
    calls = spark.createDataFrame([(1, 500_000, 5 * SEC), (2, 0, SEC)], "perspective_id long, begin_us long, stop_us long")
    pq = N.pq_windows(e.withColumn("perspective_id", F.lit(1).cast("long")), calls, ["k"]).orderBy("perspective_id", "bin").collect()
    assert [round(r.pq, 6) for r in pq] == [100, 100, 80, 60, 100, 100] and pq[-1].k == "assumed"


def test_calls(spark):
    life = times(spark, [("i", 1, at(0), 1, "added", None), ("i", 1, at(2), 2, "connected", None), ("i", 1, at(9), 3, "ended", None), ("i", 1, at(10), 4, "summary", "c1"), ("i", 1, at(20), 5, "added", None), ("i", 1, at(30), 6, "added", None)], "import_id string, line_id int, ts string, ord long, event string, call_id string")
    legs = C.reconstruct_legs(life)
    got = [(str(r.start)[-2:], r.call_id, r.incomplete) for r in legs.orderBy("leg").collect()]
    assert got == [("00", "c1", False), ("20", None, True), ("30", None, False)]
    sip = times(spark, [("i", "c1", at(0), 1, "INVITE", None, "outgoing", "a", "b"), ("i", "c1", at(3), 2, "INVITE", 200, "incoming", "a", "b"), ("i", "c2", at(1), 3, "INVITE", None, "incoming", "x", "a"), ("i", "c2", at(4), 4, "INVITE", 486, "outgoing", "x", "a")], "import_id string, call_id string, ts string, ord long, method string, response int, direction string, caller string, callee string")
    p = {r.call_id: r for r in C.build_perspectives(legs.where("call_id IS NOT NULL"), sip).collect()}
    assert (p["c1"].status, p["c1"].direction) == ("completed", "outgoing") and (p["c2"].status, str(p["c2"].end)[-2:]) == ("failed", "04")
    assert [r.call_id for r in C.sip_only_legs(sip, legs).collect()] == ["c2"]
    lone = C.reconstruct_legs(times(spark, [("i", 1, at(5), 1, "summary", "c9"), ("i", 1, at(6), 2, "added", None), ("i", 1, at(7), 3, "summary", "c8"), ("i", 1, at(8), 4, "summary", "c7")], "import_id string, line_id int, ts string, ord long, event string, call_id string"))
    assert {(r.call_id, r.start is None, r.leg) for r in lone.collect()} == {("c9", True, None), ("c8", False, 1), ("c7", True, None)}
    refer = times(spark, [("i", "c5", at(0), 1, "INVITE", None, "outgoing", "a", "b"), ("i", "c5", at(1), 2, "INVITE", 200, "incoming", "a", "b"), ("i", "c5", at(3), 3, "REFER", 503, "incoming", "a", "b")], "import_id string, call_id string, ts string, ord long, method string, response int, direction string, caller string, callee string")
    one = C.build_perspectives(C.sip_only_legs(refer, lone).withColumns({c: F.lit(None).cast(t) for c, t in (("connected", "timestamp_ntz"), ("end", "timestamp_ntz"), ("line_id", "int"), ("incomplete", "boolean"))}), refer).first()
    assert one.status == "connected / partial" and one.end is None
    open_ = times(spark, [("k", at(0), None), ("k", at(10), None), ("k", at(20), at(21))], "k string, start string, end string")
    bounded = C.bound_open_windows(open_, times(spark, [("k", at(30))], "k string, ts string"), ["k"], times(spark, [("k", at(5))], "k string, ts string")).orderBy("start").collect()
    assert [(r.end.second, r.end_basis) for r in bounded] == [(5, "terminate_event"), (30, "last_call_evidence"), (21, "observed_termination")]
    members = C.conversation_groups(times(spark, [("u", "a", at(0)), ("u", "b", at(1)), ("w", "b", at(1))], "uuid string, call_id string, start string"), times(spark, [("z", at(0)), ("z", at(1)), ("a", at(0))], "call_id string, start string"), sessions=spark.createDataFrame([(7, "a")], "session long, call_id string"))
    assert {(r.group, r.call_id, r.review) for r in members.collect()} == {("uuid:u", "a", True), ("uuid:u", "b", True), ("uuid:w", "b", True), ("call:z", "z", False), ("session:7", "a", False)}
    many = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "x")], "import_id string, import_seq long, call_id string")
    assert {tuple(r)[2:] for r in C.import_counts(many).collect()} == {(2, 2, 0), (1, 0, 1)}
    producers = spark.createDataFrame([("a", "resolved", "P"), ("b", "resolved", "P")], "import_id string, status string, producer string")
    marks = {(r.import_id, r.call_id): r.duplicate_of for r in C.mark_duplicates(many, producers).collect()}
    assert marks == {("a", "x"): None, ("a", "y"): None, ("b", "x"): "a"}
    near = times(spark, [("k", at(0)), ("k", at(0.6)), ("k", at(1.2)), ("k", at(9))], "k string, ts string")
    assert C.dedup_within_gap(near, ["k"]).count() == 3


def test_connectivity_and_movement(spark):
    events = times(spark, [("i", at(1), 1, "stun", "up"), ("i", at(4), 2, "stun", "down"), ("i", at(5), 3, "cti", "up")], "k string, ts string, ord long, layer string, state string")
    bounds = times(spark, [("i", at(0), at(40))], "k string, begin string, stop string")
    lane = K.connectivity_timeline(events, bounds, ["k"]).where("lane = 'network'").orderBy("start").collect()
    assert [r.state for r in lane] == ["unknown", "up", "down", "transient", "up", "unknown"]
    fix = lambda t, lat, ok=True: ("i", t * SEC, ok, lat, 9.0, 5.0, None, None)
    fixes = spark.createDataFrame([fix(0, 45.0), fix(5, 45.001), fix(10, 46.0), fix(15, 46.0001, False), fix(20, 46.0001), fix(90, 46.0002)], "import_id string, t_us long, ok boolean, latitude double, longitude double, accuracy double, elapsed string, elapsed_s double")
    got = [(r.ordinal, r.reason) for r in K.movement_sequences(fixes).orderBy("t_us").collect()]
    assert got == [(1, "first_sample"), (2, None), (1, "implausible_jump"), (1, "ambiguous_or_invalid"), (1, "time_gap")]
    same = lambda t, lat, text: ("j", t * SEC, True, lat, 9.0, 5.0, text, None)
    fixes = spark.createDataFrame([same(0, 45.0, "+5s"), same(5, 45.0, "+5s"), same(10, 45.1, "+5s"), same(15, 45.0, "+5s"), same(100, 45.0, "+5s"), fix(0, 45.0), fix(5, 45.0, False), fix(100, 45.0)], "import_id string, t_us long, ok boolean, latitude double, longitude double, accuracy double, elapsed string, elapsed_s double")
    got = [(r.import_id, r.t_us // SEC, r.reason) for r in K.movement_sequences(fixes).orderBy("import_id", "t_us").collect()]
    assert got == [("i", 0, "first_sample"), ("i", 100, "ambiguous_or_invalid"), ("j", 0, "first_sample"), ("j", 15, "conflicting_fix"), ("j", 100, "time_gap")]
    requests = times(spark, [("i", 1, at(10)), ("i", 2, at(50))], "k string, request_id long, ts string")
    states = times(spark, [("i", at(9), "wifi"), ("i", at(11), "lte"), ("i", at(49), "lte")], "k string, ts string, state string")
    got = {r.request_id: (r.from_state, r.to_state) for r in K.nearby_transition(requests, states, ["k"]).collect()}
    assert got == {1: ("wifi", "lte"), 2: (None, None)}


def record(**over):
    body = dict(schema="telemetry/1", type="collection", event_id="e1", source_id="s", session_id="x", boot_id="b", seq=1, role="app", observed_utc="2026-01-02T10:00:00Z", mono_ms=1.0, validity="valid", invalid_reason=None, payload=dict(subsystem="media", status="started", reason="r", dropped_events=None))
    return json.dumps(body | over)


def test_telemetry(spark):
    lines = [record(), "{", record(extra=1), record(role="x"), record(validity="invalid"), record(type="plan_state"), record(payload=dict(subsystem="media"))]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n long, raw string")
    got = {r.n: r.issues for r in T.validate_telemetry(rows).collect()}
    assert got[0] == [] and got[1] == ["$: not JSON"] and got[2] == ["$.extra: unknown"] and got[3] == ["$.role: invalid"]
    assert len(got[4]) == 1 and got[5] == ["$.type: unknown"] and len(got[6]) == 2
    packet = struct.pack("!BBHI", 0x81, 201, 7, 99) + struct.pack("!IIIIII", 7, (3 << 24) | 0xFFFFFB, 200, 0, 0, 0)
    df = spark.createDataFrame([(1, bytearray(packet)), (2, bytearray(packet[:-4])), (3, bytearray(b"\x81"))], "n long, packet binary")
    got = {r.n: (r.blocks, r.rtcp_issue) for r in T.decode_rtcp(df).collect()}
    assert tuple(got[1][0][0]) == (99, 7, -5, 200) and got[2][1] == "rtcp_framing" and got[3][1] == "rtcp_truncated"
    reports = spark.createDataFrame([("s", 0.0, 1, 100, 0, True), ("s", 1000.0, 1, 200, 5, True), ("s", 2000.0, 1, 50, 0, True)], "k string, mono_ms double, reporter long, highest long, lost long, ok boolean")
    got = [(r.loss, r.issue) for r in T.rtcp_intervals(reports, ["k"]).orderBy("end_ms").collect()]
    assert got == [(None, "rtcp_baseline_only"), (5.0, None), (None, "rtcp_counter_reset")]
    spans = spark.createDataFrame([("s", "media_window", 0, 10), ("s", "rtcp", 5, 15), ("s", "rtcp", 20, 30), ("s", "rtcp", 25, 35), ("s", "rtcp", 40, 50)], "k string, method string, start_ms long, end_ms long")
    assert {(r.method, r.start_ms) for r in T.suppress_overlaps(spans, ["k"]).collect()} == {("media_window", 0), ("rtcp", 40)}
    copies = spark.createDataFrame([("s", "e", 1, "a"), ("s", "e", 2, "b"), ("s", "f", 3, "a")], "source_id string, event_id string, line long, raw string")
    assert {(r.event_id, r.raw, r.copies, r.conflict) for r in T.telemetry_canonical(copies, ["line"]).collect()} == {("e", "a", 2, True), ("f", "a", 1, False)}


def run_stream(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [("a", 0, "up", "start"), ("a", 10, "down", "end"), ("a", 100, "up", "start"), ("z", 5000, "up", "start")]
    spark.createDataFrame(rows, "k string, s long, state string, phase string").withColumn("ts", F.timestamp_seconds(F.col("s") + 600)).coalesce(1).write.parquet(str(tmp_path / "in1"))
    source = spark.readStream.schema("k string, s long, state string, phase string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = {(r.k, r.start.second, r.state, r.ended_by) for r in run_stream(jobs.stream_state_ttl(source, "k"), "ttl").where("k = 'a'").collect()}
    assert got == {("a", 0, "up", "next"), ("a", 10, "down", "expiry"), ("a", 40, "up", "expiry")}
    got = [(r.start.second, r.end.second) for r in run_stream(jobs.stream_incidents(source, "k"), "inc").collect()]
    assert got == [(0, 10)]
    mos = source.select("k", "ts", F.lit(2.0).alias("seconds"), F.when(F.col("state") == "up", 4.0).otherwise(2.0).alias("mos"))
    got = {(r.covered, r.bad) for r in run_stream(jobs.stream_bad_windows(mos, ["k"], 3.0), "bad").where("k = 'a'").collect()}
    assert got == {(4.0, 2.0), (2.0, 0.0)}
