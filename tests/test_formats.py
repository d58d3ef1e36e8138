"""Formats of logs, archives and telemetry that the queries over the given tables don't reach."""

import io
import json
import stat
import zipfile

from pyspark.sql import functions as F

from dialspan.operators import extract as X
from dialspan.operators import telemetry as T
from dialspan.plans import jobs as Z
from dialspan.plans import listings as L
from dialspan.sources import archives as A
from dialspan.streaming import jobs as streams


def records(spark, rows):
    """Records (name, parser, text) of one import, ten seconds apart."""
    df = spark.createDataFrame([("i", n, p, k, f"2026-01-02 10:00:{k:02d}", t) for k, (n, p, t) in enumerate(rows)], "import_id string, name string, parser string, line_no int, ts string, text string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def archive(members, broken=None):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text, link in members:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            info.external_attr = (stat.S_IFLNK if link else stat.S_IFREG) << 16
            z.writestr(info, text)
        at = next((i.header_offset for i in z.infolist() if i.filename == broken), None)
    raw = bytearray(data.getvalue())
    if at is not None:
        start = at + 30 + len(broken)
        raw[start : start + 4] = b"\xff\xff\xff\xff"
    return bytes(raw)


def test_damaged_and_linked_members(spark):
    raw = archive([("a.log", "fine", False), ("b.log", "lost " * 50, False), ("c.log", "a.log", True), ("d.log", "after", False)], "b.log")
    df = spark.createDataFrame([("x", "x.zip", bytearray(raw)), ("y", "y.zip", bytearray(b"no archive"))], "import_id string, archive string, content binary")
    got = {(r.import_id, r.name): (r.text, r.warning) for r in A.unpack(df).collect()}
    assert got == {("x", "a.log"): ("fine", None), ("x", "b.log"): (None, "unreadable"), ("x", "c.log"): (None, "symbolic link"), ("x", "d.log"): ("after", None), ("y", ""): (None, "not an archive")}


def test_periodic_sentences_and_cycles(spark):
    block = "[t] [VD 7] VD 7 (Default Audio Output) is alive and kicking\nRunning cycles (last 1000 ms) - read, write, encode, decode, idle time - : 1,2,3,4,5.\nread bytes: 42, written bytes 43\nCumulative write rate is 8000 samples per second\nAccumulated delay is 12.5 ms\nNumber of Read Errors: 3\nCurrent processing stage: RUN(4). Timestamp 10:00"
    monitor = "[t] [MON] Line 3\nNART status: PLAYING(5). Timestamp 11:00."
    rtcp = "[t] [LINE 2 FLOW 1] RTCP ARRIVED\nSSRC of this source: ab\nRTCP Message n.: 17\nSender Report - ntp timestamp received from this source: 0x1\nRTT by this source: 2500 microseconds"
    rows = records(spark, [("vdlog", "vd", block), ("vdlog", "vd", monitor), ("rtplog", "rtcp", rtcp)])
    got = {r.metric: (r.value, r.unit, r.sample_kind) for r in X.extract_periodic(rows).collect()}
    assert got == {
        "vd.cycles_read": (1.0, "count", "reported statistic"), "vd.cycles_write": (2.0, "count", "reported statistic"), "vd.cycles_encode": (3.0, "count", "reported statistic"),
        "vd.cycles_decode": (4.0, "count", "reported statistic"), "vd.cycles_idle_time": (5.0, "count", "reported statistic"), "vd.heartbeat_window": (1000.0, "ms", "interval"),
        "vd.heartbeat_bytes_read": (42.0, "bytes", "reported statistic"), "vd.heartbeat_bytes_written": (43.0, "bytes", "reported statistic"), "vd.write_rate": (8000.0, "samples/s", "gauge"),
        "vd.scheduling_delay": (12.5, "ms", "counter"), "vd.read_errors": (3.0, "count", "counter"),
    }
    states = {r.metric: r.value_json for r in X.extract_periodic_states(rows).collect()}
    assert states["vd.heartbeat_device_id"] == "7" and states["rtcp.message_number"] == "17" and states["rtcp.ntp_timestamp"] == "0x1"
    assert json.loads(states["vd.monitor_stage"]) == {"state": "PLAYING", "code": 5, "timestamp": "11:00"} and json.loads(states["vd.current_processing_stage"])["code"] == 4
    trip = X.extract_device_metrics(rows).collect()
    assert [(r.metric, r.value, r.line_id, r.flow, r.ssrc, r.direction) for r in trip] == [("rtcp.rtt", 2.5, 2, "1", "ab", "roundtrip")]


def test_connectivity_reasons(spark):
    rows = records(spark, [("app.log", "raw", "x\nNo network route"), ("ctilib.1.log", "raw", "x ConnectionTimeout"), ("sip_debug.log", "sip", "INCOMING SIP message:\nSIP/2.0 403 Forbidden\nCSeq: 1 INVITE\n"), ("phoneengine.log", "phone", "KPE change state from: a to: connecting")])
    got = {(r.layer, r.state, r.reason) for r in X.extract_connectivity(rows).collect()}
    assert got == {("device", "down", "no_route"), ("cti", "down", "service_timeout"), ("sip", "up", "answer_403_invite"), ("app", "transient", "engine_state")}


def test_notifications(spark):
    said = ["x Set isSpeakerphoneActive [TRUE]", "x Setting audio input 0 mute status to false now", "AudioState[communicationDeviceChanged -> d type='BUILTIN_SPEAKER' x", "x : Network changed from SSID: a - IP: 1 to SSID: b - IP: 1", "x : Network changed from SSID: a - IP: 1 to SSID: a - IP: 1", "Creating device NART0 of Line 2", "We reset the VOD timing to avoid continuous false warnings."]
    got = [(r.type, r.next_state) for r in X.extract_transients(records(spark, [("app.log", "raw", t) for t in said])).orderBy("line_no").collect()]
    assert got == [("speakerphone_set", "true"), ("mute_set", "false"), ("audio_route_change", "BUILTIN_SPEAKER"), ("network_configuration_change", None), ("device_created", "NART0 of Line 2"), ("scheduling_reset", None)]


def test_producers(spark):
    contact = lambda u: ("sip_debug.log", "sip", f'[t] OUTGOING SIP message:\nREGISTER sip:e SIP/2.0\nContact: <sip:a>;+sip.instance="<urn:uuid:{u}>"\n\n')
    auth = lambda s, d: ("ctilib.log", "raw", f"[t] [CTILIB] [INFO] Sending auth to CTIServer - username: u - OS: {s} - software: s - device ID: {d} - pre-shared key: k")
    good = "00000000-1111-4222-8333-444444444444"
    cases = {"fine": [contact(good), auth("ios", "d1")], "nil": [contact("00000000-0000-0000-0000-000000000000"), auth("ios", "d1")], "other": [contact(good), auth("android", "d1")], "two": [contact(good), auth("ios", "d1"), auth("ios", "d2")], "none": [contact(good)]}
    rows, files = None, None
    for name, said in cases.items():
        more = records(spark, said).withColumn("import_id", F.lit(name))
        rows = more if rows is None else rows.unionByName(more)
        own = spark.createDataFrame([(name, "ios_hwwrapper.log")], "import_id string, name string")
        files = own if files is None else files.unionByName(own)
    got = {r.import_id: (r.status, r.producer is not None) for r in X.producer_identity(X.identity_markers(files, rows)).collect()}
    assert got == {"fine": ("resolved", True), "nil": ("ambiguous", False), "other": ("ambiguous", False), "two": ("ambiguous", False), "none": ("unknown", False)}


def test_members_of_lists(spark):
    body = dict(schema="telemetry/1", type="session", event_id="e", source_id="s", session_id="x", boot_id="b", seq=1, role="app", observed_utc="2026-01-02T10:00:00Z", mono_ms=1, validity="valid", invalid_reason=None)
    payload = dict(platform="ios", os_version="1", app_version="1", media_version="1", clock_uncertainty_ms=None, capabilities=[dict(name="a", status="available"), dict(name="b", status="odd"), dict(name="c"), 7])
    assert T.line_issues(json.dumps(body | {"payload": payload})) == ["$.payload.capabilities[1].status: invalid", "$.payload.capabilities[2].status: missing", "$.payload.capabilities[3]: not an object"]
    assert T.line_issues(json.dumps(body | {"payload": payload | {"capabilities": []}, "observed_utc": "2026-13-02T10:00:00Z"})) == ["$.observed_utc: invalid"]


def test_loads_are_not_repeated(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    (source / "a.zip").write_bytes(archive([("a.log", "one", False)]))
    streams.stream_ingest(spark, str(source), str(target), str(tmp_path / "c1")).awaitTermination()
    (source / "b.zip").write_bytes((source / "a.zip").read_bytes())  # the same bytes again
    (source / "c.zip").write_bytes(archive([("c.log", "two", False)]))
    streams.stream_ingest(spark, str(source), str(target), str(tmp_path / "c1")).awaitTermination()
    streams.stream_ingest(spark, str(source), str(target), str(tmp_path / "c2")).awaitTermination()  # another checkpoint reads all again
    assert sorted(r.text for r in spark.read.parquet(str(target)).collect()) == ["one", "two"]


def test_reception_of_the_peer(spark):
    rows = spark.createDataFrame([(1, "incoming", 10), (1, "outgoing", 11), (2, "incoming", 20), (3, "outgoing", 31)], "perspective_id long, direction string, v long")
    pairs = spark.createDataFrame([(1, 2, "gw"), (3, None, "app")], "perspective_id long, peer_id long, role string")
    got = {(r.perspective_id, r.v, r.way, r.basis) for r in L.peer_reception(rows, pairs).collect()}
    assert got == {(1, 10, "upstream", "local"), (1, 20, "downstream", "peer_local"), (3, 31, "upstream", "remote_rtcp")}


def test_comparison_with_incidents_and_versions(spark):
    side = lambda v: spark.createDataFrame([("m", "ms", f"2026-01-02 10:00:{s:02d}", s, float(v + s), True) for s in (0, 10)], "metric string, unit string, ts string, ord long, value double, valid boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    signals = spark.createDataFrame([("a", "start", 0, None), ("a", "end", 5_000_000, None)], "side string, phase string, t_us long, duration_ms double")
    versions = spark.createDataFrame([("b", "2026-01-02 09:00:00", "v1")], "side string, ts string, version string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = Z.compare_ab(side(1), side(100), 5_000_000, 50.0, signals, versions)
    assert {(r.side, r.peak, r.over) for r in out["peaks"].collect()} == {("a", 11.0, False), ("b", 110.0, True)}
    assert sorted(r.value for r in out["together"].collect()) == [106.0, 116.0] and out["incidents"].first().status == "closed"
    assert {(r.side, r.version) for r in out["versions"].collect()} == {("a", None), ("b", "v1")} and out["counters"].count() == 2
