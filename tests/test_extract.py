"""Text records and what is extracted from them, on fixtures written for these tests."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from dialspan.operators import extract as X
from dialspan.sources import archives as S


def engine(second, text, tag="KPECORE", level="INFO"):
    return f"[2026-01-02 10:00:{second:06.3f}] [{tag}] [{level}] {text}"


def records(spark, name, parser, *texts, ts="2026-01-02 10:00:05"):
    rows = [("i", name, parser, n * 10 + 1, ts, t) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "import_id string, name string, parser string, line_no int, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_archives_split_and_flag(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("kpelog.txt", "head\r\r\n" + engine(1, "a") + "\nmore\n" + engine(2, "b"))
        z.writestr("kpelog.1.txt", engine(1, "a") + "\nmore\n")
        z.writestr("../evil.txt", "x")
        z.writestr("pic.bin", b"\0\1")
    both = spark.createDataFrame([("h", "a.zip", bytearray(data.getvalue())), ("h", "b.zip", bytearray(data.getvalue())), ("g", "c.zip", bytearray(b"no zip"))], "import_id string, archive string, content binary")
    files = S.unpack(both)
    warnings = {r.name: r.warning for r in files.collect()}
    assert warnings == {"kpelog.txt": None, "kpelog.1.txt": None, "../evil.txt": "unsafe path", "pic.bin": "not text", "": "not an archive"}
    good = files.where("warning IS NULL").select("import_id", "name", S.classify_file("name").alias("parser"), "text")
    rows = X.split_records(good)
    got = [(r.name, r.line_no, str(r.ts), r.text) for r in rows.orderBy("name", "line_no").collect()]
    assert [g[1] for g in got] == [1, 1, 2, 4] and got[1][2] == "None" and got[2][3].endswith("a\nmore")
    flagged = X.flag_rotation_duplicates(rows).where("duplicate").collect()
    assert [(r.name, r.line_no) for r in flagged] == [("kpelog.txt", 2)]
    assert {r[0] for r in good.select("parser").collect()} == {"kpe"}
    assert S.new_imports_only(both, spark.createDataFrame([("h",)], "import_id string")).count() == 1


def test_timestamps(spark):
    lines = ["[2026-01-02 10:00:00.5] x", "2026-01-02 10:00:00 x", "INFO | 20260102-100000.25 x", "no", "[2026-13-02 10:00:00] x"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(X.parse_timestamp("line").alias("t")).collect()
    assert [str(r.t) for r in rows] == ["2026-01-02 10:00:00.500000", "2026-01-02 10:00:00", "2026-01-02 10:00:00.250000", "None", "None"]


def test_sip(spark):
    text = engine(1, "OUTGOING SIP message:", "SIPDEBUG") + "\nINVITE sip:b@example.test SIP/2.0\nFrom: <sip:a@example.test>\nTo: <sip:b@example.test>;tag=1\nCall-ID: c1\nCSeq: 1 INVITE\nX-Call-UUID: 12345678-1234-1234-1234-123456789abc\nX-Location: geo:45.5,9.25;u=3\n\nX-Location: geo:1,1"
    cancel = engine(1, "INCOMING SIP message:", "SIPDEBUG") + "\nCANCEL sip:b@example.test SIP/2.0\nCall-ID: c1\nCSeq: 1 CANCEL\nReason: SIP;cause=200;text=\"Call completed elsewhere\"\n\n"
    answer = engine(1, "INCOMING SIP message:", "SIPDEBUG") + "\nSIP/2.0 486 Busy\nCall-ID: c1\nCSeq: 1 INVITE\n\n"
    r = records(spark, "sip_debug.log", "sip", text, cancel, answer)
    sip = X.decode_sip(r)
    got = {(x.method, x.response, x.direction): x for x in sip.collect()}
    assert got["INVITE", None, "outgoing"].caller == "a@example.test" and got["INVITE", 486, "incoming"].call_id == "c1"
    assert [x.uuid for x in X.extract_call_uuid(sip).collect()] == ["12345678-1234-1234-1234-123456789abc"]
    assert [x.outcome for x in X.extract_leg_outcome(sip).collect()] == ["answered_elsewhere"]
    assert [(x.latitude, x.longitude, x.kind) for x in X.extract_positions(r).collect()] == [(45.5, 9.25, "sip_local")]
    assert [(x.layer, x.state) for x in X.extract_connectivity(r).collect()] == [("sip", "up")]
    assert [x.type for x in X.extract_transients(r).collect()] == ["sip_reinvite"]
    assert {x.account for x in X.identity_candidates(sip).collect()} == {"a@example.test"}


def test_metrics(spark):
    block = engine(5, "LINE 1 FLOW 0 RTCP ARRIVED") + "\nSSRC of this source: 77\nPacket loss we perceive from this source (since last report): 2.5%\nJitter we perceive from this source (since last report): 7 ms\nReceiver Report - remote peer pkt loss (since last RR): -1%\nReceiver Report - pkt lost by this peer (total): 1.5"
    got = {(x.metric, x.direction): (x.value, x.valid, x.flow, x.ssrc) for x in X.extract_rtcp(records(spark, "rtplog", "rtcp", block)).collect()}
    assert got == {("rtcp.loss", "incoming"): (2.5, True, "0", "77"), ("rtcp.jitter", "incoming"): (7.0, True, "0", "77"), ("rtcp.loss", "outgoing"): (-1.0, False, "0", "77"), ("rtcp.packets_lost_total", "outgoing"): (1.5, False, "0", "77")}
    body = json.dumps({"incoming": {"rtp": {"rtp_pkt_lost": {"sum": "4", "bad": "N/A", "inf": "Infinity"}, "x": {"last": "-2"}}}, "outgoing": {}})
    stats = {(x.metric, x.statistic): (x.value, x.unit, x.valid) for x in X.extract_flow_stats(records(spark, "callinfo", "callinfo", "call flow metric line 1: " + body)).collect()}
    assert stats == {("kpe.rtp.rtp_pkt_lost", "sum"): (4.0, "packets", True), ("kpe.rtp.x", "last"): (-2.0, "raw", False)}
    ping = X.extract_ping(records(spark, "callinfo", "callinfo", "received 64 bytes from x time=12.5 ms")).collect()
    assert [(p.value, p.metric) for p in ping] == [(12.5, "network.ping")]


def test_devices(spark):
    old = "head\nDevice name: NART0 of Line 1\nbuffer len in usecs: 40000\nsilence msecs skipped so far: 12\nDevice name: Default Audio Output\nbuffer len in usecs: 9"
    got = [(x.metric, x.value, x.line_id, x.flow) for x in X.extract_device_metrics(records(spark, "vdlog", "vd", old)).collect()]
    assert got == [("vd.buffer", 40.0, 1, "0"), ("vd.silence_skipped", 12.0, 1, "0")]
    new = "[2026-01-02 10:00:05.000] [Default Audio Output] READING Virtual Output Device Running Info\nDevice name: Default Audio Output\nAudio currently in buffer (ms): 20\nCONNECTED INPUT DEVICE\nDevice name: NART0 of Line 1\nnumber of buffer underruns occurred on this ring for this VOD: 3.5\nring hard max buffer usecs: 1000\nCurrently in partial buffer underrun: yes\nLast written RTP SN: 17"
    r = records(spark, "vdlog", "vd", new)
    rows = {x.metric: x for x in X.extract_periodic(r).collect()}
    assert rows["vd.buffer"].input_device == "" and rows["vd.buffer"].line_id is None
    assert not rows["vd.underruns"].valid and rows["vd.underruns"].line_id == 1 and rows["vd.underruns"].output_device == "Default Audio Output"
    assert (rows["vd.buffer_hard_max"].value, rows["vd.buffer_hard_max"].unit) == (1.0, "ms")
    states = {x.metric: x.value_json for x in X.extract_periodic_states(r).collect()}
    assert states == {"vd.currently_in_partial_buffer_underrun": "true", "vd.last_written_rtp_sn": "17"}
    gap = "[x] [NART0 of Line 1] Packet loss occurred. Current packet SN is 10. Previous packet SN was 6 SN delta is 4 ( 3 missing packets)."
    assert [(g.value, g.line_id) for g in X.extract_missing_packets(records(spark, "vdlog", "vd", gap)).collect()] == [(3.0, 1)]


def test_places_networks_and_notices(spark):
    fix = "2026-01-02 10:00:07:250 app : New location received: Location[fused 45.5,9.25 hAcc=12.0 et=+1h2m3s4ms]\nLocation[gps 91,0 hAcc=1]"
    rows = X.extract_positions(records(spark, "app.log", "raw", fix)).orderBy("offset").collect()
    assert [(str(x.ts), x.kind, x.valid, x.elapsed) for x in rows] == [("2026-01-02 10:00:07.250000", "fresh", True, "+1h2m3s4ms"), ("2026-01-02 10:00:07.250000", "cached", False, None)]
    config = engine(1, 'Adding extra headers to sip messages: {"extraHeaders":[{"headerName":"X-Location","values":[{"headerVal":"geo:45,9;u=1"},{"headerVal":"geo:45,9;u=2"},{"headerVal":"no"}]}]}')
    assert [(x.latitude, x.longitude) for x in X.extract_config_positions(records(spark, "kpelog", "kpe", config)).collect()] == [(45.0, 9.0)]
    net = X.extract_network_obs(records(spark, "app.log", "raw", "t : Current network interface: wifi", 'x ProcessCallLogger : DeviceStatus: {"connectionType":"CELLULAR"}')).collect()
    assert {(x.access, x.upstream) for x in net} == {("wifi", "unknown"), ("cellular", "mobile_direct")}
    switch = X.extract_network_switches(records(spark, "kpelog.txt", "kpe", engine(1, "KPE was requested to handle a switchNetworkEvent from Wi-Fi to lte"), engine(1, "KPE was requested to handle a switchNetworkEvent"), engine(1, "x KPE was requested to handle a switchNetworkEvent"))).orderBy("line_no").collect()
    assert [(x.previous, x.next, x.transition_basis) for x in switch] == [("wifi", "lte", "explicit_fields"), (None, None, "not_reported")]
    notes = X.extract_transients(records(spark, "app.log", "raw", "Set isSpeakerphoneActive [TRUE]", "Received route change notification: AVAudioSessionRouteChangeReason(rawValue: 3)", "x : Network changed from SSID: a - IP: 1 to SSID: a - IP: 1", "x : Network changed from SSID: a - IP: 1 to SSID: b - IP: 1")).collect()
    assert {(x.type, x.next_state, x.detail) for x in notes} == {("speakerphone_set", "true", "set_operation"), ("audio_route_change", None, "reason_code:3"), ("network_configuration_change", None, "ssid_or_ip_changed_not_interface_proof")}
    signals = X.extract_incident_signals(records(spark, "vdlog", "vd", "[t] [NART0 of Line 1] [INFO] Buffer underrun occurred for input device NART0 of Line 1 .", "[t] [NART0 of Line 1] [INFO] Buffer underrun event terminated for input device NART0 of Line 1 . Event was 600 msecs long.", "Line 1 reported that flow 0 has not received RTP media for more than 5 seconds")).orderBy("line_no").collect()
    assert [(x.kind, x.phase, x.duration_ms, x.line_id) for x in signals] == [("buffer_underrun", "start", None, 1), ("buffer_underrun", "end", 600.0, 1), ("media_missing", "missing", 5000.0, 1)]
    states = X.extract_connectivity(records(spark, "vdklog.txt", "raw", "x Network UP for both pingers", "x Network DOWN for ONE pingers")).orderBy("line_no").collect()
    assert [(x.layer, x.state) for x in states] == [("stun", "up"), ("stun", "transient")]
