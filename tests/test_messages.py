"""The grammar of lines and messages, and the marks of records."""

import pytest
from pyspark.sql import functions as F

from dialspan.operators import extract as X
from dialspan.operators import marks as R
from dialspan.operators import messages as M
from dialspan.sources.staging import staged

from .test_extract import engine

INVITE = "\nINVITE sip:b@example.test SIP/2.0\nTo : <sip:b@example.test>;tag=1\ni: c1\nCSeq: 1 INVITE\nX-Location: geo:45.5,9.25;u=3"


def texts(spark, *values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, text string")


def test_shapes_of_times(spark):
    said = ["[2026-01-02 10:00:00.1234567] x", "[[2026-01-02 10:00:00] x", " 2026-01-02 10:00:00", "2026-1-02 10:00:00", "a b | 20260102-100000.5", "INFO  |20260102-100000.5", "INFO | 20260102-100000", "", None]
    got = [r.t and str(r.t) for r in texts(spark, *said).orderBy("n").select(M.parse_timestamp("text").alias("t")).collect()]
    assert got == ["2026-01-02 10:00:00.123456", None, None, None, None, "2026-01-02 10:00:00.500000", None, None, None]
    got = [r.t and str(r.t) for r in texts(spark, "2026-01-02 10:00:07:250 x", "2026-01-02 10:00:07:2500 x", "2026-01-02 10:00:07.250 x", None).orderBy("n").select(M.millisecond_stamp(F.col("text")).alias("t")).collect()]
    assert got == ["2026-01-02 10:00:07.250000", None, None, None]


def test_messages(spark):
    said = ["head" + INVITE + "\n\nX-Late: 1", "head\nSIP/2.0 486 Busy here\nCSeq: 2 BYE", "SIP/2.0 x\ninvite sip:a SIP/2.0\nINVITE tel:1 SIP/2.0", "no message", None]
    rows = M.with_headers(texts(spark, *said)).orderBy("n").select("_title", F.size("_headers").alias("n"), M.header("to", "t").alias("to"), M.header("x-late").alias("late"), M.response_code(F.col("_title")).alias("code")).collect()
    assert [(r._title, r.to, r.late, r.code) for r in rows[:2]] == [("INVITE sip:b@example.test SIP/2.0", "<sip:b@example.test>;tag=1", None, None), ("SIP/2.0 486 Busy here", None, None, 486)]
    assert [r.n for r in rows[:2]] == [4, 1] and all(r._title is None for r in rows[2:])
    ids = [r.c for r in texts(spark, "x\n  call-id: k more", "x\ni: c1", "Call-ID k", None).orderBy("n").select(X.call_id_of().alias("c")).collect()]
    assert ids == ["k", None, None, None]


def test_parts_of_lines(spark):
    tags = [r.m and tuple(r.m) for r in texts(spark, "[t] [A] [INFO] m [x] ]", "[t] [A] m", "t [A] [INFO] m", None).orderBy("n").select(M.tagged(F.col("text")).alias("m")).collect()]
    assert tags == [("A", "INFO", "m [x] ]"), None, None, None]
    places = [r.g and tuple(r.g) for r in texts(spark, "geo:45,-9.5;u=1", "geo:1,2,3", "geo:x,NaN", "45,9", None).orderBy("n").select(M.geo_uri(F.col("text")).alias("g")).collect()]
    assert places == [(45.0, -9.5), None, (None, None), None, None]
    good = [r.u for r in texts(spark, "0123abcd-0000-0000-0000-00000000000f", M.NIL_UUID, "0123abcd-0000-0000-0000-00000000000g", "0123abcd", None).orderBy("n").select(M.is_uuid(F.col("text")).alias("u")).collect()]
    assert good == [True, False, False, False, False]


EXTRACTORS = {
    X.extract_rtcp: ["rtcp"], X.extract_flow_stats: ["flow_stats"], X.extract_ping: ["ping"], X.extract_device_metrics: ["devices", "rtcp"], X.extract_missing_packets: ["gaps"],
    X.extract_periodic: ["devices"], X.extract_periodic_states: ["devices", "rtcp"], X.extract_positions: ["positions"], X.extract_config_positions: ["config_positions"], X.extract_network_obs: ["networks"],
    X.extract_connectivity: ["connectivity"], X.extract_transients: ["transients"], X.extract_network_switches: ["switches"], X.extract_incident_signals: ["signals"], X.decode_sip: ["sip"], X.extract_app_versions: ["versions"],
}


@pytest.fixture(scope="module")
def marked_records(spark):
    said = [
        ("rtplog", "rtcp", "[t] [LINE 2 FLOW 1] RTCP ARRIVED\nSSRC of this source: ab\nRTT by this source: 2500 microseconds\nRTCP Message n.: 17\nJitter we perceive from this source (since last report): 7 ms"),
        ("callinfo", "callinfo", 'call flow metric line 1: {"incoming":{"rtp":{"x":{"last":"2"}}}}'), ("callinfo", "callinfo", "received 64 bytes from x time=12.5 ms"),
        ("vdlog", "vd", "head\nDevice name: NART0 of Line 1\nbuffer len in usecs: 40000"), ("vdlog", "vd", "[t] [VD 7] VD 7 (Default Audio Output) is alive and kicking\nread bytes: 42, written bytes 43"),
        ("vdlog", "vd", "[x] [NART0 of Line 1] Packet loss occurred. Current packet SN is 10. Previous packet SN was 6 SN delta is 4 ( 3 missing packets)."),
        ("vdlog", "vd", "Line 1 reported that flow 0 has not received RTP media for more than 5 seconds"), ("vdlog", "vd", "[t] [a] BUFFER UNDERRUN Buffer underrun occurred for input device NART0 of Line 1 ."),
        ("app.log", "raw", "2026-01-02 10:00:07:250 New location received: Location[fused 45.5,9.25 hAcc=12.0 et=+1h]"), ("app.log", "raw", "t : Current network interface: wifi"), ("app.log", "raw", "x\nNo network route"),
        ("app.log", "raw", "Set isSpeakerphoneActive [TRUE]"), ("app.log", "raw", "a/NetworkMonitor x : Network is lost"), ("app.log", "raw", "Creating device NART0 of Line 2"), ("app.log", "raw", "app name: a\nversion: 1"),
        ("kpelog.txt", "kpe", engine(1, 'Adding extra headers to sip messages: {"extraHeaders":[{"headerName":"X-Location","values":[{"headerVal":"geo:45,9"}]}]}')),
        ("kpelog.txt", "kpe", engine(1, "KPE was requested to handle a switchNetworkEvent from Wi-Fi to lte.")), ("sip_debug.log", "sip", engine(1, "INCOMING SIP message:") + INVITE), ("vdklog.txt", "raw", "x Network UP for both pingers"), ("x.log", None, None),
        ("app.log", "raw", "APP VERSION: 7"), ("app.log", "raw", "version: 2 application name = b"),
    ]
    rows = [("i", n, p, k, "2026-01-02 10:00:05", t) for k, (n, p, t) in enumerate(said)]
    df = spark.createDataFrame(rows, "import_id string, name string, parser string, line_no int, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df, staged(R.with_marks(df), by="marks")


@pytest.mark.parametrize("extractor", list(EXTRACTORS), ids=lambda f: f.__name__)
def test_marks_lose_nothing(marked_records, extractor):
    plain, laid_out = marked_records
    found = lambda df: sorted(map(str, extractor(df).drop("event_id").collect()))
    assert found(plain) == found(R.marked(laid_out, *EXTRACTORS[extractor])) != []


def test_only_marked_partitions_are_read(marked_records):
    laid_out = marked_records[1]
    plan = X.extract_network_switches(R.marked(laid_out, "switches"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(marks" in plan or "PartitionFilters: [NOT ((marks" in plan
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(R.marked(laid_out, "switches")) < files(laid_out)
