"""Places, listings and whole jobs on small cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from dialspan.functions import scalars as S
from dialspan.operators import geo as G
from dialspan.plans import jobs as Z
from dialspan.plans import listings as L
from dialspan.plans import reports as R
from dialspan.plans.views import run_sql

from .test_state import at, times


def test_scalars(spark):
    row = spark.range(1).select(
        S.mos_score(F.lit(0.0)).alias("zero"), S.mos_score(F.lit(101.0)).alias("over"), S.mos_score(F.lit(float("nan"))).alias("nan"),
        S.elapsed_seconds(F.lit("+1d2h3m4s5ms")).alias("e"), S.elapsed_seconds(F.lit("1h2x")).alias("bad"), S.elapsed_seconds(F.lit("2s1h")).alias("turned"), S.duration_ms(F.lit(3), F.lit("usecs")).alias("us"),
        S.lon_arc(F.lit(179.0), F.lit(-179.0)).alias("arc"), S.metric_valid(F.lit(1.5), F.lit("packets")).alias("v"), S.csv_safe(F.lit("=1")).alias("csv"),
        S.grid_cell(F.lit(45.5), F.lit(9.25), 200).alias("cell"),
    ).first()
    assert row.zero == pytest.approx(4.409285824) and row.over is None and row.nan is None
    assert row.e == pytest.approx(93784.005) and row.bad is None and row.us == pytest.approx(0.003) and row.arc == 2.0 and not row.v and row.csv == "'=1"
    b = spark.createDataFrame([(row.cell,), ("x",)], "c string").select(S.grid_bounds("c", 200).alias("b")).collect()
    assert b[0].b.south <= 45.5 < b[0].b.north and b[0].b.west <= 9.25 < b[0].b.east and b[1].b is None
    got = run_sql(spark, {}, "SELECT mos_score(:x) AS m, grid_cell(45.5D, 9.25D) AS c", {"x": 0.0}).first()
    assert got.m == pytest.approx(4.409285824) and got.c == row.cell


def test_places(spark):
    fixes = times(spark, [("i", at(8), 45.0, 9.0, 5.0, True), ("i", at(12), 45.01, 9.0, 5.0, True), ("i", at(20), 46.0, 9.0, 5.0, False)], "import_id string, ts string, latitude double, longitude double, accuracy double, valid boolean")
    intervals = times(spark, [("i", 1, at(10), at(30), 4.0)], "import_id string, id long, start string, end string, mos double")
    got = [(str(r.start)[-2:], str(r.end)[-2:], r.latitude) for r in G.locate_intervals(intervals, fixes, ["import_id"]).orderBy("start").collect()]
    assert got == [("10", "12", 45.0), ("12", "20", 45.01)]  # the contested stamp is a barrier
    copies = times(spark, [("s", at(0), at(10), 4.0, "wifi"), ("s", at(0), at(10), 4.0, "lte"), ("s", at(5), at(8), 3.0, "wifi")], "signature string, start string, end string, mos double, access string")
    got = [(str(r.start)[-2:], str(r.end)[-2:], r.access) for r in G.canonical_intervals(copies, ["mos"], ["access"]).orderBy("start").collect()]
    assert got == [("00", "05", "unknown"), ("08", "10", "unknown")]
    pq = spark.createDataFrame([(1, b, 100.0 - b % 60) for b in range(1767348000, 1767348060)], "perspective_id long, bin long, pq double")
    own = times(spark, [(1, at(8), True, 45.0, 9.0), (1, at(12), True, 45.01, 9.0)], "perspective_id long, ts string, ok boolean, latitude double, longitude double")
    samples = G.route_samples(own, pq).orderBy("bin").collect()
    assert [s.pq for s in samples] == [92.0, 91.0, 90.0, 89.0] and samples[2].latitude == pytest.approx(45.00625)
    direct = G.pq_cells_direct(own, pq, 200)
    assert sorted((r.mean, r.seconds, r.limited) for r in direct.collect()) == [(88.0, 1, True), (92.0, 1, True)]
    both = G.pq_cells_estimated(G.route_samples(own, pq), direct, 200).collect()
    assert {r.basis for r in both} == {"direct", "estimated"}
    calls = spark.createDataFrame([(1, 1767348009 * 10**6, 1767348050 * 10**6)], "perspective_id long, begin_us long, stop_us long")
    points = {r.ts.second: (r.reason, r.pq) for r in G.route_points(own.withColumn("cached", F.lit(False)), pq, calls, 200).collect()}
    assert points == {8: ("before_connect", None), 12: (None, 88.0)}


def test_profile_crosses_new_year(spark):
    rows = spark.createDataFrame([("p", "2025-12-31 23:59:50", "2026-01-01 00:00:10", 4.0)], "place string, start string, end string, value double")
    rows = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    got = {(r.kind, r.bin): r.seconds for r in R.temporal_profile(rows, ["place"]).collect()}
    assert got["day", "2025-12-31"] == got["day", "2026-01-01"] == 10.0 and got["hour", "23"] == got["hour", "00"] == 10.0


def test_listings(spark):
    counters = times(spark, [("s", "i", at(0), at(5), "ok", 2.0), ("s", "i", at(5), at(10), "ok", 0.0), ("s", "i", at(20), at(25), "ok", 3.0)], "series string, import_id string, previous_ts string, ts string, status string, delta double").withColumn("previous_ts", F.col("previous_ts").cast("timestamp_ntz"))
    notices = times(spark, [("i", at(4), "route"), ("i", at(4), "route")], "import_id string, ts string, type string")
    got = {r.type: tuple(r)[-4:] for r in L.transient_summary(counters, notices, ["route", "mute"], ["series", "import_id"], ["import_id"], 2_000_000).collect()}
    assert got == {"route": (3, 2, 1, 1), "mute": (3, 0, 0, 2)}
    metrics = spark.createDataFrame([("rtcp.loss", "%"), ("other", "x")], "metric string, unit string")
    known = {r.metric: (r.known, r.samples) for r in L.metric_catalog(metrics).collect()}
    assert known["rtcp.loss"] == (True, 1) and known["other"] == (False, 1) and known["vd.buffer"] == (True, 0)
    losses = times(spark, [(1, "incoming", "0", "7", at(5), 2.0, "%", True), (1, "incoming", "0", "7", at(10), 12.0, "%", True)], "perspective_id long, direction string, flow string, ssrc string, ts string, value double, unit string, valid boolean")
    p = times(spark, [(1, "i", "c", None, at(2), at(20), "app", 1, None)], "perspective_id long, import_id string, call_key string, connected string, start string, end string, role string, import_seq long, duplicate_of string")
    nets = times(spark, [("i", at(0), "wifi", True)], "import_id string, ts string, access string, valid boolean")
    rows = L.mos_intervals(losses, p, nets)
    one = L.mos_call_summary(rows, p).first()
    score = lambda x: spark.range(1).select(S.mos_score(F.lit(x))).first()[0]
    assert one.mean == pytest.approx((score(2.0) * 5 + score(12.0) * 10) / 15) and one.coverage == pytest.approx(100 * 15 / 18) and one.reason is None
    report = Z.mos_report(losses, p, nets)
    assert report["networks"].first().access == "wifi" and report["episodes"].count() == 0


def test_from_archive_to_tables(spark, tmp_path):
    line = lambda s, tag, text: f"[2026-01-02 10:00:{s:02d}.000] [{tag}] [INFO] {text}"
    sip = lambda s, way, first: line(s, "SIPDEBUG", f"{way} SIP message:") + f"\n{first}\nFrom: <sip:a@example.test>\nTo: <sip:b@example.test>\nCall-ID: c1\nCSeq: 1 INVITE\n"
    engine = "\n".join([line(1, "CORE", "line 1 added to the call list"), line(3, "CORE", "line 1 status changed to 1"), line(19, "CORE", "line 1 call terminated"), line(20, "CORE", 'Info about call finished on line 1 : {"callInfo":{"call-id":"c1"}}')])
    rtcp = "\n".join(line(s, "LINE 1 FLOW 0", "RTCP ARRIVED") + f"\nSSRC of this source: 7\nPacket loss we perceive from this source (since last report): {v}%" for s, v in ((5, 30), (10, 30), (15, 2)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("sip_debug.log", sip(1, "OUTGOING", "INVITE sip:b@example.test SIP/2.0") + "\n" + sip(3, "INCOMING", "SIP/2.0 200 OK"))
        z.writestr("kpelog.txt", engine)
        z.writestr("rtplog.txt", rtcp)
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    tables = Z.build_tables(spark, str(tmp_path))
    call = tables["perspectives"].first()
    assert (call.call_id, call.status, call.direction, call.line_id) == ("c1", "completed", "outgoing", 1)
    assert tables["calls"].first().call_key == "sip:c1" and tables["files"].count() == 3
    report = Z.mos_of_tables(tables)
    got = report["series"].first()
    assert (got.covered, got.bad) == (15.0, 10.0) and report["episodes"].count() == 1
