"""What belongs to which call, through the whole job and at its edges."""

from pyspark.sql import functions as F

from dialspan.operators import calls as C
from dialspan.operators import geo as G
from dialspan.operators import joins as J
from dialspan.plans import jobs as Z

from .test_state import at, times


def line(s, tag, text, minute=0):
    return f"[2026-01-02 10:{minute:02d}:{s:02d}.000] [{tag}] [INFO] {text}"


def files(spark, named, import_id="a"):
    rows = [(import_id, name, family, "\n".join(lines), None) for name, family, lines in named]
    return spark.createDataFrame(rows, "import_id string, name string, parser string, text string, warning string")


def test_open_and_contested_windows(spark):
    """A leg without an end owns what it alone covers; what it and an ended one cover belongs to none."""
    windows = times(spark, [("i", 1, 10, at(0), None), ("i", 1, 11, at(60), at(120)), ("i", 2, 12, at(5), at(2)), ("i", None, 13, at(0), None)], "import_id string, line_id int, perspective_id long, start string, end string")
    rows = times(spark, [(1, "i", 1, at(30)), (2, "i", 1, at(90)), (3, "i", 1, at(120.2)), (4, "i", 1, at(120.3)), (5, "i", 1, None), (6, "i", 2, at(4)), (7, "i", None, at(4)), (8, "j", 1, at(4))], "event_id long, import_id string, line_id int, ts string")
    got = {r.event_id: r.perspective_id for r in J.only_open_window(rows, windows, ["import_id", "line_id"], ["perspective_id"], "event_id").collect()}
    assert got == {1: 10, 2: None, 3: None, 4: 10, 5: None, 6: None, 7: None, 8: None}
    # the sweep's days carry what is open, a whole year without a row between
    late = rows.limit(1).withColumn("ts", F.lit("2027-01-02 10:00:00").cast("timestamp_ntz"))
    assert J.only_open_window(late, windows, ["import_id", "line_id"], ["perspective_id"], "event_id").first().perspective_id == 10
    assert J.only_open_window(rows, windows.limit(0), ["import_id", "line_id"], ["perspective_id"], "event_id").where("perspective_id IS NOT NULL").count() == 0


def test_call_without_an_end_owns_its_events(spark):
    engine = [line(1, "CORE", "[LINE 1] line 1 added to the call list"), line(3, "CORE", "line 1 status changed to 1")]
    rtcp = [line(s, "LINE 1 FLOW 0", "RTCP ARRIVED") + "\nSSRC of this source: 7\nPacket loss we perceive from this source (since last report): 2%" for s in (5, 10, 15)]
    tables = Z.tables_of(files(spark, [("kpelog.txt", "kpe", engine), ("rtplog.txt", "rtcp", rtcp)]))
    call = tables["perspectives"].first()
    assert (call.call_id, call.end, call.status, call.line_id) == (None, None, "connected / partial", 1)
    assert {r.perspective_id for r in tables["metrics"].collect()} == {call.perspective_id} and tables["metrics"].count() == 3


def test_legs_of_lost_engine_logs(spark):
    said = [line(2, "LINE 4", "connected line id: 4"), line(9, "LINE 4", "terminated line id: 4"), line(12, "LINE 5", "connected line id: 5"), line(20, "CORE", "a line of no line"), line(30, "LINE 5", "connected line id: 5"), line(40, "LINE 5", "terminated line id: 5")]
    raw = [line(50, "CORE", "line 9 added to the call list")]  # only engine logs open legs
    tables = Z.tables_of(files(spark, [("callinfo.txt", "callinfo", said), ("copy.txt", "raw", raw)]))
    got = sorted((r.line_id, r.start.second, r.end.second, r.status) for r in tables["perspectives"].collect())
    assert got == [(4, 2, 9, "completed"), (5, 12, 40, "completed")]
    owner = {r.line_no: r.perspective_id for r in tables["events"].where("parser = 'callinfo'").collect()}
    by_line = {r.line_id: r.perspective_id for r in tables["perspectives"].collect()}
    assert owner[4] == by_line[5] and None not in owner.values()  # the only ended window of the import


def test_summaries_and_local_calls(spark):
    life = times(spark, [("i", 1, at(0), 1, "added", None), ("i", 1, at(5), 2, "summary", None), ("i", 1, at(9), 3, "summary", "c1"), ("i", 2, at(0), 4, "added", None), ("i", 3, at(0), 5, "added", None)], "import_id string, line_id int, ts string, ord long, event string, call_id string")
    legs = C.reconstruct_legs(life)
    assert sorted((r.line_id, r.call_id) for r in legs.collect()) == [(1, "c1"), (2, None), (3, None)]
    none = spark.createDataFrame([], "import_id string, call_id string, ts timestamp_ntz, ord long, method string, response int, direction string, caller string, callee string")
    assert C.build_calls(C.build_perspectives(legs, none)).count() == 3


def test_known_calls_of_an_appended_archive(spark):
    """A second archive repeats call c1 and brings c2; a block of both lines stays, without the values of c1."""
    sip = lambda s, cid, kind: line(s, "SIPDEBUG", "OUTGOING SIP message:") + f"\n{kind} sip:b@example.test SIP/2.0\nFrom: <sip:a@example.test>\nTo: <sip:b@example.test>\nCall-ID: {cid}\nCSeq: 1 {kind}\n"
    engine = lambda n, s, e, cid: [line(s, "CORE", f"line {n} added to the call list"), line(e, "CORE", f'Info about call finished on line {n} : {{"callInfo": {{"call-id": "{cid}"}}}}')]
    device = lambda n, v: f"Device name: NART0 of Line {n}\nAudio currently in buffer (ms): {v}"
    block = line(12, "reader", "READING Virtual Output Device Running Info") + "\nDevice name: Default Audio Output\n" + "\n".join(f"CONNECTED INPUT DEVICE\n{device(n, 10 * n)}" for n in (1, 2))
    named = [("sip_debug.log", "sip", [sip(1, "c1", "INVITE"), sip(2, "c2", "INVITE")]), ("kpelog.txt", "kpe", [*engine(1, 1, 20, "c1"), *engine(2, 2, 21, "c2")]), ("vdlog.txt", "vd", [block])]
    first = Z.tables_of(files(spark, named))
    assert first["perspectives"].count() == 2 and sorted(r.value for r in first["periodic"].collect()) == [10.0, 20.0]
    perspectives = first["perspectives"].withColumn("producer", F.lit("p"))
    held = spark.createDataFrame([("p", "c1")], "producer string, call_id string")
    assert [r.call_id for r in C.skip_known_calls(perspectives, held).collect()] == ["c2"]
    known, new = perspectives.where("call_id = 'c1'"), perspectives.where("call_id = 'c2'")
    rows = first["periodic"].withColumn("n", F.monotonically_increasing_id())
    assert [r.value for r in C.drop_known_rows(rows, known, new, "n").collect()] == [20.0]
    left = C.drop_known_events(first["events"].withColumnRenamed("perspective_id", "owner"), known)
    assert left.where("call_id = 'c1'").count() == 0 and left.where("parser = 'vd'").count() == 1 and left.where("call_id = 'c2'").count() == 1
    again = Z.tables_of(files(spark, named, "b"), held)  # its producer isn't resolved: nothing is known of it
    assert again["perspectives"].count() == 2


def test_copies_and_contradictions_of_evidence(spark):
    spans = times(spark, [(i, "c", "c", "t1", 1, at(0), at(20), 4.0) for i in "ab"] + [("a", "c", "c", "t2", None, at(30), at(40), 4.0), ("b", "c", "c", "t2", None, at(30), at(40), 3.0), ("a", "c", "c", None, 2, at(50), at(60), 4.0)], "import_id string, call_id string, call_key string, text string, flow int, start string, end string, mos double").withColumn("access", F.lit("wifi"))
    fixes = times(spark, [(i, "c", at(s), kind, lat, 9.0, 5.0, True) for i in "ab" for s, kind, lat in ((0, "fresh", 45.0), (52, "sip_local", 46.0))], "import_id string, call_id string, ts string, kind string, latitude double, longitude double, accuracy double, valid boolean")
    got = Z.geo_report(spans, fixes, 200.0, ["access"])["cells"].groupBy("quality").agg(F.sum("seconds").alias("s"), F.count("*").alias("cells")).collect()
    assert {(r.quality, r.s, r.cells) for r in got} == {("fresh", 30.0, 1), ("declared", 30.0, 2)}
    signed = spans.select(G.lineage(spans).alias("x")).distinct()
    assert signed.count() == 3  # nulls in different columns are told apart
