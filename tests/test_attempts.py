"""What users asked for before any signalling, and what a metric says about its way."""

import io
import zipfile

from pyspark.sql import functions as F

from dialspan.functions import scalars as S
from dialspan.operators import attempts as U
from dialspan.plans import jobs as Z
from dialspan.sources import archives as A

from .test_claims import files

ROWS = [
    (3, "request one", "Calling number: one"), (3, "notice of one", U.BLOCKED), (4, "request two", "Calling number: two  "), (6, "late notice", U.BLOCKED),
    (7, "request three", "Calling number:\tthree"), (7, "between", "Shown view"), (7, "notice alone", U.BLOCKED), (8, "no target", "Calling number:  "), (8, "second alone", U.BLOCKED),
]


def app_log(rows=ROWS):
    return [f"2026-01-02 10:00:{s:02d}:250 [INFO] [App] : {text}" for s, _, text in rows]


def lines(spark, rows, name="Logs\\App.log"):
    frame = spark.createDataFrame([("i", name, n, n, s, f"[x] [App] : {text}") for n, (s, _, text) in enumerate(rows)], "import_id string, name string, line_no int, event_id long, s int, text string")
    return frame.withColumn("ts", F.expr("timestamp_ntz '2026-01-02 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)")).drop("s")


def test_requests_and_notices(spark):
    got = {r.event_id: (r.target, r.status, r.reason_event_id) for r in U.user_attempts(U.attempt_lines(lines(spark, ROWS))).collect()}
    assert got == {0: ("one", "blocked", 1), 2: ("two  ", "requested", None), 3: ("", "blocked", 3), 4: ("three", "requested", None), 6: ("", "blocked", 6), 8: ("", "blocked", 8)}
    assert U.attempt_lines(lines(spark, ROWS, "app.log.txt")).count() == 0
    assert U.user_attempts(U.attempt_lines(lines(spark, ROWS).limit(0))).count() == 0
    # what isn't dated stands between nothing, and a notice before its request in time blocks none
    undated = lines(spark, ROWS).withColumn("ts", F.when(F.col("event_id") == 5, F.lit(None)).when(F.col("event_id") == 1, F.expr("ts - INTERVAL 1 SECOND")).otherwise(F.col("ts")))
    got = {r.event_id: r.reason_event_id for r in U.user_attempts(U.attempt_lines(undated)).collect()}
    assert got == {0: None, 1: 1, 2: None, 3: 3, 4: 6, 8: 8}


def test_stamp_with_milliseconds_is_the_time(spark):
    rows = lines(spark, ROWS[:2]).withColumn("text", F.when(F.col("event_id") == 1, F.concat(F.lit("2026-01-02 10:00:04:500 [App] : "), F.lit(U.BLOCKED))).otherwise(F.col("text")))
    assert [r.reason_event_id for r in U.user_attempts(U.attempt_lines(rows)).orderBy("event_id").collect()] == [None, 1]


def test_context_of_an_attempt(spark):
    rows = lines(spark, [(0, "", "Calling number: a"), (30, "", "Shown view"), (59, "", U.BLOCKED), (59, "", "Calling number: b"), (59, "", U.BLOCKED)])
    found = U.user_attempts(U.attempt_lines(rows)).withColumn("attempt_id", F.col("event_id"))
    events = rows.withColumn("family", F.lit("app")).unionByName(rows.limit(1).withColumns({"family": F.lit("other"), "event_id": F.lit(99).cast("long")}))
    got = {}
    for r in U.attempt_context(events, found, ["app"]).collect():
        got.setdefault(r.attempt_id, set()).add((r.event_id, r.is_context))
    assert got[0] == {(0, False)} and got[2] == {(2, False), (0, True), (1, True), (3, True), (4, True)}
    assert got[3] == {(3, False), (4, False), (0, True), (1, True), (2, True)}
    proofs = U.attempt_context(events, found, ["none"])
    assert proofs.where("is_context").count() == 0 and proofs.count() == 4
    twice = found.unionByName(found.withColumns({"attempt_id": F.lit(7).cast("long"), "ts": F.lit(None).cast("timestamp_ntz")}))
    assert U.attempt_context(events, twice, ["app"]).where("attempt_id = 7 AND is_context").count() == 0


def test_copies_of_sources(spark):
    one = U.user_attempts(U.attempt_lines(lines(spark, ROWS)))
    imports = [one.withColumns({"import_id": F.lit(i), "import_seq": F.lit(n), "event_id": F.col("event_id") + 100 * n}) for n, i in enumerate("abc")]
    every = imports[0].unionByName(imports[1]).unionByName(imports[2])
    known = spark.createDataFrame([("a", "resolved", "p"), ("b", "resolved", "p"), ("c", "unknown", None)], "import_id string, status string, producer string")
    once = U.attempts_once(U.source_of(every, known))
    assert once.count() == 12 and {(r.source, r.import_id, r.copies) for r in once.collect()} == {("producer:p", "b", 2), ("import:c", "c", 1)}
    roles = spark.createDataFrame([("a", "gw"), ("b", "app")], "import_id string, role string")
    assert {r.source for r in U.attempts_once(U.source_of(every, known, roles)).collect()} == {"import:a", "producer:p", "import:c"}


def test_attempts_of_archives(spark):
    """Two archives of one import's log: attempts through the whole job, with their context."""
    engine = ["[2026-01-02 10:00:05.000] [CORE] [INFO] one", "[2026-01-02 10:00:06.900] [CORE] [INFO] two"]
    both = [files(spark, [("App.log", "raw", app_log()), ("kpelog.txt", "kpe", engine)], i) for i in "ab"]
    tables = Z.tables_of(both[0].unionByName(both[1]))
    report = Z.attempt_report(tables, ["kpelog"])
    rows = report["attempts"].collect()
    assert len(rows) == 12 and sorted({r.target for r in rows}) == ["", "one", "three", "two  "] and {r.copies for r in rows} == {1}  # nothing says who wrote them
    around = report["context"].where("is_context").groupBy("attempt_id").count().collect()
    assert {r["count"] for r in around} == {1, 2}
    assert {(r.source, r.status): r.attempts for r in report["statuses"].collect()} == {("import:a", "blocked"): 4, ("import:a", "requested"): 2, ("import:b", "blocked"): 4, ("import:b", "requested"): 2}


def test_ways_of_metrics(spark):
    cases = [
        (("rtcp.loss", "incoming", "app", None, None, None), ("downstream", "metric_field", "receiver_report")),
        (("rtcp.loss", "incoming", "gw", None, None, None), ("upstream", "metric_field", "receiver_report")),
        (("rtcp.loss", "outgoing", "node", None, None, None), ("peer", "metric_field", "receiver_report")),
        (("rtcp.loss", None, "app", None, None, None), ("unknown", "metric_field", "receiver_report")),
        (("rtcp.rtt", "incoming", "gw", None, None, None), ("bidirectional", "metric_field", "roundtrip")),
        (("rtcp.packets_sent_total", "outgoing", None, None, None, None), ("peer", "metric_field", "peer_sent")),
        (("rtcp.packets_sent_total", "outgoing", "app", None, None, None), ("downstream", "metric_field", "peer_sent")),
        (("rtcp.packets_lost_total", "", "gw", None, None, None), ("downstream", "metric_field", "peer_lost")),
        (("vd.buffer", "outgoing", "app", "NART1 of Line 2", None, None), ("downstream", "device_context", "device")),
        (("vd.buffer", "incoming", "gw", "", "nawt3 of line 4", "Microphone"), ("downstream", "device_context", "device")),
        (("vd.buffer", "incoming", "app", None, "NAWT", "NART"), ("processing", "device_context", "device")),
        (("vd.buffer", "incoming", "app", "Microphone", None, None), ("processing", "device_context", "device")),
        (("vd.buffer", "incoming", "app", "xNART", None, None), ("processing", "device_context", "device")),
        (("vd.buffer", "outgoing", None, None, "", None), ("transmit", "reported_direction", "device")),
        (("vd.buffer", "incoming", "app", None, None, None), ("downstream", "reported_direction", "device")),
        (("kpe.jitter.delay", "incoming", "app", None, None, None), ("unknown", "metric_field", "unconfirmed")),
        ((None, "incoming", "app", None, None, None), None),
    ]
    columns = ["name", "direction", "role", "device", "output_device", "input_device"]
    frame = spark.createDataFrame([(n, *c) for n, (c, _) in enumerate(cases)], "n int, " + ", ".join(f"{c} string" for c in columns))
    got = [r.c and tuple(r.c) for r in frame.select("n", S.metric_context(*columns).alias("c")).orderBy("n").collect()]
    assert got == [want for _, want in cases]


def test_movement_and_conversations_of_a_build(spark, tmp_path):
    from dialspan.plans import build as B

    place = lambda s, lat, et: f"2026-01-02 10:00:{s:02d}:000 [INFO] New location received: Location[gps {lat},9.0 hAcc=5 et={et}]"
    logs = ["\n".join([*app_log(), place(20, 45.0, "+1s"), place(21, 45.0, "+1s"), place(22, 45.0001, "+3s"), place(58, 45.0002, "+9s")]), ""]
    rows = []
    for i, text in zip("ab", logs, strict=True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("App.log", text)
        rows.append((i, f"{i}.zip", out.getvalue()))
    archives = spark.createDataFrame(rows, "import_id string, archive string, content binary")
    tables = B.read_tables(spark, str(tmp_path), B.build_into(spark, archives, str(tmp_path)))
    assert [(r.ordinal, r.reason) for r in tables["movement"].orderBy("t_us").collect()] == [(1, "first_sample"), (2, None), (1, "time_gap")]
    assert tables["attempts"].count() == 6 and A.file_family("name") is not None


def test_conversations_over_archives(spark):
    """Calls that share a UUID in any archives are one conversation that begins with the first of them; others need several perspectives."""
    seen = spark.createDataFrame([("a", "x", 3), ("b", "x", 1), ("a", "y", 7), ("a", "z", 2), ("b", "z", 2), ("a", "w", 9), ("a", None, 0)], "import_id string, call_id string, s int")
    seen = seen.withColumn("start", F.expr("timestamp_ntz '2026-01-02 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)")).drop("s")
    uuids = spark.createDataFrame([("a", "u", "x"), ("b", "u", "x"), ("a", "u", "y"), ("a", "v", "nowhere")], "import_id string, uuid string, call_id string")
    rows = {(r.group, r.call_id): (r.basis, r.start and r.start.second, r.review) for r in Z.conversations_of(uuids, seen).collect()}
    assert rows == {("uuid:u", "x"): ("shared_uuid", 1, False), ("uuid:u", "y"): ("shared_uuid", 1, False), ("uuid:v", "nowhere"): ("shared_uuid", None, False), ("call:z", "z"): ("several_perspectives", 2, False)}
    assert Z.conversations_of(uuids.limit(0), seen.limit(0)).count() == 0
