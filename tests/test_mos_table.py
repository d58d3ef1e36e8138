"""Scored intervals of both sources in one table."""

from pyspark.sql import functions as F

from dialspan.operators import extract as X
from dialspan.plans import dictionary as D
from dialspan.plans import listings as L
from dialspan.plans import mos_table as B

from .test_state import at, times

COLUMNS = "perspective_id long, direction string, flow string, ssrc string, role string, start string, end string, loss double, mos double"


def table(spark, logs, telemetry, **scope):
    seen = spark.createDataFrame([(1, "r", "account", None, "c"), (2, "s", "import", "gw", "c"), (3, None, None, None, "d")], "perspective_id long, receiver string, receiver_basis string, declared_role string, call_key string")
    return B.scored_table(times(spark, logs, COLUMNS), times(spark, telemetry, COLUMNS), seen, **scope), seen


def row(p, a, b, direction="incoming", role=None, ssrc="7", mos=4.0):
    return (p, direction, "0", ssrc, role, at(a), at(b), 1.0, mos)


def test_receivers_roles_and_clocks(spark):
    made, seen = table(spark, [row(1, 0, 10), row(1, 10, 20, mos=2.0), row(1, 0, 10, "outgoing"), row(2, 0, 10), row(9, 0, 10), row(3, 0, 10)], [row(1, 5, 15, role="gw"), row(2, 5, 15, role="app"), row(3, 0, 5, None)])
    got = {(r.perspective_id, r.direction, r.time_basis): (r.receiver, r.receiver_basis, r.role, r.role_basis, r.app_direction) for r in made["intervals"].collect()}
    assert got[1, "incoming", "log_unspecified"] == ("r", "account", "app", "app_assumed", "downstream")
    assert got[1, "outgoing", "log_unspecified"] == ("peer-of:r", "remote_unidentified", "app", "app_assumed", "upstream")
    assert got[1, "incoming", "UTC"] == ("r", "account", "gw", "telemetry", "upstream")
    assert got[2, "incoming", "UTC"] == ("s", "import", "gw", "confirmed", "upstream")
    assert got[3, None, "UTC"] == (None, "remote_unidentified", "app", "app_assumed", "unknown") and not any(p == 9 for p, *_ in got)
    assert made["refused"].count() == 0  # unlike clocks are no one series
    ranks = {(r.receiver, r.time_basis): (r.calls, r.covered, r.bad, r.bad_percent) for r in B.receiver_table(made["intervals"], seen).collect()}
    assert ranks["r", "log_unspecified"] == (1, 20.0, 10.0, 50.0) and ranks["s", "UTC"] == (1, 10.0, 0.0, 0.0)


def test_overlapping_series_are_refused_whole(spark):
    logs = [row(1, 0, 100), row(1, 10, 20), row(1, 50, 60), row(1, 0, 10, ssrc="8"), row(1, 10, 20, ssrc="8"), row(2, 0, 10), row(2, 0, 10), row(3, 5, 5)]
    made, _ = table(spark, logs, [])
    assert {(r.perspective_id, r.ssrc): r.n for r in made["refused"].groupBy("perspective_id", "ssrc").agg(F.count("*").alias("n")).collect()} == {(1, "7"): 3, (2, "7"): 2}
    assert {(r.perspective_id, r.ssrc) for r in made["intervals"].collect()} == {(1, "8")}
    # the scope cuts first: what overlaps outside of it is no error
    edge = lambda s: F.lit(at(s)).cast("timestamp_ntz")
    made, _ = table(spark, logs, [], start=edge(70), end=edge(80))
    assert [(r.seconds, r.ssrc) for r in made["intervals"].collect()] == [(10.0, "7")] and made["refused"].count() == 0
    made, seen = table(spark, [], [])
    assert made["intervals"].count() == 0 and B.receiver_table(made["intervals"], seen).count() == 0


def test_telemetry_of_perspectives(spark):
    rows = times(spark, [("s", "x", "local_receive", at(0), at(5), 1.0, 4.0), ("s", "y", "local_send", at(0), at(5), 1.0, 4.0), ("t", "x", "local_receive", at(0), at(5), 1.0, 4.0), ("u", "x", "local_receive", at(0), at(5), 1.0, 4.0)], "source_id string, stream_id string, direction string, start string, end string, loss double, mos double")
    owners = spark.createDataFrame([("s", 1, "app"), ("s", 1, "gw"), ("t", 1, "gw"), ("t", 2, "gw"), ("t", 2, "gw")], "source_id string, perspective_id long, role string")
    got = {(r.perspective_id, r.ssrc, r.direction, r.role) for r in B.of_telemetry(rows, owners, ["source_id"]).collect()}
    assert got == {(1, "x", "incoming", None), (1, "y", "outgoing", None)}


def test_dictionary(spark):
    """Every metric once, those of every extractor's table among them; unknown ones are kept apart."""
    names = [m for m, *_ in D.entries()]
    assert names == sorted(set(names)) and {f"vd.{m}" for _, m, _, _ in X.PERIODIC_FIELDS} | {m for m, *_ in X.DEVICE_FIELDS} | {m for m, *_ in X.RTCP_FIELDS} <= set(names)
    got = {r.metric: r for r in L.metric_catalog(spark.createDataFrame([("vd.buffer", "ms"), ("x", "y"), ("x", None), (None, "z")], "metric string, unit string")).collect()}
    assert (got["vd.buffer"].kind, got["vd.buffer"].unit, got["vd.buffer"].domain, got["vd.buffer"].samples) == ("gauge", "ms", "buffer_media", 1)
    assert (got["x"].known, got["x"].kind, got["x"].rule, got["x"].seen_units) == (False, "reported statistic", "unconfirmed", ["y"])
    assert got["vd.dejitter_target"].unit == "ms" and got["vd.missing_packets"].rule == "rtp_receive" and got["rtcp.rtt"].samples == 0
    assert got["vd.cycles_read"].domain == "scheduling" and got[None].samples == 1


def test_aligned_lanes(spark):
    """Both sides' lanes on one clock; a side without time inside, or with too much of it, has none."""
    said = times(spark, [("a", at(0), 1, "sip", "up"), ("a", at(50), 2, "device", "down"), ("b", at(0), 1, "sip", "up"), ("c", at(0), 1, "sip", "up"), (None, at(0), 1, "sip", "up")], "side string, ts string, ord long, layer string, state string")
    bounds = times(spark, [("a", at(10), None), ("b", at(0), at(20)), ("c", at(0), "2027-01-02 10:00:00"), ("d", at(0), None), (None, at(0), at(5))], "side string, start string, end string")
    offset = F.when(F.col("side") == "b", 60_000_000).otherwise(0)
    got = {(r.side, r.lane): [] for r in L.aligned_lanes(said, bounds, ["side"], offset).collect()}
    assert {side for side, _ in got} == {"a", "b"}
    rows = L.aligned_lanes(said, bounds, ["side"], offset).where("lane IN ('sip', 'network')").orderBy("side", "lane", "start").collect()
    spans = [(r.side, r.lane, r.state, str(r.start)[-5:], str(r.end)[-5:]) for r in rows]
    assert ("a", "sip", "up", "00:10", "00:30") in spans and ("a", "sip", "unknown", "00:30", "00:50") in spans and ("b", "sip", "up", "01:00", "01:20") in spans
    edge = lambda s: F.lit(at(s)).cast("timestamp_ntz")
    inside = L.aligned_lanes(said, bounds, ["side"], offset, edge(25), edge(40)).where("lane = 'sip'").orderBy("side", "start").collect()
    assert [(r.side, r.state, str(r.start)[-2:], str(r.end)[-2:]) for r in inside] == [("a", "up", "25", "30"), ("a", "unknown", "30", "40"), ("c", "up", "25", "30"), ("c", "unknown", "30", "40")]
    assert L.aligned_lanes(said.limit(0), bounds, ["side"], offset).where("state <> 'unknown'").count() == 0
