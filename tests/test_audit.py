"""References in time, reused numbers, repeated fixes and calendars: hand-checked and brute-force cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dialspan.operators import network as K
from dialspan.operators import telemetry as T
from dialspan.plans import reports as R
from dialspan.streaming import jobs as streams
from dialspan.streaming.processors import EpisodeProcessor


def test_references_of_four_kinds(spark):
    stream = {"call_id": "c", "sip_call_id": None, "stream_id": "t", "ssrc": 1, "direction": "local_receive"}
    plan = {"plan_id": "p", "revision": 1}
    rows = [
        ("api_request", "e1", 0, True, {"request_id": "q", "phase": "started"}),
        ("plan_received", "e2", 1, True, {"request_id": "q", "plan": plan, "valid_until_mono_ms": 50}),
        ("plan_received", "e3", 2, True, {"request_id": "none", "plan": {"plan_id": "p", "revision": 2}, "valid_until_mono_ms": 50}),
        ("position", "e4", 3, False, {"latitude": 1.0}),
        ("media_config", "e5", 4, True, {"stream": stream, "config_id": "a"}),
        ("media_config", "e6", 5, False, {"stream": stream, "config_id": "b"}),
        ("plan_state", "e7", 10, True, {"plan": plan, "state": "activated", "position_basis": "measured", "position_event_id": "e4"}),
        ("plan_state", "e8", 60, True, {"plan": plan, "state": "resumed", "position_basis": "estimated", "position_event_id": None}),
        ("plan_state", "e9", 0, True, {"plan": plan, "state": "paused", "position_basis": "estimated", "position_event_id": None}),
        ("action", "e10", 20, True, {"plan": None, "stream": stream, "old_config_id": "a", "new_config_id": "b"}),
        ("action", "e11", 20, True, {"plan": plan, "stream": stream | {"ssrc": 2}, "old_config_id": "a", "new_config_id": "a"}),
    ]
    records = spark.createDataFrame([("s", "x", "b", k, e, float(t), u, json.dumps(p)) for k, e, t, u, p in rows], "source_id string, session_id string, boot_id string, type string, event_id string, mono_ms double, usable boolean, payload string")
    got = {r.event_id: r.issues for r in T.audit_references(T.referring(records), T.declared(records)).collect()}
    assert got == {
        "e2": [], "e3": ["request_reference_unresolved"], "e7": ["position_reference_unresolved"], "e8": ["expired_plan_activation"], "e9": ["plan_reference_unresolved"],
        "e10": ["config_reference_unresolved"], "e11": ["config_reference_unresolved"],
    }
    only = records.where("event_id <> 'e6'").withColumn("payload", F.when(F.col("event_id") == "e10", F.lit(json.dumps(rows[9][4] | {"new_config_id": "a"}))).otherwise(F.col("payload")))
    assert {r.event_id: r.issues for r in T.audit_references(T.referring(only), T.declared(only)).collect()}["e10"] == []
    assert T.audit_references(T.referring(records.limit(0)), T.declared(records.limit(0))).count() == 0


def test_numbers_that_begin_again(spark):
    rows = [("s", 0, 65000, 65500), ("s", 1, 65501, 100), ("s", 2, 101, 200), ("s", 3, 150, 300), ("s", 4, None, None), ("s", 5, 301, 400), ("s", 6, 65530, 10), ("t", 0, 1, 2)]
    df = spark.createDataFrame(rows, "k string, start_ms long, sequence_first long, sequence_last long")
    got = {(r.k, r.start_ms) for r in T.reused_sequences(df, ["k"], 65536).where("reused").collect()}
    assert got == {("s", 2), ("s", 3), ("s", 5), ("s", 6)}
    assert T.reused_sequences(df, ["k"], 65536).count() == len(rows)


def test_long_islands_of_repeats_by_brute_force(spark):
    rng, gap, rows = random.Random(5), 30_000_000, []
    for key in "ab":
        t = 0
        for _ in range(400):
            t += rng.choice([1, 5, 12, 29, 31]) * 1_000_000
            rows.append((key, t, True, 45 + rng.choice([0, 0, 0, 1]) / 10000, 9.0, 5.0, rng.choice(["+1s", "+1s", "+1s", "+1s", "+2s", ""]), 1.0))
    rows += [("c", 1_000_000 * k, True, 45 + k % 2 / 10000, 9.0, 5.0, "+1s", 1.0) for k in range(3000)]
    df = spark.createDataFrame(rows, "import_id string, t_us long, ok boolean, latitude double, longitude double, accuracy double, elapsed string, elapsed_s double")
    want, before, last = set(), None, None
    for key, t, _, lat, _, _, text, _ in rows:
        again = before is not None and before[0] == key and text and before[2] == text and t - before[1] <= gap
        if not again or last is None or t - last[0] > gap:
            want.add((key, t))
            last = (t, lat)
        elif lat != last[1]:
            last = None
        before = (key, t, text)
    assert {(r.import_id, r.t_us) for r in K.movement_sequences(df, speed=1e9).collect()} == want


def test_calendar_of_two_measures(spark):
    rows = [("p", 1, 1, "2026-01-05 12:30:00", "2026-01-05 13:30:00", 2.0), ("p", 2, 1, "2026-01-06 12:00:00", "2026-01-06 12:10:00", 4.0)]
    df = spark.createDataFrame(rows, "place string, call long, source long, start string, end string, value double").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    got = {(r.kind, r.bin): r for r in R.calendar_profile(df, ["place"]).collect()}
    noon = got["hour", "12"]
    assert (noon.seconds, noon.days, noon.calls, noon.sources, noon.limited) == (2400.0, 2, 2, 1, True) and noon.mean == pytest.approx((2 * 1800 + 4 * 600) / 2400) and noon.day_mean == 3.0
    empty = got["hour", "03"]
    assert (empty.seconds, empty.mean, empty.total, empty.days, empty.limited) == (0.0, None, None, 0, True) and len([k for k in got if k[0] == "week_hour"]) == 168
    deltas = {(r.kind, r.bin): r for r in R.calendar_profile(df.where("call = 2"), ["place"], "delta").collect()}
    assert (deltas["hour", "12"].total, deltas["hour", "12"].rate, deltas["hour", "12"].mean) == (4.0, 4 / 600, None)
    with pytest.raises(ValueError):
        R.calendar_profile(df, ["place"], "median")


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_episodes_are_the_same_however_they_are_batched():
    rng = random.Random(3)
    signals = sorted({(rng.randrange(0, 10**9), rng.choice(["start", "missing", "ongoing", "end"]), rng.choice([None, 5.0, 900.0])) for _ in range(300)}, key=lambda r: (r[0], r[1]))

    def all_of(cuts):
        p, out, rest = EpisodeProcessor("k", 10**9), [], []
        p.open = Held()
        for a, b in zip([0, *cuts], [*cuts, 2 * 10**9], strict=True):
            made, rest, _ = p.ready(sorted([*rest, *[s for s in signals if a <= s[0] < b]], key=p.place), b - 1)
            out += made
        return out, p.open.exists(), rest

    whole = all_of([])
    for _ in range(5):
        assert all_of(sorted(rng.sample(range(1, 10**9), 12))) == whole
    assert whole[2] == []


def test_targets_are_looked_for(spark, tmp_path):
    assert not streams.there(spark, f"{tmp_path}/none*") and streams.there(spark, f"{tmp_path}")
