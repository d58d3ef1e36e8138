"""Structured telemetry: validation, canonical records, clock guards, RTCP blocks and loss intervals.

A clock domain is (source_id, session_id, boot_id); monotonic times are never compared across
domains. Every refusal is named in ``issues``, nothing is dropped silently.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOMAIN = ["source_id", "session_id", "boot_id"]
ISSUES = "array<string>"

Kind = tuple  # (name of a kind of value, its parameters)
TOKEN, TEXT, TIME, FLAG, ANY_OBJECT = ("pattern", r"[A-Za-z0-9_.:@/+-]{1,128}"), ("text", 256), ("time",), ("flag",), ("object", None)
HEX_BYTES, SHA256 = ("pattern", r"(?:[0-9a-fA-F]{2}){4,16384}"), ("pattern", r"[0-9a-f]{64}")
NUMBER, AMOUNT, COUNT = ("number", None, None), ("number", 0, None), ("whole", 0, None)


class Field(NamedTuple):
    """A field of a record: its kind of value, whether it must be there, and whether it may be null."""

    kind: Kind
    required: bool = True
    nullable: bool = False


def must(*kind: object) -> Field:
    return Field(kind)


def may_be_null(*kind: object) -> Field:
    """A field that must be there and may be null."""
    return Field(kind, nullable=True)


def optional(*kind: object) -> Field:
    """A field that may be left out, or be null."""
    return Field(kind, required=False, nullable=True)


def one_of(*words: str) -> Kind:
    return ("word", *words)


# The records of the telemetry contract, one entry a field.
STREAM = {
    "call_id": must(*TOKEN),
    "sip_call_id": may_be_null(*TEXT),
    "stream_id": must(*TOKEN),
    "ssrc": must("whole", 0, 4294967295),
    "direction": must(*one_of("local_receive", "local_send")),
}
PLAN = {"plan_id": must(*TOKEN), "revision": must(*COUNT)}
CAPABILITY = {"name": must(*TEXT), "status": must(*one_of("available", "unsupported", "permission_denied", "disabled"))}
SIGNAL = {"name": must(*TEXT), "value": must(*NUMBER), "unit": must(*one_of("dBm", "dB", "asu", "raw"))}
SESSION = {
    "platform": must(*one_of("android", "ios", "windows", "macos", "linux", "other")),
    "os_version": must(*TEXT),
    "app_version": must(*TEXT),
    "media_version": must(*TEXT),
    "device_model": optional(*TEXT),
    "clock_uncertainty_ms": may_be_null(*AMOUNT),
    "capabilities": must("list", 64, ("object", CAPABILITY)),
}
POSITION = {
    "trajectory_id": must(*TOKEN),
    "fix_id": must(*TOKEN),
    "fix_utc": may_be_null(*TIME),
    "fix_mono_ms": must(*AMOUNT),
    "latitude": must("number", -90, 90),
    "longitude": must("number", -180, 180),
    "accuracy_m": may_be_null(*AMOUNT),
    "provider": must(*TEXT),
    "cached": must(*FLAG),
    "speed_mps": may_be_null(*AMOUNT),
    "speed_accuracy_mps": may_be_null(*AMOUNT),
    "bearing_deg": may_be_null("number", 0, 359.999999),
    "bearing_accuracy_deg": may_be_null("number", 0, 180),
    "altitude_m": optional(*NUMBER),
}
NETWORK = {
    "network_id": must(*TOKEN),
    "scope": must(*one_of("media_path", "system_default")),
    "stream_id": may_be_null(*TOKEN),
    "access": must(*one_of("cellular", "wifi", "ethernet", "other", "unknown")),
    "upstream": must(*one_of("mobile_direct", "tethering", "onboard_wifi", "fixed", "unknown")),
    "upstream_basis": must(*one_of("observed", "declared", "unknown")),
    "subscription_id": may_be_null(*TOKEN),
    "sim_operator": may_be_null(*TEXT),
    "serving_operator": may_be_null(*TEXT),
    "radio_technology": may_be_null(*TEXT),
    "wifi_network_id": may_be_null(*TOKEN),
    "wifi_ap_id": may_be_null(*TOKEN),
    "vpn": may_be_null(*FLAG),
    "metered": optional(*FLAG),
    "signals": must("list", 16, ("object", SIGNAL)),
}
MEDIA_INTERVAL = {
    "stream": must("object", STREAM),
    "network_id": may_be_null(*TOKEN),
    "config_id": must(*TOKEN),
    "counter_epoch": must(*TOKEN),
    "start_mono_ms": must(*AMOUNT),
    "end_mono_ms": must(*AMOUNT),
    "expected_packets": must(*COUNT),
    "received_unique_packets": must(*COUNT),
    "duplicate_packets": optional(*COUNT),
    "reordered_packets": optional(*COUNT),
    "missing_at_deadline_packets": optional(*COUNT),
    "late_packets": optional(*COUNT),
    "discarded_late_packets": optional(*COUNT),
    "discarded_overflow_packets": optional(*COUNT),
    "missing_sequence_events": optional(*COUNT),
    "skipped_media_ms": optional(*AMOUNT),
    "skipped_silence_ms": optional(*AMOUNT),
    "concealed_media_ms": optional(*AMOUNT),
    "inserted_media_ms": optional(*AMOUNT),
    "fec_recovered_packets": optional(*COUNT),
    "buffer_current_ms": optional(*AMOUNT),
    "buffer_target_ms": optional(*AMOUNT),
    "loss_runs_packets": optional("list", 4096, ("whole", 1, None)),
    "semantics_id": must(*TOKEN),
    "complete": must(*FLAG),
}
MEDIA_CONFIG = {
    "stream": must("object", STREAM),
    "config_id": must(*TOKEN),
    "codec": must(*TEXT),
    "rtp_clock_hz": must("whole", 1, None),
    "packet_duration_ms": must("number", 0.001, None),
    "channels": must("whole", 1, 64),
    "plc": must(*TEXT),
    "fec": must(*TEXT),
    "redundancy": must(*TEXT),
    "dtx": must(*FLAG),
    "jitter_buffer_mode": must(*TEXT),
    "jitter_target_ms": may_be_null(*AMOUNT),
}
RTCP = {"stream": must("object", STREAM), "transport_direction": must(*one_of("sent", "received")), "packet_hex": must(*HEX_BYTES)}
COLLECTION = {
    "subsystem": must(*one_of("position", "network", "media", "clock", "logger")),
    "status": must(*one_of("started", "stopped", "unavailable", "permission_denied", "suspended", "resumed", "clock_change", "dropped_events")),
    "reason": must(*TEXT),
    "dropped_events": optional(*COUNT),
}
ACTION = {
    "stream": must("object", STREAM),
    "action_id": must(*TOKEN),
    "phase": must(*one_of("requested", "applied", "failed", "reverted")),
    "reason": must(*TEXT),
    "prediction_id": may_be_null(*TOKEN),
    "old_config_id": must(*TOKEN),
    "new_config_id": must(*TOKEN),
}
PACKET = {
    "stream": must("object", STREAM),
    "sequence": must("whole", 0, 65535),
    "rtp_timestamp": must("whole", 0, 4294967295),
    "size_bytes": must(*COUNT),
    "status": must(*one_of("sent", "received", "discarded", "played", "missing")),
    "reason": may_be_null(*TEXT),
    "deadline_mono_ms": may_be_null(*AMOUNT),
}
API_REQUEST = {
    "request_id": must(*TOKEN),
    "phase": must(*one_of("started", "succeeded", "timeout", "failed")),
    "start_mono_ms": must(*AMOUNT),
    "end_mono_ms": may_be_null(*AMOUNT),
    "response_plan": may_be_null("object", PLAN),
    "reason": may_be_null(*TEXT),
}
PLAN_RECEIVED = {
    "request_id": must(*TOKEN),
    "plan": must("object", PLAN),
    "issued_utc": must(*TIME),
    "expires_utc": must(*TIME),
    "valid_until_mono_ms": must(*AMOUNT),
    "route_id": must(*TOKEN),
    "confidence": must("number", 0, 1),
    "horizon_m": must(*AMOUNT),
    "horizon_ms": must(*AMOUNT),
    "content_sha256": must(*SHA256),
    "document": must(*ANY_OBJECT),
    "fallback_profile_id": must(*TOKEN),
}
PLAN_STATE = {
    "plan": must("object", PLAN),
    "state": must(*one_of("activated", "replaced", "expired", "route_deviation", "position_uncertain", "fallback", "resumed", "stale_rejected")),
    "segment_id": may_be_null(*TOKEN),
    "profile_id": may_be_null(*TOKEN),
    "reason": must(*TEXT),
    "position_basis": must(*one_of("measured", "estimated", "unavailable")),
    "position_event_id": may_be_null(*TOKEN),
    "position_uncertainty_m": may_be_null(*AMOUNT),
}
ENVELOPE = {
    "schema": must(*TEXT),
    "type": must(*TEXT),
    "event_id": must(*TOKEN),
    "source_id": must(*TOKEN),
    "session_id": must(*TOKEN),
    "boot_id": must(*TOKEN),
    "seq": must(*COUNT),
    "role": must(*one_of("app", "gw")),
    "observed_utc": must(*TIME),
    "mono_ms": must(*AMOUNT),
    "validity": must(*one_of("valid", "invalid")),
    "invalid_reason": may_be_null(*TEXT),
    "payload": must(*ANY_OBJECT),
    "extensions": optional(*ANY_OBJECT),
}
PAYLOADS = {
    "session": SESSION, "position": POSITION, "network": NETWORK, "media_interval": MEDIA_INTERVAL, "media_config": MEDIA_CONFIG,
    "rtcp": RTCP, "collection": COLLECTION, "action": ACTION, "packet": PACKET,
}
#: Kinds and fields that version 1.1 adds.
NEW_PAYLOADS = {"api_request": API_REQUEST, "plan_received": PLAN_RECEIVED, "plan_state": PLAN_STATE}
NEW_FIELDS = {
    "action": {"plan": may_be_null("object", PLAN), "trigger": must(*one_of("api", "plan_progress", "local_feedback", "fallback", "manual"))},
    "media_interval": {"sequence_first": optional(*COUNT), "sequence_last": optional(*COUNT), "received_in_window_packets": optional(*COUNT)},
}


def payload_fields(kind: str, newer: bool) -> dict[str, Field] | None:
    """The fields of a kind of payload in a version; None for an unknown kind."""
    if kind in PAYLOADS:
        return PAYLOADS[kind] | (NEW_FIELDS.get(kind, {}) if newer else {})
    return NEW_PAYLOADS.get(kind) if newer else None


def problems(value: object, known: dict[str, Field], path: str) -> list[str]:
    """What is wrong with an object; unknown fields are."""
    if not isinstance(value, dict):
        return [f"{path}: not an object"]
    out = [f"{path}.{n}: unknown" for n in value if n not in known]
    for name, field in known.items():
        at = f"{path}.{name}"
        if name not in value:
            out += [f"{at}: missing"] if field.required else []
        elif value[name] is None:
            out += [] if field.nullable else [f"{at}: null"]
        else:
            out += misfits(value[name], field.kind, at)
    return out


def misfits(x: object, kind: Kind, at: str) -> list[str]:
    """What is wrong with a value of a kind, down to the members of lists and objects."""
    name, *rest = kind
    if name == "object" and rest[0] is not None:
        return problems(x, rest[0], at)
    if name == "list" and isinstance(x, list) and len(x) <= rest[0]:
        return [issue for i, member in enumerate(x) for issue in misfits(member, rest[1], f"{at}[{i}]")]
    return [] if CHECKS[name](x, *rest) else [f"{at}: invalid"]


def within(x: object, types: type | tuple[type, ...], least: float | None, most: float | None) -> bool:
    number = isinstance(x, types) and not isinstance(x, bool) and math.isfinite(x)
    return number and (least is None or x >= least) and (most is None or x <= most)


def is_time(x: object) -> bool:
    """A time of the calendar in UTC, to the microsecond at most."""
    if not isinstance(x, str) or not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?Z", x):
        return False
    try:
        return datetime.fromisoformat(x) is not None
    except ValueError:
        return False


CHECKS = {
    "number": lambda x, least, most: within(x, (int, float), least, most),
    "whole": lambda x, least, most: within(x, int, least, most),
    "text": lambda x, most: isinstance(x, str) and 1 <= len(x) <= most,
    "pattern": lambda x, pattern: isinstance(x, str) and re.fullmatch(pattern, x) is not None,
    "word": lambda x, *words: isinstance(x, str) and x in words,
    "flag": lambda x: isinstance(x, bool),
    "object": lambda x, _: isinstance(x, dict),
    "list": lambda x, *_: False,  # no list, or too long a one
    "time": is_time,
}


def line_issues(raw: str) -> list[str]:
    """All errors of a line, of its fields, and between them."""
    try:
        body = json.loads(raw)
    except ValueError:
        return ["$: not JSON"]
    out = problems(body, ENVELOPE, "$")
    if not isinstance(body, dict) or not isinstance(body.get("payload"), dict):
        return out
    kind, payload = body.get("type"), body["payload"]
    known = payload_fields(kind, str(body.get("schema")).endswith("/1.1")) if isinstance(kind, str) else None
    if known is None:
        return [*out, "$.type: unknown"]
    out += problems(payload, known, "$.payload")
    if (body.get("validity") == "invalid") != (body.get("invalid_reason") is not None):
        out.append("$.invalid_reason: disagrees with validity")
    if kind == "media_interval" and not out:
        if payload["end_mono_ms"] <= payload["start_mono_ms"]:
            out.append("$.payload.end_mono_ms: not after start")
        if payload["received_unique_packets"] > payload["expected_packets"]:
            out.append("$.payload.received_unique_packets: more than expected")
    return out


def validate_telemetry(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` with ``issues``: all errors of each record (none: an empty list)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields if f.name != "issues")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_issues(x or "") for x in batch.column(raw).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "issues"])

    return lines.drop("issues").mapInArrow(run, f"{schema}, issues {ISSUES}")


class Malformed(ValueError):
    """A packet that breaks the rules of RTCP; the text names the rule."""


#: RFC 3550: the header of a packet, and a report block as (source, cumulative loss, highest sequence number).
RTCP_HEADER, REPORT_BLOCK = struct.Struct("!BBH"), struct.Struct("!Ix3sI12x")
#: Bytes before the report blocks of sender and receiver reports, the reporter's own source in the first word.
REPORT_HEAD = {200: 24, 201: 4}


def split_compound(data: bytes) -> list[tuple[int, int, bytes]]:
    """(type, count, body) of the packets of a compound one; only the last may be padded."""
    packets, rest = [], data
    while rest:
        if len(rest) < RTCP_HEADER.size:
            raise Malformed("rtcp_truncated")
        flags, kind, words = RTCP_HEADER.unpack_from(rest)
        body, following = rest[RTCP_HEADER.size : RTCP_HEADER.size + 4 * words], rest[RTCP_HEADER.size + 4 * words :]
        if flags >> 6 != 2 or len(body) < 4 * words:
            raise Malformed("rtcp_framing")
        if flags & 0x20:
            if following or not body or not 0 < body[-1] <= len(body):
                raise Malformed("rtcp_padding")
            body = body[: len(body) - body[-1]]
        packets.append((kind, flags & 0x1F, body))
        rest = following
    return packets


def report_blocks(data: bytes) -> tuple[list[tuple[int, int, int, int]], str | None]:
    """(reporter, ssrc, lost, highest) of the report blocks of a compound packet, or what is wrong with it."""
    try:
        reports = [(REPORT_HEAD[kind], count, body) for kind, count, body in split_compound(data) if kind in REPORT_HEAD]
        if any(len(body) < head + count * REPORT_BLOCK.size for head, count, body in reports):
            raise Malformed("rtcp_report_truncated")
    except Malformed as wrong:
        return [], str(wrong)
    blocks = [(int.from_bytes(body[:4], "big"), *block) for head, count, body in reports for block in REPORT_BLOCK.iter_unpack(body[head : head + count * REPORT_BLOCK.size])]
    return [(reporter, ssrc, int.from_bytes(lost, "big", signed=True), highest) for reporter, ssrc, lost, highest in blocks], None


def decode_rtcp(packets: DataFrame, column: str = "packet") -> DataFrame:
    """``packets`` with ``blocks`` (reporter, ssrc, lost, highest) and ``rtcp_issue`` of a binary column."""
    block = pa.struct([(n, pa.int64()) for n in ("reporter", "ssrc", "lost", "highest")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [report_blocks(x or b"") for x in batch.column(column).to_pylist()]
            blocks = pa.array([[dict(zip(("reporter", "ssrc", "lost", "highest"), b, strict=True)) for b in blocks] for blocks, _ in found], pa.list_(block))
            yield pa.RecordBatch.from_arrays([*batch.columns, blocks, pa.array([w for _, w in found], pa.string())], names=[*batch.schema.names, "blocks", "rtcp_issue"])

    return packets.mapInArrow(run, f"{schema}, blocks array<struct<reporter: bigint, ssrc: bigint, lost: bigint, highest: bigint>>, rtcp_issue string")


def telemetry_canonical(records: DataFrame, order: list[str]) -> DataFrame:
    """The first body of each (source_id, event_id), how many copies there are, and whether their bodies differ."""
    rest = [c for c in records.columns if c not in ("source_id", "event_id")]
    out = records.groupBy("source_id", "event_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("copies"), F.countDistinct(F.sha2("raw", 256)).alias("_b"))
    return out.select("source_id", "event_id", "_r.*", "copies", (F.col("_b") > 1).alias("conflict"))


def clock_guards(records: DataFrame) -> DataFrame:
    """``records`` with ``issues`` of their clock domain: repeated numbers, time running back, drift over a second, two roles; gaps are only noted."""
    w = Window.partitionBy(*DOMAIN)
    seq = w.orderBy("seq", "mono_ms")
    wall = F.unix_micros(F.to_timestamp("observed_utc")) / 1000
    rows = records.withColumn("_d", wall - F.col("mono_ms"))
    rows = rows.withColumns({
        "_same": F.count("*").over(Window.partitionBy(*DOMAIN, "seq")) > 1,
        "_gap": F.col("seq") - F.lag("seq").over(seq) > 1,
        "_back": F.col("mono_ms") < F.lag("mono_ms").over(seq),
    })
    rows = rows.withColumns({"_anyback": F.max("_back").over(w), "_drift": F.max("_d").over(w) - F.min("_d").over(w) > 1000, "_roles": F.min("role").over(w) != F.max("role").over(w)})
    named = [("_same", "duplicate_sequence"), ("_anyback", "monotonic_decrease"), ("_drift", "clock_drift"), ("_roles", "mixed_roles"), ("_gap", "sequence_gap")]
    found = F.array_compact(F.array(*[F.when(F.col(c), name) for c, name in named]))
    return rows.withColumn("issues", found).drop("_d", "_same", "_gap", "_back", "_anyback", "_drift", "_roles")


def media_intervals(windows: DataFrame, configs: DataFrame, gaps: DataFrame, semantics: list[str]) -> DataFrame:
    """Loss of media windows (domain, stream_id, direction, config_id, start_ms, end_ms, expected, received, complete, semantics_id) with issues.

    ``configs`` (domain, stream_id, config_id, mono_ms, body) must resolve to one body that began at
    or before the window; no configuration change and no ``gaps`` (domain, mono_ms) may lie inside.
    """
    key = [*DOMAIN, "stream_id"]
    one = configs.groupBy(*key, "config_id").agg(F.countDistinct("body").alias("_bodies"), F.min("mono_ms").alias("_since"))
    rows = windows.join(one, [*key, "config_id"], "left")
    for marks, by, name in ((configs, key, "_c"), (gaps, DOMAIN, "_g")):
        rows = next_mark(rows, marks, by, name)
    rows = rows.withColumn("_cut", (F.col("_c") < F.col("end_ms")) | (F.coalesce(F.col("_g") < F.col("end_ms"), F.lit(False))))
    long = F.col("end_ms") - F.col("start_ms") > 30_000
    issues = [
        F.when(F.coalesce(F.col("_bodies") != 1, F.lit(True)) | (F.col("_since") > F.col("start_ms")), "config_reference_unresolved"),
        F.when(~F.col("complete") | long, "incomplete_or_long_interval"),
        F.when(F.col("_cut"), "interval_crosses_configuration_or_collection_gap"),
        F.when(~F.col("semantics_id").isin(*semantics), "loss_semantics_unverified"),
        F.when(F.col("direction") != "local_receive", "receive_counters_required"),
        F.when(F.col("expected") <= 0, "no_expected_packets"),
    ]
    rows = rows.withColumn("issues", F.array_compact(F.array(*issues)))
    loss = 100 * (F.col("expected") - F.col("received")) / F.col("expected")
    return rows.withColumn("loss", F.when(F.size("issues") == 0, loss)).drop("_c", "_g", "_bodies", "_since", "_cut")


def next_mark(windows: DataFrame, marks: DataFrame, key: list[str], name: str) -> DataFrame:
    """``windows`` with ``name``: the first mono_ms of a mark of the key after the start, by one sort of both."""
    both = windows.withColumn("_at", F.col("start_ms").cast("double")).unionByName(marks.select(*key, F.col("mono_ms").cast("double").alias("_at"), F.lit(True).alias("_mark")), allowMissingColumns=True)
    after = F.min(F.when(F.col("_mark"), F.col("_at"))).over(Window.partitionBy(*key).orderBy(F.desc("_at"), F.coalesce("_mark", F.lit(False))).rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn(name, after).where("_mark IS NULL").drop("_mark", "_at")


STREAM_SQL = "stream: struct<stream_id: string, ssrc: bigint, direction: string, call_id: string>"


def payload_of(records: DataFrame, kind: str, shape: str) -> DataFrame:
    """The records of a kind: domain, event_id, mono_ms, the raw payload and the fields of ``shape``."""
    rows = records.where(F.col("type") == kind).withColumn("_p", F.from_json("payload", f"struct<{shape}>"))
    return rows.select(*DOMAIN, "event_id", "mono_ms", "payload", "_p.*")


def media_records(records: DataFrame) -> DataFrame:
    shape = f"{STREAM_SQL}, config_id: string, counter_epoch: string, sequence_first: bigint, sequence_last: bigint, start_mono_ms: double, end_mono_ms: double, expected_packets: bigint, received_unique_packets: bigint, received_in_window_packets: bigint, complete: boolean, semantics_id: string"
    return payload_of(records, "media_interval", shape).select(*DOMAIN, "event_id", "stream.stream_id", "stream.direction", "config_id", F.col("start_mono_ms").alias("start_ms"), F.col("end_mono_ms").alias("end_ms"), F.col("expected_packets").alias("expected"), F.coalesce("received_in_window_packets", "received_unique_packets").alias("received"), "complete", "semantics_id", "counter_epoch", "sequence_first", "sequence_last")


def config_records(records: DataFrame) -> DataFrame:
    return payload_of(records, "media_config", f"{STREAM_SQL}, config_id: string").select(*DOMAIN, "stream.stream_id", "config_id", "mono_ms", F.col("payload").alias("body"))


def gap_records(records: DataFrame) -> DataFrame:
    """Times at which the collection of media or clocks, or the log itself, was interrupted."""
    rows = payload_of(records, "collection", "subsystem: string, status: string")
    return rows.where(F.col("subsystem").isin("media", "clock", "logger") & ~F.col("status").isin("started", "resumed")).select(*DOMAIN, "mono_ms")


def rtcp_records(records: DataFrame) -> DataFrame:
    """The one block of each packet about its own stream; a packet with none, several or a broken frame isn't ok."""
    rows = payload_of(records, "rtcp", f"{STREAM_SQL}, transport_direction: string, packet_hex: string")
    rows = decode_rtcp(rows.select(*DOMAIN, "stream.stream_id", "stream.ssrc", "transport_direction", "mono_ms", F.unhex("packet_hex").alias("packet")))
    own = F.filter("blocks", lambda b: b["ssrc"] == F.col("ssrc"))
    one = F.when(F.size(own) == 1, F.get(own, F.lit(0)))
    return rows.select(*DOMAIN, "stream_id", "transport_direction", "mono_ms", one["reporter"].alias("reporter"), one["highest"].alias("highest"), one["lost"].alias("lost"), (F.col("rtcp_issue").isNull() & (F.size(own) == 1)).alias("ok"))


def fix_records(records: DataFrame) -> DataFrame:
    """One row a time of fixes: ok if they agree."""
    rows = payload_of(records, "position", "fix_mono_ms: double, latitude: double, longitude: double")
    same = (F.min("latitude") == F.max("latitude")) & (F.min("longitude") == F.max("longitude"))
    return rows.groupBy(*DOMAIN, F.col("fix_mono_ms").alias("mono_ms")).agg(same.alias("ok"), F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))


def network_records(records: DataFrame) -> DataFrame:
    """One row a time of the accesses of the media's path: ok if they agree."""
    rows = payload_of(records, "network", "scope: string, access: string").where("scope = 'media_path'")
    return rows.groupBy(*DOMAIN, "mono_ms").agg((F.min("access") == F.max("access")).alias("ok"), F.min("access").alias("access"))


PLAN_SQL = "plan: struct<plan_id: string, revision: bigint>"


def plan_records(records: DataFrame) -> DataFrame:
    rows = payload_of(records, "plan_received", f"{PLAN_SQL}, valid_until_mono_ms: double, content_sha256: string")
    return rows.select(*DOMAIN, "plan.plan_id", "plan.revision", "mono_ms", F.col("valid_until_mono_ms").alias("valid_until_ms"), F.col("content_sha256").alias("body"))


def plan_references(records: DataFrame) -> DataFrame:
    """Plans that actions and states of plans refer to; ``state`` is NULL for an action."""
    states = payload_of(records, "plan_state", f"{PLAN_SQL}, state: string")
    actions = payload_of(records, "action", PLAN_SQL).withColumn("state", F.lit(None).cast("string"))
    return states.unionByName(actions).where("plan IS NOT NULL").select(*DOMAIN, "event_id", "plan.plan_id", "plan.revision", "state", "mono_ms")


def rtcp_intervals(reports: DataFrame, key: list[str]) -> DataFrame:
    """Loss between consecutive reports (key, mono_ms, reporter, highest, lost, ok) of one stream, with issues; a report that isn't ok clears the one before."""
    by = Window.partitionBy(*key).orderBy("mono_ms")
    rows = reports.withColumn("_run", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(by)).where("ok")
    run = Window.partitionBy(*key, "_run").orderBy("mono_ms")
    rows = rows.withColumns({f"_p{c}": F.lag(c).over(run) for c in ("mono_ms", "reporter", "highest", "lost")})
    dt, dh, dl = (F.col(c) - F.col(f"_p{c}") for c in ("mono_ms", "highest", "lost"))
    issue = (
        F.when(F.col("_pmono_ms").isNull(), "rtcp_baseline_only")
        .when((dt <= 0) | (dt > 30_000), "rtcp_interval_length")
        .when(F.col("reporter") != F.col("_preporter"), "rtcp_reporter_changed")
        .when((dh <= 0) | (dl < 0) | (dl > dh), "rtcp_counter_reset")
    )
    out = rows.select(*key, F.col("_pmono_ms").alias("start_ms"), F.col("mono_ms").alias("end_ms"), F.when(issue.isNull(), 100 * dl / dh).alias("loss"), issue.alias("issue"))
    return out


def suppress_overlaps(intervals: DataFrame, key: list[str]) -> DataFrame:
    """Intervals (key, method, start_ms, end_ms): windows beat reports where they overlap; of one method both that overlap go.

    Islands of overlapping intervals are found by one sort; intervals that overlap nothing aren't joined.
    """
    by = Window.partitionBy(*key, "method").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(by.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.lead("start_ms").over(by)
    alone = intervals.withColumns({"_r": reach, "_n": ahead}).where((F.col("_r").isNull() | (F.col("_r") <= F.col("start_ms"))) & (F.col("_n").isNull() | (F.col("_n") >= F.col("end_ms")))).drop("_r", "_n")
    windows, reports = alone.where("method = 'media_window'"), alone.where("method <> 'media_window'")
    every = intervals.where("method = 'media_window'")  # windows that go beat reports, too
    both = every.select(*key, "start_ms", "end_ms", F.lit(0).alias("_s")).unionByName(reports.select(*key, "start_ms", "end_ms", F.lit(1).alias("_s")))
    order = Window.partitionBy(*key).orderBy("start_ms", "_s")
    back = Window.partitionBy(*key).orderBy(F.desc("start_ms"), F.desc("_s"))  # looking ahead is looking back in the other order
    w = F.when(F.col("_s") == 0, F.col("end_ms"))
    nxt = F.when(F.col("_s") == 0, F.col("start_ms"))
    both = both.withColumns({"_r": F.max(w).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.min(nxt).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    lost = both.where("_s = 1 AND (_r > start_ms OR _n < end_ms)").select(*key, "start_ms", "end_ms")
    return windows.unionByName(reports.join(lost.hint("merge"), [*key, "start_ms", "end_ms"], "left_anti"))


def reused_sequences(windows: DataFrame, key: list[str], modulus: int | None = None) -> DataFrame:
    """``windows`` (key, start_ms, sequence_first, sequence_last) with ``reused``: a window begins at or before the last number of the one before it; both of them are.

    ``key`` names the stream and the epoch of its counter. Numbers go on without end, or with
    ``modulus`` begin again: then a step of more than half the space goes the other way round, and a
    window whose last number is less than its first goes over the edge. Windows
    without numbers reuse nothing and stand between no others.
    """
    numbered = F.col("sequence_first").isNotNull() & F.col("sequence_last").isNotNull()
    rows = windows.withColumn("_numbered", numbered)
    by = Window.partitionBy(*key, "_numbered").orderBy("start_ms", "sequence_first", "sequence_last")
    first, last = F.col("sequence_first"), F.col("sequence_last")
    if modulus:
        step = first - F.lag(first).over(by)
        wrapped = F.when(step < -(modulus // 2), 1).when(step > modulus // 2, -1).otherwise(0)
        rows = rows.withColumn("_wrapped", wrapped).withColumn("_cycle", F.sum("_wrapped").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_wrapped")
        first, last = first + F.col("_cycle") * modulus, last + (F.col("_cycle") + (last < first).cast("long")) * modulus
    rows = rows.withColumns({"_first": first, "_last": last})
    back = F.coalesce(F.col("_first") <= F.lag("_last").over(by), F.lit(False)) | F.coalesce(F.lead("_first").over(by) <= F.col("_last"), F.lit(False))
    return rows.withColumn("reused", F.col("_numbered") & back).drop("_numbered", "_first", "_last", *(["_cycle"] if modulus else []))


#: Kinds of references: what has to be declared by then, and the issue where it isn't.
REFERENCES = {"request": "request_reference_unresolved", "plan": "plan_reference_unresolved", "position": "position_reference_unresolved", "config": "config_reference_unresolved"}


def audit_references(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """(domain, event_id, issues) of every event that refers to something: requests, plans, positions and configurations, checked in one pass over time.

    ``references``: domain, event_id, kind, ref (what is named), mono_ms, activates. ``declarations``:
    domain, kind, ref, mono_ms, usable, body, until_ms. A request, plan or position has to have been
    declared by a usable record at that time or before. Of a configuration the newest
    declaration counts, which has to be a single usable one, and all declarations of one name
    have to agree. A plan that is activated must not have ended (``until_ms``) in all its declarations.
    """
    key = [*DOMAIN, "kind", "ref"]
    stamps = declarations.groupBy(*key, "mono_ms").agg(F.count("*").alias("_n"), F.count_if("usable").alias("_usable"), F.max(F.when(F.col("usable"), F.col("until_ms"))).alias("_until"), F.min("body").alias("_low"), F.max("body").alias("_high"))
    both = references.withColumn("_side", F.lit(1)).unionByName(stamps.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*key).orderBy("mono_ms", "_side").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*key)
    newest = F.last(F.when(F.col("_side") == 0, F.struct("_n", "_usable")), ignorenulls=True).over(so_far)
    both = both.withColumns({
        "_known": F.coalesce(F.sum("_usable").over(so_far), F.lit(0)),
        "_ends": F.max("_until").over(so_far),
        "_newest": newest,
        "_agree": F.coalesce(F.min("_low").over(every) == F.max("_high").over(every), F.lit(True)),
    }).where("_side = 1")
    single = F.coalesce((F.col("_newest._n") == 1) & (F.col("_newest._usable") == 1), F.lit(False)) & F.col("_agree")
    found = F.when(F.col("kind") == "config", single).otherwise(F.col("_known") > 0)
    names = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    ended = F.col("activates") & found & (F.col("_ends") <= F.col("mono_ms"))
    issue = F.when(~found, names[F.col("kind")]).when(F.coalesce(ended, F.lit(False)), "expired_plan_activation")
    return both.groupBy(*DOMAIN, "event_id").agg(F.sort_array(F.collect_set(issue)).alias("issues"))


def plan_key(plan: str = "plan") -> Column:
    return F.concat_ws(":", F.col(f"{plan}.plan_id"), F.col(f"{plan}.revision").cast("string"))


def stream_key(stream: str = "stream") -> Column:
    return F.to_json(F.struct(*[F.col(f"{stream}.{c}") for c in ("call_id", "sip_call_id", "stream_id", "ssrc", "direction")]), {"ignoreNullFields": "false"})


def declared(records: DataFrame) -> DataFrame:
    """What records declare that others may refer to: started requests, plans, positions (by their event) and configurations (by stream and name)."""
    names = [*DOMAIN, "mono_ms", "usable"]
    none = F.lit(None)
    kept = records.select(*names, "type", "event_id", "payload")

    def of(kind: str, shape: str, name: str, ref: Column, body: Column = none, until: Column = none, only: str = "true") -> DataFrame:
        rows = kept.where(F.col("type") == kind).select(*names, "event_id", "payload", F.from_json("payload", f"struct<{shape}>").alias("_p")).select(*names, "event_id", "payload", "_p.*")
        return rows.where(only).select(*names, F.lit(name).alias("kind"), ref.alias("ref"), body.cast("string").alias("body"), until.cast("double").alias("until_ms"))

    wide = STREAM_SQL.replace("call_id: string>", "call_id: string, sip_call_id: string>")
    return (
        of("api_request", "request_id: string, phase: string", "request", F.col("request_id"), only="phase = 'started'")
        .unionByName(of("plan_received", f"{PLAN_SQL}, valid_until_mono_ms: double", "plan", plan_key(), until=F.col("valid_until_mono_ms")))
        .unionByName(of("position", "latitude: double", "position", F.col("event_id")))
        .unionByName(of("media_config", f"{wide}, config_id: string", "config", F.concat_ws("|", stream_key(), "config_id"), body=F.col("payload")))
    )


def referring(records: DataFrame) -> DataFrame:
    """What records refer to: plans their requests, states and actions their plans, states their measured positions, actions their two configurations."""
    names = [*DOMAIN, "event_id", "mono_ms"]
    wide = STREAM_SQL.replace("call_id: string>", "call_id: string, sip_call_id: string>")
    shapes = {
        "plan_received": "request_id: string",
        "plan_state": f"{PLAN_SQL}, state: string, position_basis: string, position_event_id: string",
        "action": f"{PLAN_SQL}, {wide}, old_config_id: string, new_config_id: string",
    }
    rows = {k: records.where(F.col("type") == k).select(*names, F.from_json("payload", f"struct<{v}>").alias("_p")).select(*names, "_p.*") for k, v in shapes.items()}
    made = lambda df, kind, ref, activates=F.lit(False): df.select(*names, F.lit(kind).alias("kind"), ref.alias("ref"), activates.alias("activates"))
    state, action = rows["plan_state"], rows["action"]
    return (
        made(rows["plan_received"], "request", F.col("request_id"))
        .unionByName(made(state.where("plan IS NOT NULL"), "plan", plan_key(), F.col("state").isin("activated", "resumed")))
        .unionByName(made(action.where("plan IS NOT NULL"), "plan", plan_key()))
        .unionByName(made(state.where("position_basis = 'measured'"), "position", F.coalesce("position_event_id", F.lit(""))))
        .unionByName(made(action.withColumn("_id", F.explode(F.array("old_config_id", "new_config_id"))), "config", F.concat_ws("|", stream_key(), F.coalesce("_id", F.lit("")))))
    )


def plan_audit(actions: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan references (domain, plan_id, revision, mono_ms) with issues: unknown then, contradicting bodies, expired."""
    known = plans.groupBy(*DOMAIN, "plan_id", "revision").agg(F.min("mono_ms").alias("_since"), F.max("valid_until_ms").alias("_until"), F.countDistinct("body").alias("_bodies"))
    rows = actions.join(known, [*DOMAIN, "plan_id", "revision"], "left")
    issues = F.array_compact(F.array(F.when(F.coalesce(F.col("_since") > F.col("mono_ms"), F.lit(True)), "plan_reference_unresolved"), F.when(F.col("_bodies") > 1, "plan_revision_conflict"), F.when(F.col("_until") < F.col("mono_ms"), "plan_expired")))
    return rows.withColumn("issues", issues).drop("_since", "_until", "_bodies")


def telemetry_status(records: DataFrame, intervals: DataFrame) -> DataFrame:
    """Records, conflicts, records with issues, and intervals."""
    said = records.select(F.lit(1).alias("r"), F.col("conflict").cast("int").alias("c"), (F.size("issues") > 0).cast("int").alias("w"), F.lit(0).alias("i"))
    both = said.unionByName(intervals.select(*[F.lit(0).alias(c) for c in "rcw"], F.lit(1).alias("i")))
    names = {"r": "records", "c": "conflicts", "w": "with_issues", "i": "intervals"}
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in names.items()])
