"""Queries of the log operators over records that Spark renders from the given tables.

Every row of ``events`` becomes a record of a log format and is parsed again, so that the work
grows with the table; where the parsed values can be told from the columns, SQL says what they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calls as C
from ..operators import extract as X
from ..operators import incidents as N
from ..operators import network as K
from ..operators import telemetry as T
from ..sources import archives as A
from .core_queries import HOUR, MINUTE, read


def rendered(spark: SparkSession, sf_dir: str, name: str, parser: str, form: str, *columns: str) -> DataFrame:
    """Records of ``events``: a file per user, a text by printf form."""
    e = read(spark, sf_dir, "events")
    text = F.format_string(form, *[F.expr(c) for c in columns])
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("import_id"), F.concat(F.lit(name), F.col("user_id")).alias("name"), F.lit(parser).alias("parser"), F.col("event_id").alias("line_no"), "ts", text.alias("text"))


def x1_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents, one begun by each line that ends in a full stop's line with a capital T."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("import_id"), F.lit("d").alias("name"), "text")
    rows = X.split_records(docs, F.col("line").startswith("T"))
    return rows.groupBy("import_id").agg(F.count("*").alias("records"), F.max("line_no").alias("last_line"), F.sum(F.length("text")).alias("chars"))


def x2_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "[%s] [CORE] [INFO] event"
    r = rendered(spark, sf_dir, "core", "kpe", form, "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')")
    return r.select(F.col("line_no").alias("event_id"), X.parse_timestamp(X.first_line()).alias("parsed"))


def x3_level_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir, "core", "kpe", "[t] [CORE] [%s] state of line %d", "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END", "user_id")
    return X.parse_level_line(r).groupBy("level", "line_id").agg(F.count("*").alias("records"))


def x5_rotation_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir, "core", "kpe", "%s", "event_type").withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return X.flag_rotation_duplicates(r).groupBy("import_id", "duplicate").agg(F.count("*").alias("records"))


def x8_extract_rtcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "[t] [LINE 1 FLOW %d] RTCP ARRIVED\nSSRC of this source: %d\nPacket loss we perceive from this source (since last report): %.3f%%\nRTT to this source: %d ms\nReceiver Report - pkt lost by this peer (total): %d"
    r = rendered(spark, sf_dir, "rtplog", "rtcp", form, "user_id % 4", "user_id", "value", "event_id % 300", "event_id % 1000")
    out = X.extract_rtcp(r)
    return out.groupBy("metric", "direction", "flow").agg(F.count("*").alias("samples"), F.count_if("valid").alias("valid"), F.round(F.sum("value"), 2).alias("total"))


def x10_device_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "head\nDevice name: NART%d of Line %d\nbuffer len in usecs: %d\nDevice name: Default Audio Output\nbuffer len in usecs: 7"
    r = rendered(spark, sf_dir, "vdlog", "vd", form, "user_id % 3", "user_id % 5", "event_id")
    return X.extract_device_metrics(r).groupBy("metric", "line_id", "flow").agg(F.count("*").alias("samples"), F.round(F.sum("value"), 3).alias("total"))


def x11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "[t] [Default Audio Output] READING Virtual Output Device Running Info\nDevice name: Default Audio Output\nAudio currently in buffer (ms): %d\nCONNECTED INPUT DEVICE\nDevice name: NART0 of Line %d\nnumber of buffer underruns occurred on this ring for this VOD: %d"
    r = rendered(spark, sf_dir, "vdlog", "vd", form, "event_id % 100", "user_id % 5", "event_id % 9")
    out = X.extract_periodic(r).withColumn("line_id", F.coalesce("line_id", F.lit(-1)))
    return out.groupBy("metric", "line_id").agg(F.count("*").alias("samples"), F.round(F.sum("value"), 3).alias("total"))


def x13_missing_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "[t] [NART0 of Line %d] Packet loss occurred. Current packet SN is %d. Previous packet SN was 1 SN delta is 2 ( %d missing packets)."
    r = rendered(spark, sf_dir, "vdlog", "vd", form, "user_id % 5", "event_id", "event_id % 50")
    return X.extract_missing_packets(r).groupBy("line_id").agg(F.count("*").alias("notices"), F.sum("value").alias("packets"))


def x14_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "x : New location received: Location[fused %.4f,%.4f hAcc=%d et=+%ds]"
    r = rendered(spark, sf_dir, "app", "raw", form, "cast(user_id % 120 as double)", "value", "user_id % 30", "event_id % 60")
    out = X.extract_positions(r).withColumn("seconds", S.elapsed_seconds("elapsed"))
    return out.groupBy("kind", "valid").agg(F.count("*").alias("fixes"), F.round(F.sum("latitude"), 2).alias("latitudes"), F.sum("seconds").alias("seconds"))


def x16_network_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "x : Current network interface: %s"
    r = rendered(spark, sf_dir, "app", "raw", form, "element_at(array('wifi', 'cellular', 'ethernet', 'vpn'), cast(user_id % 4 as int) + 1)")
    return X.extract_network_obs(r).groupBy("access", "upstream").agg(F.count("*").alias("rows_"))


def x17_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "x Network %s"
    r = rendered(spark, sf_dir, "vdklog", "raw", form, "element_at(array('UP for both pingers', 'DOWN for ONE pingers', 'DOWN for BOTH pingers'), cast(event_id % 3 as int) + 1)")
    return X.extract_connectivity(r).groupBy("layer", "state").agg(F.count("*").alias("rows_"))


def x18_transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "x Received route change notification: AVAudioSessionRouteChangeReason(rawValue: %d)"
    return X.extract_transients(rendered(spark, sf_dir, "app", "raw", form, "event_id % 6")).groupBy("type", "detail").agg(F.count("*").alias("rows_"))


def s4_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    name = F.concat(F.lit("logs/"), F.element_at(F.array(*[F.lit(x) for x in ("kpelog.1.txt", "SIP_debug.log", "rtplog_3.log", "other.txt", "telemetry-1.jsonl")]), (F.col("event_id") % 5).cast("int") + 1))
    return e.select(A.classify_file(name).alias("parser"), A.file_family(name).alias("family")).groupBy("parser", "family").agg(F.count("*").alias("files"))


def s7_file_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.file_coverage(rendered(spark, sf_dir, "core", "kpe", "%s", "event_type")).select("import_id", "name", "first_ts", "last_ts", "records", "undated_head")


def i8_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of start and end signals by user: errors begin, purchases end."""
    e = read(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    signals = e.select("user_id", F.when(F.col("event_type") == "error", "start").otherwise("end").alias("phase"), S.micros("ts").alias("t_us"), F.lit(None).cast("double").alias("duration_ms"))
    out = N.reconstruct_incidents(signals, ["user_id"])
    return out.groupBy("status", "start_basis").agg(F.count("*").alias("episodes"), F.round(F.sum("duration_ms"), 3).alias("duration_ms"))


def i10_incident_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    signals = e.select("user_id", F.when(F.col("event_type") == "error", "start").otherwise("end").alias("phase"), S.micros("ts").alias("t_us"), F.lit(None).cast("double").alias("duration_ms"))
    placed = N.place_incidents(N.reconstruct_incidents(signals, ["user_id"]), "log_span")
    edges = e.groupBy("user_id").agg(S.micros(F.min("ts")).alias("anchor_us"), (S.micros(F.max("ts")) + 1).alias("stop_us")).withColumn("begin_us", F.col("anchor_us"))
    out = N.incident_windows(placed, edges, ["user_id"], 24 * HOUR)
    return out.groupBy("user_id").agg(F.count("*").alias("bins"), F.count("percent").alias("known"), F.round(F.sum("occupied_ms"), 3).alias("occupied_ms"))


def i11_pq_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity per minute from a user's first to last event, with errors that end at the next purchase."""
    e = read(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    signals = e.select(F.col("user_id").alias("perspective_id"), F.lit("o").alias("observer"), F.when(F.col("event_type") == "error", "start").otherwise("end").alias("phase"), S.micros("ts").alias("t_us"), F.lit(None).cast("double").alias("duration_ms"))
    episodes = N.reconstruct_incidents(signals, ["perspective_id", "observer"])
    calls = e.groupBy(F.col("user_id").alias("perspective_id")).agg(S.micros(F.min("ts")).alias("begin_us"), (S.micros(F.max("ts")) + 1).alias("stop_us"))
    out = N.pq_runs(episodes, calls, ["observer"], width_us=MINUTE).withColumn("n", F.col("last_bin") - F.col("first_bin") + 1)
    return out.groupBy("perspective_id").agg(F.sum("n").alias("minutes"), F.round(F.sum(F.col("pq") * F.col("n")) / F.sum("n"), 6).alias("pq"))


def i12_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    layer = F.element_at(F.array(*[F.lit(x) for x in ("stun", "cti", "sip", "device", "app")]), (F.col("event_id") % 5).cast("int") + 1)
    events = e.select("user_id", "ts", F.col("event_id").alias("ord"), layer.alias("layer"), F.when(F.col("value") < 60, "up").otherwise("down").alias("state"))
    bounds = e.groupBy("user_id").agg(F.min("ts").alias("begin"), F.max("ts").alias("stop"))
    out = K.connectivity_timeline(events, bounds, ["user_id"], 6 * HOUR)
    return out.groupBy("lane", "state").agg(F.count("*").alias("segments"), F.round(F.sum((S.micros("end") - S.micros("start")) / 1e6), 3).alias("seconds"))


def w6_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("value").alias("low"), F.max("value").alias("value"))
    fixes = e.select(F.col("user_id").cast("string").alias("import_id"), S.micros("ts").alias("t_us"), (F.col("low") == F.col("value")).alias("ok"), (45 + F.col("value") / 10000).alias("latitude"), F.lit(9.0).alias("longitude"), F.lit(5.0).alias("accuracy"), F.lit(None).cast("string").alias("elapsed"), F.lit(None).cast("double").alias("elapsed_s"))
    out = K.movement_sequences(fixes, gap_us=12 * HOUR)
    return out.groupBy("reason").agg(F.count("*").alias("samples"))


def c1_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of users' lines: views add, clicks connect, purchases end."""
    e = read(spark, sf_dir, "events").where("event_type IN ('view', 'click', 'purchase')")
    event = F.when(F.col("event_type") == "view", "added").when(F.col("event_type") == "click", "connected").otherwise("ended")
    life = e.select(F.lit("i").alias("import_id"), F.col("user_id").cast("int").alias("line_id"), "ts", F.col("event_id").alias("ord"), event.alias("event"), F.lit(None).cast("string").alias("call_id"))
    return C.reconstruct_legs(life).groupBy("incomplete").agg(F.count("*").alias("legs"), F.count("connected").alias("connected"))


def c3_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    p = o.select(F.concat(F.lit("i"), F.col("o_orderkey") % 3).alias("import_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("call_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("start"), F.col("o_orderdate").cast("timestamp_ntz").alias("end"), F.lit(None).cast("timestamp_ntz").alias("connected"))
    return C.build_calls(p).groupBy("perspectives").agg(F.count("*").alias("calls"))


def c8_dedup_within_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_within_gap(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], gap_us=2 * HOUR).groupBy("user_id").agg(F.count("*").alias("kept"))


def c9_mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    p = o.select((F.col("o_orderkey") % 5).alias("import_seq"), F.concat(F.lit("i"), F.col("o_orderkey") % 5).alias("import_id"), F.col("o_custkey").alias("call_id")).distinct()
    producers = spark.range(5).select(F.concat(F.lit("i"), "id").alias("import_id"), F.lit("resolved").alias("status"), F.concat(F.lit("p"), F.col("id") % 2).alias("producer"))
    return C.mark_duplicates(p, producers).groupBy("import_id").agg(F.count("*").alias("calls"), F.count("duplicate_of").alias("duplicates"))


def c16_conversation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    uuids = o.select(F.concat(F.lit("u"), F.col("o_custkey")).alias("uuid"), F.col("o_orderkey").cast("string").alias("call_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("start"))
    p = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("x"), F.col("l_orderkey")).alias("call_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("start"))
    out = C.conversation_groups(uuids, p)
    return out.groupBy("basis", "review").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("calls"))


def c18_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    p = o.select((F.col("o_orderkey") % 5).alias("import_seq"), F.concat(F.lit("i"), F.col("o_orderkey") % 5).alias("import_id"), F.col("o_custkey").alias("call_id"))
    return C.import_counts(p).select("import_id", "calls", "new", "known")


def x26_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines made of events: an event's value is a latitude, which is out of range for some."""
    e = read(spark, sf_dir, "events")
    body = F.format_string('{"schema":"telemetry/1","type":"packet","event_id":"e%d","source_id":"s","session_id":"x","boot_id":"b","seq":%d,"role":"app","observed_utc":"2026-01-01T00:00:00Z","mono_ms":1,"validity":"valid","invalid_reason":null,"payload":{"stream":{"call_id":"c","sip_call_id":null,"stream_id":"t","ssrc":1,"direction":"local_receive"},"sequence":%d,"rtp_timestamp":1,"size_bytes":%d,"status":"sent","reason":null,"deadline_mono_ms":null}}', "event_id", "event_id", F.col("event_id") * 7, F.floor("value"))
    return T.validate_telemetry(e.select("event_id", body.alias("raw"))).select("event_id", F.size("issues").alias("issues"))


def x27_decode_rtcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver reports made of events, decoded again."""
    e = read(spark, sf_dir, "events")
    hexed = F.format_string("81C90007%08X%08X%02X%06X%08X%s", F.col("user_id"), F.lit(7), F.lit(0), F.col("event_id") % 1000, F.col("event_id"), F.lit("0" * 24))
    out = T.decode_rtcp(e.select("event_id", F.unhex(hexed).alias("packet"))).select("rtcp_issue", F.explode("blocks").alias("b"))
    return out.groupBy(F.col("b.reporter").alias("reporter")).agg(F.count("*").alias("blocks"), F.sum("b.lost").alias("lost"), F.max("b.highest").alias("highest"))


def r2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("event_id"), F.col("event_id").alias("line"), F.floor("value").cast("string").alias("raw"))
    return T.telemetry_canonical(rows, ["line"]).select("source_id", "event_id", "raw", "copies", "conflict")


def i16_clock_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rows = e.select(F.lit("s").alias("source_id"), F.col("user_id").cast("string").alias("session_id"), F.lit("b").alias("boot_id"), F.row_number().over(_by_user()).alias("seq"), F.lit("app").alias("role"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_utc"), (F.col("event_id") * 1.0).alias("mono_ms"))
    return T.clock_guards(rows).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("records"))


def _by_user():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.where(F.contains("text", F.lit("the and")) & (F.col("lang") == "en")).select("doc_id", "source")


def p2_search_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where(F.col("c_name").ilike("%00001%")).select("c_custkey", "c_name")


def p6_sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User SQL with named parameters over temporary views."""
    from .views import run_sql

    views = {"calls": read(spark, sf_dir, "orders"), "parties": read(spark, sf_dir, "customer")}
    sql = "SELECT c_nationkey AS nation, count(*) AS calls, max(o_totalprice) AS top FROM calls JOIN parties ON o_custkey = c_custkey WHERE o_totalprice >= :least GROUP BY c_nationkey"
    return run_sql(spark, views, sql, {"least": 1000.0})


LINES = "ln AS (SELECT doc_id, text, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM documents)"
ISLAND_US = 24 * HOUR

ORACLE: dict[str, str] = {
    "x1_split_records": """WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
        n AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM t),
        f AS (SELECT *, CAST(sum(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS r FROM n),
        r AS (SELECT doc_id, r, min(n) AS n, sum(length(line)) + count(*) - 1 AS c FROM f GROUP BY doc_id, r)
        SELECT doc_id AS import_id, count(*) AS records, CAST(max(n) AS INT) AS last_line, CAST(sum(c) AS BIGINT) AS chars FROM r GROUP BY doc_id""",
    "x2_timestamps": "SELECT event_id, ts AS parsed FROM events",
    "x3_level_line": "SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CAST(user_id AS INT) AS line_id, count(*) AS records FROM events GROUP BY ALL",
    "x5_rotation_duplicates": """WITH d AS (SELECT 'u' || user_id % 7 AS import_id, row_number() OVER (PARTITION BY user_id % 7, date_trunc('day', ts), event_type) > 1 AS duplicate FROM events)
        SELECT import_id, duplicate, count(*) AS records FROM d GROUP BY ALL""",
    "x8_extract_rtcp": """WITH v AS (SELECT user_id % 4 AS f, round(value, 3) AS loss, event_id % 300 AS rtt, event_id % 1000 AS lost FROM events),
        m AS (SELECT 'rtcp.loss' AS metric, 'incoming' AS direction, f, loss AS x, loss BETWEEN 0 AND 100 AS ok FROM v UNION ALL SELECT 'rtcp.rtt', 'roundtrip', f, rtt, true FROM v UNION ALL SELECT 'rtcp.packets_lost_total', 'outgoing', f, lost, true FROM v)
        SELECT metric, direction, CAST(f AS VARCHAR) AS flow, count(*) AS samples, count(*) FILTER (WHERE ok) AS valid, round(sum(x), 2) AS total FROM m GROUP BY ALL""",
    "x10_device_metrics": "SELECT 'vd.buffer' AS metric, CAST(user_id % 5 AS INT) AS line_id, CAST(user_id % 3 AS VARCHAR) AS flow, count(*) AS samples, round(sum(event_id * 0.001::DOUBLE), 3) AS total FROM events GROUP BY ALL",
    "x11_periodic": """SELECT 'vd.buffer' AS metric, CAST(-1 AS INT) AS line_id, count(*) AS samples, round(sum(event_id % 100)::DOUBLE, 3) AS total FROM events
        UNION ALL SELECT 'vd.underruns', CAST(user_id % 5 AS INT), count(*), round(sum(event_id % 9)::DOUBLE, 3) FROM events GROUP BY user_id % 5""",
    "x13_missing_packets": "SELECT CAST(user_id % 5 AS INT) AS line_id, count(*) AS notices, sum(event_id % 50)::DOUBLE AS packets FROM events WHERE event_id % 50 > 0 GROUP BY ALL",
    "x14_positions": """WITH p AS (SELECT (user_id % 120)::DOUBLE AS lat, round(value, 4) AS lon, event_id % 60 AS s FROM events)
        SELECT 'fresh' AS kind, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid, count(*) AS fixes, round(sum(lat), 2) AS latitudes, sum(s)::DOUBLE AS seconds FROM p GROUP BY ALL""",
    "x16_network_obs": "SELECT CASE user_id % 4 WHEN 0 THEN 'wifi' WHEN 1 THEN 'cellular' WHEN 2 THEN 'ethernet' ELSE 'unknown' END AS access, CASE user_id % 4 WHEN 1 THEN 'mobile_direct' ELSE 'unknown' END AS upstream, count(*) AS rows_ FROM events GROUP BY ALL",
    "x17_connectivity": "SELECT 'stun' AS layer, CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'transient' ELSE 'down' END AS state, count(*) AS rows_ FROM events GROUP BY ALL",
    "x18_transients": "SELECT 'audio_route_change' AS type, 'reason_code:' || event_id % 6 AS detail, count(*) AS rows_ FROM events GROUP BY ALL",
    "s4_classify": "SELECT CASE event_id % 5 WHEN 0 THEN 'kpe' WHEN 1 THEN 'sip' WHEN 2 THEN 'rtcp' WHEN 3 THEN 'raw' ELSE 'telemetry' END AS parser, CASE event_id % 5 WHEN 0 THEN 'kpelog' WHEN 1 THEN 'sip_debug' WHEN 2 THEN 'rtplog' WHEN 3 THEN 'other' ELSE 'telemetry' END AS family, count(*) AS files FROM events GROUP BY ALL",
    "s7_file_coverage": "SELECT 'u' || user_id % 7 AS import_id, 'core' || user_id AS name, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS records, false AS undated_head FROM events GROUP BY user_id",
    "c3_calls": "WITH c AS (SELECT o_custkey, count(*) AS perspectives FROM orders GROUP BY o_custkey) SELECT perspectives, count(*) AS calls FROM c GROUP BY perspectives",
    "c9_mark_duplicates": """WITH p AS (SELECT DISTINCT o_orderkey % 5 AS i, o_custkey AS c FROM orders), f AS (SELECT *, min(i) OVER (PARTITION BY i % 2, c) AS first FROM p)
        SELECT 'i' || i AS import_id, count(*) AS calls, count(*) FILTER (WHERE first <> i) AS duplicates FROM f GROUP BY i""",
    "c16_conversation_groups": """WITH u AS (SELECT o_custkey, count(*) AS n, date_diff('microsecond', min(o_orderdate::TIMESTAMP), max(o_orderdate::TIMESTAMP)) > 86400000000 AS review FROM orders GROUP BY o_custkey),
        l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)
        SELECT 'shared_uuid' AS basis, review, count(*) AS groups, CAST(sum(n) AS BIGINT) AS calls FROM u GROUP BY review UNION ALL SELECT 'several_perspectives', false, count(*), count(*) FROM l""",
    "c18_import_counts": """WITH p AS (SELECT DISTINCT o_orderkey % 5 AS i, o_custkey AS c FROM orders), f AS (SELECT *, min(i) OVER (PARTITION BY c) AS first FROM p)
        SELECT 'i' || i AS import_id, count(*) AS calls, count(*) FILTER (WHERE first = i) AS new, count(*) FILTER (WHERE first < i) AS known FROM f GROUP BY i""",
    "x26_validate": "SELECT event_id, CAST((event_id * 7 > 65535)::INT + (floor(value) < 0)::INT AS INT) AS issues FROM events",
    "x27_decode_rtcp": "SELECT user_id AS reporter, count(*) AS blocks, CAST(sum(event_id % 1000) AS BIGINT) AS lost, max(event_id) AS highest FROM events GROUP BY user_id",
    "r2_canonical": """SELECT event_type AS source_id, CAST(user_id AS VARCHAR) AS event_id, arg_min(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), event_id) AS raw, count(*) AS copies, count(DISTINCT floor(value)) > 1 AS conflict FROM events GROUP BY event_type, user_id""",
    "i11_pq_windows": """WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) AS t, event_type = 'error' AS s FROM events WHERE event_type IN ('error', 'purchase')),
        bo AS (SELECT user_id, min(t) AS a, max(t) + 1 AS z FROM s GROUP BY user_id),
        l AS (SELECT *, lag(s) OVER w AS ps, lag(t) OVER w AS pt, lead(s) OVER w AS ns FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, s DESC)),
        ep AS (SELECT user_id, pt AS a, t AS b FROM l WHERE NOT s AND ps UNION ALL SELECT user_id, t, z FROM l JOIN bo USING (user_id) WHERE s AND (ns IS NULL OR ns)),
        x AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ep WHERE a < b),
        y AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < a THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM x),
        m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM y GROUP BY user_id, i),
        c AS (SELECT m.user_id, bin, least(m.b, (bin + 1) * 60000000) - greatest(m.a, bin * 60000000) AS us, least((bin + 1) * 60000000, z) - greatest(bin * 60000000, bo.a) AS len
              FROM (SELECT *, unnest(generate_series(a // 60000000, (b - 1) // 60000000)) AS bin FROM m) m JOIN bo USING (user_id)),
        n AS (SELECT user_id, sum(us / len) AS lost FROM c GROUP BY user_id)
        SELECT user_id AS perspective_id, (z - 1) // 60000000 - a // 60000000 + 1 AS minutes, round(100 - 100 * coalesce(lost, 0) / ((z - 1) // 60000000 - a // 60000000 + 1), 6) AS pq FROM bo LEFT JOIN n USING (user_id)""",
    "i8_incidents": """WITH e AS (SELECT DISTINCT user_id, ts, event_type = 'error' AS s FROM events WHERE event_type IN ('error', 'purchase')),
        l AS (SELECT *, lag(s) OVER w AS ps, lag(ts) OVER w AS pt, lead(s) OVER w AS ns FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, s DESC))
        SELECT 'closed' AS status, CASE WHEN ps THEN 'observed' ELSE 'unknown' END AS start_basis, count(*) AS episodes, round(sum(CASE WHEN ps THEN (epoch_us(ts) - epoch_us(pt)) / 1000 END), 3) AS duration_ms FROM l WHERE NOT s GROUP BY ALL
        UNION ALL SELECT 'open', 'observed', count(*), NULL FROM l WHERE s AND (ns IS NULL OR ns)""",
    "c1_legs": """WITH e AS (SELECT user_id, ts, event_id, event_type AS t FROM events WHERE event_type IN ('view', 'click', 'purchase')),
        g AS (SELECT *, sum(CASE WHEN t = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS leg FROM e),
        l AS (SELECT user_id, leg, bool_or(t = 'click') AS c, bool_or(t = 'purchase') AS p, max(leg) OVER (PARTITION BY user_id) AS last FROM g WHERE leg > 0 GROUP BY user_id, leg)
        SELECT NOT p AND leg < last AS incomplete, count(*) AS legs, count(*) FILTER (WHERE c) AS connected FROM l GROUP BY ALL""",
    "p1_search": "SELECT doc_id, source FROM documents WHERE contains(text, 'the and') AND lang = 'en'",
    "p2_search_calls": "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00001%'",
    "p6_sql_views": "SELECT c_nationkey AS nation, count(*) AS calls, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 GROUP BY c_nationkey",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        x1_split_records, x2_timestamps, x3_level_line, x5_rotation_duplicates, x8_extract_rtcp, x10_device_metrics, x11_periodic, x13_missing_packets, x14_positions,
        x16_network_obs, x17_connectivity, x18_transients, x26_validate, x27_decode_rtcp, s4_classify, s7_file_coverage, i8_incidents, i10_incident_windows, i11_pq_windows,
        i12_connectivity, i16_clock_guards, w6_movement, c1_legs, c3_calls, c8_dedup_within_gap, c9_mark_duplicates, c16_conversation_groups, c18_import_counts, r2_canonical,
        p1_search, p2_search_calls, p6_sql_views,
    )
}
