"""Queries of sources, record extraction, attribution and scalar functions, with DuckDB SQL for the same rows.

``events`` is rendered as log records, archives or telemetry lines by Spark; SQL tells from the
columns what has to come out, row by row where the rows are few enough to be compared.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calls as C
from ..operators import extract as X
from ..operators import joins as J
from ..sources import archives as A
from ..sources.staging import new_path
from . import listings as L
from .core_queries import HOUR, read
from .log_queries import rendered


# --- sources ------------------------------------------------------------------------------


def zipped(batch: pd.DataFrame) -> pd.DataFrame:
    """The documents of a group as the files of one archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, text in zip(batch["name"], batch["text"], strict=True):
            z.writestr(zipfile.ZipInfo(n), text)
    return pd.DataFrame([(f"a{batch['archive'].iloc[0]}", f"a{batch['archive'].iloc[0]}.zip", out.getvalue())], columns=["import_id", "archive", "content"])


def s1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in archives of about a hundred; every seventh file has a path that isn't safe."""
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 7 == 3, "../").otherwise("logs/"), F.col("doc_id"), F.lit(".log"))
    rows = docs.select(F.floor(F.col("doc_id") / 100).alias("archive"), name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.groupBy("archive").applyInPandas(zipped, "import_id string, archive string, content binary")
    return A.unpack(made).select("import_id", "name", "size", F.sha2("text", 256).alias("digest"), "warning")


def s2_log_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type as loose files of one import, read whole."""
    path = new_path(spark, "logs")
    e = read(spark, sf_dir, "events")
    e.select("event_type", F.concat_ws(" ", "event_id", "user_id").alias("value")).repartition("event_type").write.partitionBy("event_type").text(path)
    lines = A.read_log_dir(spark, path, "one").select("import_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select("import_id", F.split("line", " ")[0].cast("long").alias("event_id"))


def s3_new_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "orders").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("import_id"), "o_custkey")
    known = ids.where("o_custkey % 3 = 0")
    return A.new_imports_only(ids.groupBy("import_id").agg(F.count("*").alias("files")), known)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a user with a JSON line an event, every ninth of which is broken, and blank lines between."""
    e = read(spark, sf_dir, "events")
    body = F.format_string('{"event_id":"e%d","source_id":"%s","seq":%d,"mono_ms":%d.5,"payload":{"v":%d}}%s', "event_id", "event_type", "event_id", "user_id", "event_id", F.when(F.col("event_id") % 9 == 0, "x").otherwise(""))
    body = F.when(F.col("event_id") % 9 == 0, F.substring(body, 1, 20)).otherwise(body)
    one = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", body.alias("line")))).alias("l"))
    return one.select(F.lit("i").alias("import_id"), F.col("user_id").cast("string").alias("name"), F.array_join(F.col("l.line"), "\n\n").alias("text"))


def s6_telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read_telemetry_jsonl(_lines(spark, sf_dir)).select("name", "line_no", "event_id", "source_id", "seq", "mono_ms", "payload")


def s8_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read again: text that begins like a formula has a quote before it."""
    path = new_path(spark, "csv")
    e = read(spark, sf_dir, "events")
    sign = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "a")]), (F.col("event_id") % 5).cast("int") + 1)
    A.write_csv_safe(e.select("event_id", F.concat(sign, F.col("event_type")).alias("label")), path)
    return spark.read.option("header", "true").schema("event_id long, label string").csv(path)


def s9_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes of a customer's call, exported for one pattern and read again."""
    path = new_path(spark, "export")
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("string").alias("call_key"), F.col("o_orderpriority").alias("observer"), "o_orderkey")
    A.export_incidents(o, o, "3", "%URGENT%", path)
    return spark.read.json(f"{path}/windows_json").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "observer")


def s10_write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tables")
    e = read(spark, sf_dir, "events")
    A.write_tables({"events": e.select(F.col("event_type").alias("import_id"), "event_id", "value"), "nations": read(spark, sf_dir, "nation").select("n_nationkey")}, path)
    back = spark.read.parquet(f"{path}/events").groupBy("import_id").agg(F.count("*").alias("rows_"), F.max("event_id").alias("last"))
    return back.unionByName(spark.read.parquet(f"{path}/nations").agg(F.lit("nations").alias("import_id"), F.count("*").alias("rows_"), F.max("n_nationkey").cast("long").alias("last")))


# --- extraction ---------------------------------------------------------------------------

SIP = "%s SIP message:\n%s\nFrom: <sip:u%d@example.test>;tag=1\nTo: <sip:v%d@example.test>\nCall-ID: c%d\nCSeq: 1 INVITE\n%s\n\nbody Call-ID: no"


def _sip(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = "CASE WHEN event_id % 4 = 0 THEN 'SIP/2.0 200 OK' WHEN event_id % 4 = 1 THEN 'SIP/2.0 486 Busy Here' ELSE concat('INVITE sips:v', user_id, '@example.test SIP/2.0') END"
    extra = "CASE WHEN event_id % 3 = 0 THEN concat('X-Call-UUID: {', lpad(hex(user_id + 1), 8, '0'), '-0000-4000-8000-000000000001}') ELSE 'X-Other: 1' END"
    return rendered(spark, sf_dir, "sip_debug", "sip", SIP, "CASE WHEN event_id % 2 = 0 THEN 'INCOMING' ELSE 'OUTGOING' END", first, "user_id", "event_id % 10", "user_id", extra)


def x4_android_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "%s I/app text"
    r = rendered(spark, sf_dir, "app", "raw", form, "CASE WHEN event_id % 2 = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss:SSS') ELSE 'x' END")
    return X.android_timestamp(r.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))).select(F.col("line_no").alias("event_id"), "ts", "time_basis")


def x6_decode_sip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.decode_sip(_sip(spark, sf_dir)).select(F.col("line_no").alias("event_id"), "call_id", "method", "response", "caller", "callee", "direction")


def x21_call_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_call_uuid(X.decode_sip(_sip(spark, sf_dir))).select(F.col("line_no").alias("event_id"), "uuid")


def x21_leg_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "OUTGOING SIP message:\nCANCEL sip:v@example.test SIP/2.0\nCall-ID: c%d\nCSeq: 1 CANCEL\nReason: SIP;cause=%d;text=\"Call completed elsewhere\"\n\n"
    r = rendered(spark, sf_dir, "sip_debug", "sip", form, "user_id", "CASE WHEN event_id % 3 = 0 THEN 200 ELSE 487 END")
    return X.extract_leg_outcome(X.decode_sip(r)).select(F.col("line_no").alias("event_id"), "call_id", "outcome")


def x7_flow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = 'x call flow metric line %d {"incoming":{"jitter":{"rtp_pkt_lost":{"mean":"%d","max":"N/A"},"delay":{"mean":"%.2f"}}},"outgoing":{"jitter":{"delay":{"mean":"NaN","min":"-%d"}}}}'
    r = rendered(spark, sf_dir, "callinfo", "callinfo", form, "user_id", "event_id", "value", "1 + event_id % 7")
    return X.extract_flow_stats(r).select(F.col("line_no").alias("event_id"), "direction", "metric", "statistic", F.round("value", 2).alias("value"), "unit", "valid")


def x9_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir, "callinfo", "callinfo", "%s", "CASE WHEN event_id % 4 = 0 THEN 'time=1 ms' ELSE concat('received ', user_id, ' bytes from h: time=', event_id % 500, '.5 ms') END")
    return X.extract_ping(r).select(F.col("line_no").alias("event_id"), "metric", "value", "unit")


def x12_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "[t] [Default Audio Output] READING Virtual Output Device Running Info\nDevice name: Default Audio Output\nCurrently in total buffer underrun: %s\nCurrent processing stage: S%d(%d)\nLast written RTP SN: %d"
    r = rendered(spark, sf_dir, "vdlog", "vd", form, "CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END", "user_id % 3", "user_id % 3", "event_id")
    return X.extract_periodic_states(r).select(F.col("line_no").alias("event_id"), "metric", "value_json")


def x15_config_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = '[t] [KPECORE] [INFO] Adding extra headers to sip messages: {"extraHeaders":[{"headerName":"X-Location","values":[{"headerVal":"geo:%d.5,%d;u=1"},{"headerVal":"geo:%d.5,%d;u=2"}]}]}'
    r = rendered(spark, sf_dir, "kpelog", "kpe", form, "user_id % 100", "event_id % 200", "user_id % 100", "event_id % 200")
    return X.extract_config_positions(r).select(F.col("line_no").alias("event_id"), "latitude", "longitude", "kind", "valid")


def x19_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = "element_at(array('', ' from WI-FI to LTE', ' from lte to moon', ' because of you'), cast(event_id % 4 as int) + 1)"
    r = rendered(spark, sf_dir, "kpelog", "kpe", "[t] [KPECORE] [INFO] KPE was requested to handle a switchNetworkEvent%s", tail)
    return X.extract_network_switches(r).select(F.col("line_no").alias("event_id"), "previous", "next", "transition_basis")


def x20_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = """CASE event_id % 4 WHEN 0 THEN 'Buffer underrun occurred on input device NART0 of Line 2 .'
        WHEN 1 THEN concat('Still in buffer underrun on input device NART0 of Line 2 . Event is currently ', event_id, ' msecs long')
        WHEN 2 THEN concat('Line ', user_id % 5, ' reported that flow 1 has not received RTP media for more than ', user_id, ' seconds')
        ELSE concat('Line ', user_id % 5, ' reported that flow 1 has re-started receiving RTP media') END"""
    r = rendered(spark, sf_dir, "vdlog", "vd", "[t] [NART0 of Line 2] %s", said)
    return X.extract_incident_signals(r).select(F.col("line_no").alias("event_id"), "kind", "phase", "device", "line_id", "duration_ms")


def x22_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir, "phoneengine", "phone", "x app version: %d.%d", "user_id % 4", "event_id % 10")
    return X.extract_app_versions(r).select(F.col("line_no").alias("event_id"), "version", "app_name")


def x23_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by customer; the greatest order's lines are the ones that count."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string").alias("import_id")
    files = o.select(key, F.when(F.col("o_custkey") % 3 == 0, "kpe-android.log").when(F.col("o_custkey") % 3 == 1, "IOS_HWWrapper.log").otherwise("x.log").alias("name")).distinct()
    text = F.format_string("head\nDEVICE MODEL: m%d\nOS VERSION : %d", F.col("o_orderkey") % 10, F.col("o_orderkey") % 3)
    records = o.select(key, F.lit("a/info.log").alias("name"), F.lit("raw").alias("parser"), F.col("o_orderkey").alias("line_no"), F.lit(None).cast("timestamp_ntz").alias("ts"), text.alias("text"))
    return X.source_profile(files, records)


def x24_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of an import rendered from orders: an instance and a device an order's priority, a platform a customer."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    key = F.col("o_custkey").cast("string").alias("import_id")
    files = o.select(key, F.when(F.col("o_custkey") % 2 == 0, "kpe-android.log").otherwise("ios_hwwrapper.log").alias("name")).distinct()
    register = F.format_string("OUTGOING SIP message:\nREGISTER sip:example.test SIP/2.0\nContact: <sip:a>;+sip.instance=\"<urn:uuid:%08d-0000-4000-8000-000000000001>\"\n\n", F.col("p"))
    cti = F.format_string("[t] [CTILIB] [INFO] Sending auth to CTIServer - username: u - OS: %s - software: s - device ID: d%d - pre-shared key: k", F.when(F.col("o_custkey") % 10 == 0, "ios").when(F.col("o_custkey") % 2 == 0, "android").otherwise("ios"), F.col("o_custkey"))
    row = lambda name, text: o.select(key, F.lit(name).alias("name"), F.lit("raw").alias("parser"), F.col("o_orderkey").alias("line_no"), F.lit(None).cast("timestamp_ntz").alias("ts"), text.alias("text"))
    return X.producer_identity(X.identity_markers(files, row("sip_debug.log", register).unionByName(row("ctilib.log", cti)))).select("import_id", "status", F.col("producer").isNotNull().alias("known"))


def x25_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sip = X.decode_sip(_sip(spark, sf_dir))
    return X.identity_candidates(sip, 2).select("import_id", "account", "occurrences", F.size("proofs").alias("proofs"))


# --- attribution --------------------------------------------------------------------------


def c2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of users from INVITE and REFER exchanges rendered from events."""
    e = read(spark, sf_dir, "events")
    method = F.when(F.col("event_type") == "signup", "REFER").when(F.col("event_type") == "purchase", "BYE").otherwise("INVITE")
    response = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "error", 486).when(F.col("event_type") == "signup", 503).when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), 407)
    call = F.concat(F.lit("c"), "user_id", F.lit("d"), F.dayofmonth("ts"))
    sip = e.select(F.lit("i").alias("import_id"), call.alias("call_id"), "ts", F.col("event_id").alias("ord"), method.alias("method"), response.alias("response"), F.when(F.col("event_id") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), F.col("event_id").cast("string").alias("caller"), F.lit("x").alias("callee"))
    legs = C.sip_only_legs(sip, spark.createDataFrame([], "import_id string, call_id string")).withColumns({"connected": F.lit(None).cast("timestamp_ntz"), "end": F.lit(None).cast("timestamp_ntz"), "line_id": F.lit(None).cast("int"), "incomplete": F.lit(None).cast("boolean")})
    return C.build_perspectives(legs, sip).select("call_id", "start", "connected", "end", "direction", "caller", "status")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as calls of two hours on the user's line."""
    e = read(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(F.lit("i").alias("import_id"), F.col("user_id").cast("int").alias("line_id"), F.concat(F.lit("c"), "event_id").alias("call_id"), F.col("event_id").alias("perspective_id"), F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(2), F.col("ts")).alias("end"))


def c4_attribute_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that name a call (that of their own id) go to it, others to the only call of their line then."""
    e = read(spark, sf_dir, "events")
    named = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("c"), "event_id"))
    rows = e.select(F.lit("i").alias("import_id"), F.col("user_id").cast("int").alias("line_id"), named.alias("call_id"), "event_id", "ts")
    return C.attribute_events(rows, _calls(spark, sf_dir)).select("event_id", "owner")


def c5_attribute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = read(spark, sf_dir, "events").where("event_type = 'click'").select(F.lit("i").alias("import_id"), F.col("user_id").cast("int").alias("line_id"), "event_id", "ts", "value")
    return J.unique_window(metrics, _calls(spark, sf_dir), ["import_id", "line_id"], ["perspective_id"], "event_id").where("perspective_id IS NOT NULL").select("event_id", "value", "perspective_id")


def c6_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the latest error of their user, and of the user after it, as creations of devices."""
    e = read(spark, sf_dir, "events")
    rows = e.where("event_type = 'click'").select(F.lit("i").alias("import_id"), "event_id", "ts", F.col("user_id").cast("string").alias("output_device"), (F.col("user_id") + 1).cast("string").alias("input_device"))
    made = e.where("event_type = 'error'").select(F.lit("i").alias("import_id"), F.col("user_id").cast("string").alias("device"), "ts", F.col("event_id"))
    return L.tag_lifecycle(rows, made).select("event_id", "output_device_created", "input_device_created")


def c7_dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", F.floor("value").alias("value"), "event_id", "user_id")
    return C.dedup_metrics(rows, ["event_type", "value"], ["event_id"]).select("event_type", "value", "event_id", "user_id")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' calls in five imports of two producers."""
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 5).alias("import_seq"), F.concat(F.lit("i"), F.col("o_orderkey") % 5).alias("import_id"), F.col("o_custkey").alias("call_id"), F.concat(F.lit("p"), F.col("o_orderkey") % 5 % 2).alias("producer")).distinct()


def c10_effective_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _imports(spark, sf_dir)
    producers = p.select("import_id", F.lit("resolved").alias("status"), "producer").distinct()
    roles = p.select("import_id", F.when(F.col("import_seq") == 2, "gw").otherwise("app").alias("role")).distinct()
    return C.mark_duplicates(p.drop("producer"), producers, roles).select("import_id", "call_id", "duplicate_of")


def c11_known_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _imports(spark, sf_dir)
    return C.skip_known_calls(p.where("import_seq >= 3"), p.where("import_seq < 3")).select("import_id", "call_id")


def c12_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _calls(spark, sf_dir).withColumn("end", F.when(F.col("perspective_id") % 2 == 0, F.col("end")))
    seen = read(spark, sf_dir, "events").where("event_type <> 'view' AND user_id % 3 > 0").select(F.col("user_id").cast("int").alias("line_id"), "ts")
    return C.bound_open_windows(w, seen, ["line_id"]).select("perspective_id", "end", "end_basis")


def c13_manual_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'click'")
    rows = e.select(F.lit("i").alias("import_id"), F.col("user_id").cast("int").alias("line_id"), "event_id", "ts", F.when(F.col("event_id") % 4 == 0, F.lit(-1)).cast("long").alias("owner"))
    given = _calls(spark, sf_dir).withColumnRenamed("perspective_id", "window_id")
    return C.assign_manual_windows(rows, given, "event_id").select("event_id", "owner")


def c14_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as block notices; a click right before one in the user's file, within an hour, is its request."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "click", "request").otherwise("other")
    rows = e.select(F.lit("i").alias("import_id"), F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("line_no"), "ts", kind.alias("kind"), F.concat(F.lit("t"), "event_id").alias("target"))
    return C.pair_attempts(rows, HOUR).select("line_no", "paired", "target")


def c15_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th attempt of a user at a target (an event type) in each of three imports; the newest import's stays."""
    from ..operators.windows import copy_ranking

    e = read(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("import_seq"), "user_id", F.col("event_type").alias("target"), "ts", "event_id")
    return copy_ranking(e, ["user_id", "target"], "import_seq", ["ts", "event_id"]).select("event_id", "occurrence", "copies")


def c17_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _imports(spark, sf_dir).select("import_id", F.concat_ws(":", "import_id", "call_id").alias("perspective_id"), "call_id")
    roles = p.where("call_id % 3 = 0").select("perspective_id", F.concat(F.lit("n"), "call_id").alias("participant"))
    ids = p.select("import_id").distinct()
    accounts = ids.where("import_id < 'i2'").select("import_id", F.concat(F.lit("acc"), "import_id").alias("account"))
    producers = ids.select("import_id", F.when(F.col("import_id") == "i3", "resolved").otherwise("unknown").alias("status"), F.lit("P").alias("producer"))
    return C.local_receiver(p, roles, accounts, producers).select("perspective_id", "receiver", "receiver_basis")


def c19_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of the calls that overlap ten days and aren't duplicates."""
    calls = _calls(spark, sf_dir).withColumn("duplicate_of", F.when(F.col("perspective_id") % 4 == 0, "i"))
    at = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    metrics = c5_attribute_metrics(spark, sf_dir)
    return C.scope({"perspectives": calls, "metrics": metrics}, None, at("10"), at("20"))["metrics"].select("event_id", "perspective_id")


# --- functions ----------------------------------------------------------------------------


def f3_grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's place lies in the bounds of its own cell; text that is no cell has none."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 170 - 85 + 0.25).alias("lat"), (F.col("value") % 360 - 180).alias("lon"))
    e = e.withColumn("cell", F.when(F.col("event_id") % 10 == 0, "1:x").otherwise(S.grid_cell("lat", "lon", 200.0))).withColumn("b", S.grid_bounds("cell", 200.0))
    inside = F.col("lat").between(F.col("b.south"), F.col("b.north")) & F.col("lon").between(F.col("b.west") - 1e-9, F.col("b.east") + 1e-9)
    return e.select("event_id", inside.alias("inside"), F.round("b.south", 6).alias("south"), F.round("b.west", 4).alias("west"))


def f6_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(x) for x in ("usecs", "Msecs", " s ", "hours")]), (F.col("event_id") % 4).cast("int") + 1)
    return read(spark, sf_dir, "events").select("event_id", F.round(S.duration_ms("value", unit), 5).alias("ms"))


def f7_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("event_id") % 3 == 0, F.format_string("%ds%dh", F.col("event_id"), F.col("user_id"))).when(F.col("event_id") % 3 == 1, F.format_string("+%dd%dms", F.col("user_id"), F.col("event_id"))).otherwise("1x")
    return read(spark, sf_dir, "events").select("event_id", F.round(S.elapsed_seconds(form), 3).alias("seconds"))


def f8_network_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("WI-FI", " lte ", "Ethernet", "moon")]), (F.col("event_id") % 4).cast("int") + 1)
    return read(spark, sf_dir, "events").select("event_id", S.network_state(name).alias("state"))


def f9_series_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys tell identities apart, and nulls from empty texts: a key has one identity and the other way round."""
    e = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, F.lit("")).alias("ssrc"))
    keyed = e.withColumn("key", S.series_key("user_id", "ssrc")).groupBy("user_id", "ssrc").agg(F.count_distinct("key").alias("keys"), F.first("key").alias("key"), F.count("*").alias("rows_"))
    own = keyed.groupBy("key").agg(F.count("*").alias("identities"))
    return keyed.join(own, "key").select("user_id", F.col("ssrc").isNull().alias("missing"), "keys", "identities", F.length("key").alias("digits"), "rows_")


def f10_metric_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and orientation of names made of events."""
    names = ("vd.buffer", "vd.cycles_read", "rtcp.loss", "network.ping", "vd.packets_all", "mos.x", "vd.media_read", "kpe.jitter.delay", "rtcp.rtt", "vd.max_arrival_delay", "vd.silence_skipped", "derived.mos_reference")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names)).cast("int") + 1)
    return read(spark, sf_dir, "events").select("event_id", S.metric_domain(name).alias("domain"), S.metric_orientation(name).alias("rule"))


def f11_unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(x) for x in ("%", "ms", "furlongs")]), (F.col("event_id") % 3).cast("int") + 1)
    return read(spark, sf_dir, "events").select("event_id", S.unit_label(unit).alias("label"))


def f13_clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("event_id") * 13.5 - 40_000
    return read(spark, sf_dir, "events").select("event_id", S.apply_clock_offset("ts", seconds).alias("shown"))


def f15_text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    line = F.concat(F.lit("head "), F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise(""), F.lit(" tail"))
    return e.select("event_id", F.get_json_object(S.first_json(line), "$.k").cast("long").alias("k"), S.csv_safe(F.concat(F.when(F.col("event_id") % 2 == 0, "=").otherwise("a"), F.col("event_type"))).alias("label"))


# --- search -------------------------------------------------------------------------------


def p1_search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.parse_level_line(rendered(spark, sf_dir, "core", "kpe", "[t] [CORE] [%s] Event %s of line %d", "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END", "event_type", "user_id"))
    at = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    return L.search_events(r, "event ERR", {"import_id": "u3", "parser": "kpe"}, at("05"), at("25"), 4).select("name", "line_no", "ts")


def p2_search_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search_calls(read(spark, sf_dir, "customer"), "CUSTOMER#00000001", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


SQL_E = "e AS (SELECT * FROM events)"
SQL_CALLS = "c AS (SELECT event_id AS pid, user_id AS u, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'view')"
SQL_UNIQUE = f"{SQL_CALLS}, m AS (SELECT e.event_id, any_value(c.pid) AS pid FROM events e JOIN c ON c.u = e.user_id AND e.ts >= c.a AND e.ts <= c.b + INTERVAL 250 MILLISECOND GROUP BY e.event_id HAVING count(*) = 1)"
SQL_IMPORTS = "p AS (SELECT DISTINCT o_orderkey % 5 AS i, o_custkey AS c FROM orders)"

ORACLE: dict[str, str] = {
    "s1_archives": """SELECT 'a' || doc_id // 100 AS import_id, CASE WHEN doc_id % 7 = 3 THEN '../' ELSE 'logs/' END || doc_id || '.log' AS name, octet_length(encode(coalesce(text, ''))) AS size,
        CASE WHEN doc_id % 7 <> 3 THEN sha256(coalesce(text, '')) END AS digest, CASE WHEN doc_id % 7 = 3 THEN 'unsafe path' END AS warning FROM documents""",
    "s2_log_dir": "SELECT 'one' AS import_id, event_id FROM events",
    "s3_new_imports": "SELECT sha256(CAST(o_custkey AS VARCHAR)) AS import_id, count(*) AS files FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey",
    "s6_telemetry_lines": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
        SELECT CAST(user_id AS VARCHAR) AS name, CAST(2 * n - 1 AS INT) AS line_no, CASE WHEN event_id % 9 > 0 THEN 'e' || event_id END AS event_id, CASE WHEN event_id % 9 > 0 THEN event_type END AS source_id,
        CASE WHEN event_id % 9 > 0 THEN event_id END AS seq, CASE WHEN event_id % 9 > 0 THEN user_id + 0.5::DOUBLE END AS mono_ms, CASE WHEN event_id % 9 > 0 THEN '{"v":' || event_id || '}' END AS payload FROM l""",
    "s8_csv_safe": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '''=' WHEN 1 THEN '''+' WHEN 2 THEN '''-' WHEN 3 THEN '''@' ELSE 'a' END || event_type AS label FROM events",
    "s9_export": "SELECT o_orderkey, o_orderpriority AS observer FROM orders WHERE o_custkey % 5 = 3 AND o_orderpriority LIKE '%URGENT%'",
    "s10_write_tables": "SELECT event_type AS import_id, count(*) AS rows_, max(event_id) AS last FROM events GROUP BY event_type UNION ALL SELECT 'nations', count(*), CAST(max(n_nationkey) AS BIGINT) FROM nation",
    "x4_android_time": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('milliseconds', ts) ELSE date_trunc('second', ts) END AS ts, CASE WHEN event_id % 2 = 0 THEN 'log_android_milliseconds' ELSE 'event_timestamp' END AS time_basis FROM events",
    "x6_decode_sip": """SELECT event_id, 'c' || user_id AS call_id, 'INVITE' AS method, CAST(CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 486 END AS INT) AS response, 'u' || user_id || '@example.test' AS caller,
        'v' || event_id % 10 || '@example.test' AS callee, CASE WHEN event_id % 2 = 0 THEN 'incoming' ELSE 'outgoing' END AS direction FROM events""",
    "x21_call_uuid": "SELECT event_id, lower(lpad(printf('%X', user_id + 1), 8, '0')) || '-0000-4000-8000-000000000001' AS uuid FROM events WHERE event_id % 3 = 0 AND event_id % 4 >= 2",
    "x21_leg_outcome": "SELECT event_id, 'c' || user_id AS call_id, 'answered_elsewhere' AS outcome FROM events WHERE event_id % 3 = 0",
    "x7_flow_stats": """SELECT event_id, 'incoming' AS direction, 'kpe.jitter.rtp_pkt_lost' AS metric, 'mean' AS statistic, event_id::DOUBLE AS value, 'packets' AS unit, true AS valid FROM events
        UNION ALL SELECT event_id, 'incoming', 'kpe.jitter.delay', 'mean', round(value, 2), 'raw', true FROM events
        UNION ALL SELECT event_id, 'outgoing', 'kpe.jitter.delay', 'min', -(1 + event_id % 7)::DOUBLE, 'raw', false FROM events""",
    "x9_ping": "SELECT event_id, 'network.ping' AS metric, event_id % 500 + 0.5::DOUBLE AS value, 'ms' AS unit FROM events WHERE event_id % 4 > 0",
    "x12_states": """SELECT event_id, 'vd.currently_in_total_buffer_underrun' AS metric, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS value_json FROM events
        UNION ALL SELECT event_id, 'vd.current_processing_stage', '{"state":"S' || user_id % 3 || '","code":' || user_id % 3 || '}' FROM events
        UNION ALL SELECT event_id, 'vd.last_written_rtp_sn', CAST(event_id AS VARCHAR) FROM events""",
    "x15_config_positions": "SELECT event_id, user_id % 100 + 0.5::DOUBLE AS latitude, (event_id % 200)::DOUBLE AS longitude, 'config' AS kind, user_id % 100 < 90 AND event_id % 200 <= 180 AS valid FROM events",
    "x19_switches": """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'wifi' WHEN 2 THEN 'lte' END AS previous, CASE event_id % 4 WHEN 1 THEN 'lte' END AS next,
        CASE event_id % 4 WHEN 1 THEN 'explicit_fields' ELSE 'not_reported' END AS transition_basis FROM events WHERE event_id % 4 < 3""",
    "x20_signals": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'buffer_underrun' ELSE 'media_missing' END AS kind, CASE event_id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'ongoing' WHEN 2 THEN 'missing' ELSE 'end' END AS phase,
        CASE WHEN event_id % 4 < 2 THEN 'NART0 of Line 2' ELSE 'Line ' || user_id % 5 END AS device, CAST(CASE WHEN event_id % 4 < 2 THEN 2 ELSE user_id % 5 END AS INT) AS line_id,
        CASE event_id % 4 WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN user_id * 1000.0::DOUBLE END AS duration_ms FROM events""",
    "x22_versions": "SELECT event_id, user_id % 4 || '.' || event_id % 10 AS version, user_id % 4 || '.' || event_id % 10 AS app_name FROM events",
    "x23_profile": """WITH l AS (SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)
        SELECT CAST(c AS VARCHAR) AS import_id, CASE c % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'unknown' END AS platform, 'm' || k % 10 AS model, CAST(k % 3 AS VARCHAR) AS os_version, CAST(NULL AS VARCHAR) AS app_version FROM l""",
    "x24_producers": """WITH n AS (SELECT o_custkey AS c, count(DISTINCT substr(o_orderpriority, 1, 1)) AS n FROM orders GROUP BY o_custkey)
        SELECT CAST(c AS VARCHAR) AS import_id, CASE WHEN n = 1 AND c % 10 <> 0 THEN 'resolved' ELSE 'ambiguous' END AS status, n = 1 AND c % 10 <> 0 AS known FROM n""",
    "x25_identities": """WITH s AS (SELECT 'u' || user_id % 7 AS import_id, CASE WHEN event_id % 2 = 1 THEN 'u' || user_id ELSE 'v' || event_id % 10 END || '@example.test' AS account FROM events WHERE event_id % 4 >= 2)
        SELECT import_id, account, count(*) AS occurrences, CAST(least(count(*), 2) AS INT) AS proofs FROM s GROUP BY ALL""",
    "c2_perspectives": """WITH s AS (SELECT 'c' || user_id || 'd' || day(ts) AS call_id, ts, event_id, event_type AS t FROM events WHERE true),
        g AS (SELECT call_id, min(ts) AS start, min(ts) FILTER (WHERE t = 'view') AS ok, max(ts) FILTER (WHERE t = 'purchase') AS bye, max(ts) FILTER (WHERE t = 'error') AS failed,
              arg_min(event_id, ts) FILTER (WHERE t = 'click' AND event_id % 3 <> 0) AS f FROM s GROUP BY call_id)
        SELECT call_id, start, ok AS connected, coalesce(bye, CASE WHEN ok IS NULL THEN failed END) AS "end", CASE WHEN f % 2 = 0 THEN 'incoming' WHEN f % 2 = 1 THEN 'outgoing' END AS direction, CAST(f AS VARCHAR) AS caller,
        CASE WHEN ok IS NOT NULL AND bye IS NOT NULL THEN 'completed' WHEN ok IS NOT NULL THEN 'connected / partial' WHEN failed IS NOT NULL THEN 'failed' ELSE 'partial' END AS status FROM g""",
    "c4_attribute_events": f"""WITH {SQL_UNIQUE}
        SELECT e.event_id, coalesce(CASE WHEN e.event_id % 5 = 0 THEN c.pid END, m.pid) AS owner FROM events e LEFT JOIN c ON c.pid = e.event_id LEFT JOIN m ON m.event_id = e.event_id""",
    "c5_attribute_metrics": f"WITH {SQL_UNIQUE} SELECT e.event_id, e.value, m.pid AS perspective_id FROM events e JOIN m USING (event_id) WHERE e.event_type = 'click'",
    "c6_lifecycle": """WITH r AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error')
        SELECT e.event_id, (SELECT arg_max(r.event_id, r.ts) FROM r WHERE r.user_id = e.user_id AND r.ts <= e.ts) AS output_device_created,
               (SELECT arg_max(r.event_id, r.ts) FROM r WHERE r.user_id = e.user_id + 1 AND r.ts <= e.ts) AS input_device_created FROM events e WHERE e.event_type = 'click'""",
    "c7_dedup_metrics": "SELECT event_type, CAST(floor(value) AS BIGINT) AS value, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events GROUP BY event_type, floor(value)",
    "c10_effective_duplicates": f"""WITH {SQL_IMPORTS}, f AS (SELECT *, min(i) OVER (PARTITION BY i % 2, c) AS first FROM p)
        SELECT 'i' || i AS import_id, c AS call_id, CASE WHEN first <> i AND NOT ((i = 2) <> (first = 2)) THEN 'i' || first END AS duplicate_of FROM f""",
    "c11_known_calls": f"WITH {SQL_IMPORTS} SELECT 'i' || i AS import_id, c AS call_id FROM p WHERE i >= 3 AND NOT EXISTS (SELECT 1 FROM p k WHERE k.i < 3 AND k.i % 2 = p.i % 2 AND k.c = p.c)",
    "c12_open_windows": f"""WITH {SQL_CALLS}, l AS (SELECT user_id AS u, max(ts) AS t FROM events WHERE event_type <> 'view' AND user_id % 3 > 0 GROUP BY user_id)
        SELECT pid AS perspective_id, CASE WHEN pid % 2 = 0 THEN b ELSE t + INTERVAL 1 MICROSECOND END AS "end", CASE WHEN pid % 2 = 0 THEN 'observed_termination' WHEN t IS NOT NULL THEN 'last_call_evidence' END AS end_basis FROM c LEFT JOIN l USING (u)""",
    "c13_manual_windows": f"""WITH {SQL_UNIQUE.replace(" + INTERVAL 250 MILLISECOND", "")}
        SELECT e.event_id, CASE WHEN e.event_id % 4 = 0 THEN -1 ELSE m.pid END AS owner FROM events e LEFT JOIN m USING (event_id) WHERE e.event_type = 'click'""",
    "c14_attempts": """WITH l AS (SELECT *, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        d AS (SELECT *, coalesce(pt = 'click' AND epoch_us(ts) - epoch_us(pts) BETWEEN 0 AND 3600000000, false) AS paired FROM l WHERE event_type = 'error')
        SELECT event_id AS line_no, paired, 't' || CASE WHEN paired THEN pid ELSE event_id END AS target FROM d""",
    "c15_copies": """WITH n AS (SELECT event_id % 3 AS i, user_id, event_type, event_id, row_number() OVER (PARTITION BY event_id % 3, user_id, event_type ORDER BY ts, event_id) AS occurrence FROM events),
        r AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, occurrence) AS copies, row_number() OVER (PARTITION BY user_id, event_type, occurrence ORDER BY i DESC) AS rank FROM n)
        SELECT event_id, CAST(occurrence AS INT) AS occurrence, copies FROM r WHERE rank = 1""",
    "c17_receivers": f"""WITH {SQL_IMPORTS} SELECT 'i' || i || ':' || c AS perspective_id, CASE WHEN c % 3 = 0 THEN 'n' || c WHEN i < 2 THEN 'acci' || i WHEN i = 3 THEN 'P' ELSE 'i' || i END AS receiver,
        CASE WHEN c % 3 = 0 THEN 'participant' WHEN i < 2 THEN 'account' WHEN i = 3 THEN 'producer' ELSE 'import' END AS receiver_basis FROM p""",
    "c19_scope": f"""WITH {SQL_UNIQUE} SELECT e.event_id, m.pid AS perspective_id FROM events e JOIN m USING (event_id) JOIN c ON c.pid = m.pid
        WHERE e.event_type = 'click' AND m.pid % 4 <> 0 AND c.b > TIMESTAMP '2024-01-10' AND c.a < TIMESTAMP '2024-01-20'""",
    "f3_grid_bounds": """WITH e AS (SELECT event_id, user_id % 170 - 85 + 0.25::DOUBLE AS lat, value % 360 - 180 AS lon, 200 / 111195.08::DOUBLE AS step FROM events),
        b AS (SELECT *, floor(lat / step) AS band, step / cos(radians(greatest(least((floor(lat / step) + 0.5) * step, 89.9), -89.9))) AS width FROM e)
        SELECT event_id, CASE WHEN event_id % 10 > 0 THEN true END AS inside, CASE WHEN event_id % 10 > 0 THEN round(band * step, 6) END AS south, CASE WHEN event_id % 10 > 0 THEN round(floor(lon / width) * width, 4) END AS west FROM b""",
    "f6_durations": "SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value * 0.001::DOUBLE WHEN 1 THEN value WHEN 2 THEN value * 1000 END, 5) AS ms FROM events",
    "f7_elapsed": "SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN event_id + user_id * 3600.0::DOUBLE WHEN 1 THEN user_id * 86400.0::DOUBLE + event_id * 0.001::DOUBLE END, 3) AS seconds FROM events",
    "f8_network_state": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'wifi' WHEN 1 THEN 'cellular' WHEN 2 THEN 'ethernet' END AS state FROM events",
    "f9_series_key": "SELECT user_id, event_id % 2 <> 0 AS missing, CAST(1 AS BIGINT) AS keys, CAST(1 AS BIGINT) AS identities, CAST(24 AS INT) AS digits, count(*) AS rows_ FROM events GROUP BY ALL",
    "f10_metric_domains": """WITH n AS (SELECT event_id, CAST(event_id % 12 AS INT) + 1 AS i FROM events)
        SELECT event_id, ['buffer_media', 'scheduling', 'rtp_transport', 'network_probe', 'rtp_transport', 'quality_model', 'processing', 'unspecified', 'rtp_transport', 'rtp_transport', 'buffer_media', 'quality_model'][i] AS domain,
        ['device', 'device', 'receiver_report', 'probe', 'device', 'unconfirmed', 'device', 'unconfirmed', 'roundtrip', 'rtp_receive', 'device', 'model'][i] AS rule FROM n""",
    "f11_unit_labels": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'milliseconds' ELSE 'furlongs' END AS label FROM events",
    "f13_clock_offset": "SELECT event_id, CASE WHEN abs(event_id * 13.5 - 40000) <= 86400 THEN ts + to_microseconds(CAST(round((event_id * 13.5 - 40000) * 1000000) AS BIGINT)) ELSE ts END AS shown FROM events",
    "f15_text_helpers": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 2 = 0 THEN '''=' ELSE 'a' END || event_type AS label FROM events",
    "p1_search_events": "SELECT 'core' || user_id AS name, event_id AS line_no, ts FROM events WHERE event_type = 'error' AND user_id % 7 = 3 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'",
    "p2_search_parties": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#00000001') OR contains(lower(c_mktsegment), 'customer#00000001')",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE}
