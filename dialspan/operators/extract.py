"""Records of text logs, and what they say, as rows.

All extraction is built-in expressions over records: cheap ``contains`` filters first, then
patterns from the tables of fixed values below. Columns of a record: import_id, name (file),
parser, line_no, ts, text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import duration_ms, metric_valid
from ..sources.archives import base_name
from . import messages as M
from .messages import parse_timestamp

#: A run of characters that a number has; a cast decides.
NUMBER = r"[-+]?[.\d]+(?:[eE][-+]?\d+)?"
# The words for levels.
LEVELS = ("DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "FATAL")
#: What stands for a value in a sentence: digits, a number, a word in capitals, a unit, true or false, text to keep; digits and text to skip.
HOLES = {"{d}": r"(\d+)", "{n}": f"({NUMBER})", "{W}": "([A-Z_]+)", "{u}": "([A-Za-z]+)", "{b}": "((?i:true|false))", "{*}": "(.*?)", "{#}": r"\d+", "{..}": ".*?"}


def literal(text: str) -> str:
    return "".join(f"\\{c}" if c in r".^$*+?{}[]\|()-" else c for c in text)


def sentence(text: str) -> str:
    """The pattern of a log's sentence: its words as they are, and its holes, with any space around those."""
    parts = re.split(r" ?(\{(?:[dnWub*#]|\.\.)\}) ?", text)
    return "".join(literal(x) if i % 2 == 0 else rf"\s*{HOLES[x]}\s*" for i, x in enumerate(parts))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; NULL where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def split_records(files: DataFrame, start: Column | None = None) -> DataFrame:
    """Records of files (import_id, name, text): a line with a time begins one, other lines continue it.

    ``start`` may say otherwise of ``line``. Lines before the first time are a record without one.
    The windows are per file, never per import.
    """
    text = F.regexp_replace(F.regexp_replace("text", r"\r+\n", "\n"), "\r", "\n")
    keys = [c for c in files.columns if c != "text"]
    lines = files.select(*keys, F.posexplode(F.split(F.regexp_replace(text, r"\n$", ""), "\n")).alias("n", "line"))
    lines = lines.withColumn("ts", parse_timestamp("line"))
    begins = start if start is not None else F.col("ts").isNotNull()
    by = Window.partitionBy(*keys).orderBy("n")
    lines = lines.withColumn("record", F.sum(F.when(begins, 1).otherwise(0)).over(by))
    rows = lines.groupBy(*keys, "record").agg(F.min("n").alias("n"), F.min_by("ts", "n").alias("ts"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    return rows.select(*keys, (F.col("n") + 1).alias("line_no"), "ts", F.array_join(F.col("l.line"), "\n").alias("text"))


def first_line(text: Column | str = "text") -> Column:
    return F.substring_index(F.col(text) if isinstance(text, str) else text, "\n", 1)


def parse_level_line(df: DataFrame) -> DataFrame:
    """``df`` with level and line_id of the first line."""
    h = first_line()
    level = F.upper(group(h, rf"(?i)\[({'|'.join(LEVELS)})\]"))
    forms = [sentence(x) for x in ("lineId [{d}", "lineId[{d}", "lineId {d}", "line id:{d}", "line ({d}", "line({d}")]
    line = F.coalesce(*[group(h, f"(?i){f}") for f in forms], group(h, r"(?i)\bline\s+(\d+)"))
    return df.withColumns({"level": level, "line_id": line.cast("int")})


def android_timestamp(df: DataFrame) -> DataFrame:
    """A stamp with milliseconds after a colon is the time; ``time_basis`` says which one it was."""
    at = M.millisecond_stamp(F.col("text"))
    return df.withColumns({"time_basis": F.when(at.isNotNull(), "log_android_milliseconds").otherwise("event_timestamp"), "ts": F.coalesce(at, "ts")})


def flag_rotation_duplicates(records: DataFrame) -> DataFrame:
    """``records`` with ``duplicate``: the same parser, time and text stood earlier in the import. Nothing is dropped."""
    by = Window.partitionBy("import_id", "parser", "ts", F.sha2("text", 256)).orderBy("name", "line_no")
    return records.withColumn("duplicate", F.row_number().over(by) > 1)


# --- SIP ---------------------------------------------------------------------------------


def decode_sip(records: DataFrame) -> DataFrame:
    """SIP messages of records: call_id, method, response, title, caller, callee, direction."""
    rows = M.with_headers(records.where(F.col("text").contains("SIP message:")))
    rows = rows.withColumns({"call_id": M.word(M.header("call-id", "i")), "method": F.upper(M.word(M.header("cseq"), 1)), "title": F.col("_title")})
    rows = rows.where("call_id IS NOT NULL AND method IS NOT NULL AND title IS NOT NULL")
    rows = rows.withColumns({
        "response": M.response_code(F.col("title")),
        "caller": M.identity(F.coalesce(M.header("from"), F.lit(""))),
        "callee": M.identity(F.coalesce(M.header("to"), F.lit(""))),
        "direction": F.when(F.col("text").contains("INCOMING SIP"), "incoming").otherwise("outgoing"),
    })
    return rows.drop("_title", "_headers")


def extract_call_uuid(sip: DataFrame) -> DataFrame:
    """UUIDs (not nil) of initial INVITE requests."""
    rows = M.with_headers(sip.where((F.col("method") == "INVITE") & F.col("response").isNull()))
    rows = rows.withColumn("uuid", F.lower(F.btrim(M.header("x-call-uuid"), F.lit("{}"))))
    return rows.where(M.is_uuid(F.col("uuid"))).drop("_title", "_headers")


def extract_leg_outcome(sip: DataFrame) -> DataFrame:
    """CANCEL requests that say the call was completed elsewhere (RFC 3326: cause 200)."""
    rows = M.with_headers(sip.where((F.col("method") == "CANCEL") & F.col("response").isNull()))
    reason = M.header("reason")
    elsewhere = F.array_contains(M.parameters(reason), "cause=200") & F.lower(reason).contains("call completed elsewhere")
    return rows.where(elsewhere).drop("_title", "_headers").withColumn("outcome", F.lit("answered_elsewhere"))


# --- metrics -----------------------------------------------------------------------------

# Fixed values: (name, label before the value, text after it, unit, direction) of RTCP fields.
RTCP_FIELDS = [
    ("rtcp.loss", "Packet loss we perceive from this source (since last report)", "%", "%", "incoming"),
    ("rtcp.jitter", "Jitter we perceive from this source (since last report)", " ms", "ms", "incoming"),
    ("rtcp.rtt", "RTT to this source", " ms", "ms", "roundtrip"),
    ("rtcp.loss", "Receiver Report - remote peer pkt loss (since last RR)", "%", "%", "outgoing"),
    ("rtcp.jitter", "Receiver Report - jitter perceived by this remote peer(since last report)", " ms", "ms", "outgoing"),
    ("rtcp.packets_received", "Packet we received from this source (total)", "", "packets", "incoming"),
    ("rtcp.packets_sent_total", "Sender Report - Number of packets sent by this remote peer (total)", "", "packets", "incoming"),
    ("rtcp.packets_sent_interval", "Sender Report - Number of packets sent by this remote peer (since last report)", "", "packets", "incoming"),
    ("rtcp.packets_received_interval", "Packet we received from this source (since last report)", "", "packets", "incoming"),
    ("rtcp.packets_lost_total", "Receiver Report - pkt lost by this peer (total)", "", "packets", "outgoing"),
    ("rtcp.packets_lost_interval", "Receiver Report - pkt lost by this peer (since last report)", "", "packets", "outgoing"),
]


def with_fields(rows: DataFrame, values: list[tuple[Column, dict[str, str]]], name: str = "value") -> DataFrame:
    """A row for each value that is there, with the constants that belong to it."""
    made = [F.struct(v.try_cast("double").alias(name), *[F.lit(x).alias(k) for k, x in consts.items()]) for v, consts in values]
    out = rows.withColumn("_f", F.explode(F.filter(F.array(*made), lambda f: f[name].isNotNull() & ~F.isnan(f[name]) & (F.abs(f[name]) != float("inf")))))
    return out.select(*[c for c in rows.columns], "_f.*")


def extract_rtcp(records: DataFrame) -> DataFrame:
    """Labelled fields of RTCP blocks with flow, ssrc and validity."""
    rows = records.where((F.col("parser") == "rtcp") & F.col("text").contains("RTCP ARRIVED"))
    text = F.col("text")
    values = [(group(text, literal(label) + rf":\s*({NUMBER})" + (literal(after) if after else r"(?![\w]|\.\d)")), {"metric": n, "unit": unit, "direction": way, "statistic": "sample"}) for n, label, after, unit, way in RTCP_FIELDS]
    out = with_fields(rows, values)
    return out.withColumns({"flow": F.coalesce(group(F.col("text"), r"FLOW\s+(\d+)"), F.lit("?")), "ssrc": F.coalesce(group(F.col("text"), r"SSRC of this source:\s*(\w+)"), F.lit("")), "valid": metric_valid("value", "unit")}).drop("text")


# The answer to a probe.
PING = sentence("received {d} bytes {..}time={n} ms")


def extract_ping(records: DataFrame) -> DataFrame:
    value = group(F.col("text"), PING, 2).try_cast("double")
    rows = records.where((F.col("parser") == "callinfo") & F.col("text").contains("time=")).withColumn("value", value).where("value >= 0")
    return rows.drop("text").withColumns({"metric": F.lit("network.ping"), "unit": F.lit("ms"), "direction": F.lit("roundtrip"), "flow": F.lit("probe"), "ssrc": F.lit(""), "statistic": F.lit("sample"), "valid": F.lit(True)})


def extract_flow_stats(records: DataFrame) -> DataFrame:
    """Numbers of the JSON direction -> group -> metric -> statistic; what isn't finite is dropped, negatives are invalid."""
    rows = records.where(F.col("parser").isin("callinfo", "kpe") & (F.col("text").contains("call flow metric line") | F.col("text").contains("Info about first media flow finished")))
    nested = "map<string,map<string,map<string,string>>>"
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    for_each = F.array(*[F.struct(F.lit(d).alias("direction"), F.from_json(F.get_json_object(body, f"$.{d}"), nested).alias("m")) for d in ("incoming", "outgoing")])
    keys = [c for c in records.columns if c != "text"]
    rows = rows.select(*keys, F.explode(for_each).alias("d")).select(*keys, "d.direction", F.explode("d.m").alias("group", "m1"))
    rows = rows.select(*keys, "direction", "group", F.explode("m1").alias("name_", "m2")).select(*keys, "direction", "group", "name_", F.explode("m2").alias("statistic", "raw"))
    value = F.expr("try_cast(trim(raw) AS double)")
    rows = rows.withColumn("value", value).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) <> double('Infinity')")
    return rows.withColumns({"metric": F.concat_ws(".", F.lit("kpe"), "group", "name_"), "unit": F.when(F.col("name_").startswith("rtp_pkt"), "packets").otherwise("raw"), "flow": F.lit("0"), "ssrc": F.lit(""), "valid": F.col("value") >= 0}).drop("group", "name_", "raw")


# Fixed values: (metric, sentences, unit, kind) of a receiving device's lines.
DEVICE_FIELDS = [
    ("vd.buffer", ["buffer len in usecs:{n}"], "us", "gauge"),
    ("vd.buffer", ["Audio currently in buffer (ms):{n}"], "ms", "gauge"),
    ("vd.dejitter_target", ["ring current max buffer usecs (for dynamic dejittering):{n}"], "us", "gauge"),
    ("vd.silence_skipped", ["silence usecs skipped so far:{n}"], "us", "counter"),
    ("vd.silence_skipped", ["silence msecs skipped so far:{n}"], "ms", "counter"),
    ("vd.max_arrival_delay", ["m_maxPktArrivalTimeDelay to ms {n}"], "ms", "event"),
    ("vd.max_arrival_delay", [f"m_maxPktArrivalTimeDelay {unit}{mark}{{n}}" for unit in ("(ms)", "(ms) ", "in ms", "in ms ", "ms", "ms ") for mark in ":="], "ms", "gauge"),
    ("vd.max_arrival_delay", [f"m_maxPktArrivalTimeDelay{gap}{mark}{{n}}ms" for gap in ("", " ") for mark in ":="], "ms", "gauge"),
]
TO_MS = {"us": 0.001, "ms": 1.0}
RECEIVER = r"(?i)(NART\d+ of Line \d+)"


def exploded_lines(records: DataFrame) -> DataFrame:
    """A row a line (offset, line) of each record, with the record's first line and number."""
    keys = [c for c in records.columns if c != "text"]
    return records.select(*keys, first_line().alias("header"), F.posexplode(F.split("text", "\n")).alias("offset", "line"))


def record_window(records: DataFrame) -> Window:
    return Window.partitionBy("import_id", "name", "line_no").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)


def extract_device_metrics(records: DataFrame) -> DataFrame:
    """Values in the scope of the last named receiving device; another device ends the scope. Microseconds become milliseconds."""
    lines = exploded_lines(records.where(F.col("parser") == "vd"))
    named = F.when(F.col("line").contains("Device name:"), F.coalesce(group(F.col("line"), RECEIVER), F.lit(""))).when(F.col("offset") == 0, F.coalesce(group(F.col("header"), RECEIVER), F.lit("")))
    lines = lines.withColumn("device", F.last(named, ignorenulls=True).over(record_window(records))).where("device <> ''")
    found = lambda forms: F.coalesce(*[group(F.col("line"), f"(?i){sentence(x)}") for x in forms])
    values = [(found(forms), {"metric": m, "raw_unit": u, "factor": str(TO_MS[u]), "sample_kind": k}) for m, forms, u, k in DEVICE_FIELDS]
    out = with_fields(lines, values, "raw_value")
    out = out.withColumns({"line_id": group(F.col("device"), r"(?i)Line (\d+)").cast("int"), "flow": group(F.col("device"), r"(?i)NART(\d+)"), "ssrc": F.lit(""), "direction": F.lit("incoming")})
    trips = exploded_lines(records.where((F.col("parser") == "rtcp") & F.col("text").contains("RTT by this source"))).join(ssrc_of(records), ["import_id", "name", "line_no"])
    values = [(group(F.col("line"), f"(?i){sentence('RTT by this source:{n}microseconds')}"), {"metric": "rtcp.rtt", "raw_unit": "us", "factor": "0.001", "sample_kind": "sample"})]
    trips = with_fields(trips, values, "raw_value").withColumns({"device": F.lit(""), "line_id": F.coalesce(group(F.col("header"), r"(?i)LINE\s+(\d+)").cast("int"), *([F.col("line_id")] if "line_id" in records.columns else [])), "flow": F.coalesce(group(F.col("header"), r"(?i)FLOW\s+(\d+)"), F.lit("?")), "direction": F.lit("roundtrip")})
    out = out.unionByName(trips, allowMissingColumns=True)
    return out.withColumns({"value": F.col("raw_value") * F.col("factor").cast("double"), "unit": F.lit("ms"), "valid": F.col("raw_value") >= 0}).drop("factor", "header", "line")


def ssrc_of(records: DataFrame) -> DataFrame:
    """The source that a record's block is about."""
    rows = records.where((F.col("parser") == "rtcp") & F.col("text").contains("RTT by this source"))
    return rows.select("import_id", "name", "line_no", F.coalesce(group(F.col("text"), r"SSRC of this source:\s*(\w+)"), F.lit("")).alias("ssrc"))


# Labels of periodic blocks, metrics and units.
PERIODIC_FIELDS = [
    ("Audio currently in buffer (ms)", "buffer", "ms", "gauge"),
    ("silence msecs skipped so far", "silence_skipped", "ms", "counter"),
    ("ring current max buffer usecs (for dynamic dejittering)", "dejitter_target", "us", "gauge"),
    ("audio samples skipped so far", "samples_skipped", "samples", "counter"),
    ("ring hard max buffer usecs", "buffer_hard_max", "us", "gauge"),
    ("ring min buffer usecs", "buffer_min", "us", "gauge"),
    ("number of buffer underruns occurred on this ring for this VOD", "underruns", "count", "counter"),
    ("silence msecs played out for buffer underruns occurred on this ring for this VOD", "silence_played", "ms", "counter"),
    ("Total bytes read from source", "bytes_read", "bytes", "counter"),
    ("Total bytes sent to decoder", "bytes_decoder", "bytes", "counter"),
    ("Total packets/chunks sent to decoder", "chunks_decoder", "chunks", "counter"),
    ("Total media read from middleware", "media_read", "ms", "counter"),
    ("Total media sent out", "media_sent", "ms", "counter"),
    ("Total media sent to middleware", "media_middleware", "ms", "counter"),
    ("Number of device reset for scheduling delay", "scheduling_resets", "count", "counter"),
    ("ALL Pkts received so far", "packets_all", "packets", "counter"),
    ("RTP Pkts received so far", "packets_rtp", "packets", "counter"),
    ("RTCP Pkts received so far", "packets_rtcp", "packets", "counter"),
    ("RTP GOOD Pkts received so far", "packets_rtp_good", "packets", "counter"),
    ("RTP BAD Pkts received so far", "packets_rtp_bad", "packets", "counter"),
    ("Number of Read Errors", "read_errors", "count", "counter"),
    ("Number of Write Errors", "write_errors", "count", "counter"),
    ("Number of Encoding Errors", "encoding_errors", "count", "counter"),
    ("Number of Decoding Errors", "decoding_errors", "count", "counter"),
    ("Current read error event duration (msecs)", "read_error_duration", "ms", "gauge"),
    ("Current write error event duration (msecs)", "write_error_duration", "ms", "gauge"),
    ("Current encoding error event duration (msecs)", "encoding_error_duration", "ms", "gauge"),
    ("Current decoding error event duration (msecs)", "decoding_error_duration", "ms", "gauge"),
    ("RTP last streak of GOOD Pkts received", "streak_good", "packets", "gauge"),
    ("RTP last streak of BAD Pkts received", "streak_bad", "packets", "gauge"),
]
# Fixed values: (sentence, metric, unit, kind) of what a block says in a sentence.
PERIODIC_SENTENCES = [
    ("Cumulative write rate is {n}samples per second", "write_rate", "samples/s", "gauge"),
    ("Accumulated delay is {n}ms", "scheduling_delay", "ms", "counter"),
    ("Currently in underrun for this VOD since {n}msecs", "underrun_duration", "ms", "gauge"),
    ("read bytes:{n}", "heartbeat_bytes_read", "bytes", "reported statistic"),
    ("written bytes {n}", "heartbeat_bytes_written", "bytes", "reported statistic"),
    ("Running cycles (last {n}ms)", "heartbeat_window", "ms", "interval"),
]
#: Names and counts of the phases of a running cycle, as many of the one as of the other.
CYCLES, PHASES = r"Running cycles.*? -\s*([^:]*?)\s*-\s*:\s*(.*?)[.]?\s*$", 5
ALIVE = r"VD\s+(\d+)\s+\((.*?)\)\s+is alive and kicking"
WHOLE_UNITS = ("count", "packets", "samples", "bytes", "chunks")


def periodic_lines(records: DataFrame) -> DataFrame:
    """Lines of periodic device blocks with observer, output_device, input_device and device in scope."""
    marker = F.col("text").contains("READING Virtual Output Device Running Info") | F.col("text").rlike(ALIVE)
    lines = exploded_lines(records.where((F.col("parser") == "vd") & marker))
    over = record_window(records)
    connects = F.upper("line").contains("CONNECTED INPUT DEVICE")
    lines = lines.withColumns({"connected": F.max(F.when(connects, 1).otherwise(0)).over(over), "alive": F.col("header").rlike(ALIVE)})
    named = F.when(F.col("line").contains("Device name:"), F.trim(F.substring_index("line", "Device name:", -1)))
    lines = lines.withColumns({
        "output_device": F.coalesce(F.last(F.when(F.col("connected") == 0, named), ignorenulls=True).over(over), F.lit("")),
        "input_device": F.coalesce(F.last(F.when(connects | ((F.col("connected") == 0) & named.isNotNull()), F.lit("")).when(F.col("connected") == 1, named), ignorenulls=True).over(over), F.lit("")),
        "observer": F.coalesce(F.get(F.regexp_extract_all("header", F.lit(r"\[([^]]+)\]"), 1), 1), F.lit("")),
        "beating": F.when(F.col("alive"), F.trim(F.regexp_extract("header", ALIVE, 2))),
    })
    # a heartbeat's device is in scope until a block names one
    lines = lines.withColumn("device", F.when(F.col("connected") == 1, F.col("input_device")).when(F.col("output_device") == "", F.coalesce("beating", F.lit(""))).otherwise(F.col("output_device"))).drop("beating")
    reader = F.when(F.col("input_device") == "Default Audio Input", F.col("output_device"))  # the default input is read by a writer of a line
    part = lambda n: F.coalesce(group(F.col("device"), r"NA[RW]T(\d+) of Line (\d+)", n), group(reader, r"NAWT(\d+) of Line (\d+)", n))
    return lines.withColumns({"line_id": part(2).cast("int"), "flow": F.coalesce(part(1), F.lit("?"))})


def extract_periodic(records: DataFrame) -> DataFrame:
    """Numbers of periodic blocks: labelled ones (looked up in the table of fields, which Spark broadcasts), those in sentences, and the phases of running cycles."""
    spark = records.sparkSession
    lines = periodic_lines(records)
    fields = spark.createDataFrame([(label.lower(), f"vd.{m}", u, k) for label, m, u, k in PERIODIC_FIELDS], "label string, metric string, raw_unit string, sample_kind string")
    body = F.expr("substring(line, instr(line, ':') + 1)")
    rows = lines.withColumn("label", F.lower(F.trim(F.substring_index("line", ":", 1)))).join(F.broadcast(fields), "label").drop("label")
    rows = rows.withColumn("raw_value", group(body, rf"^\s*({NUMBER})(?![\w]|\.\d)").try_cast("double")).where("raw_value IS NOT NULL AND abs(raw_value) <> double('Infinity')")
    unlabelled = F.col("metric").startswith("vd.media_") & ~body.rlike(rf"^\s*{NUMBER}\s+ms\b")
    rows = rows.withColumn("raw_unit", F.when(unlabelled, "raw").otherwise(F.col("raw_unit")))
    said = [(group(F.col("line"), f"(?i){sentence(text)}"), {"metric": f"vd.{m}", "raw_unit": u, "sample_kind": k}) for text, m, u, k in PERIODIC_SENTENCES]
    rows = rows.unionByName(with_fields(lines, said, "raw_value"))
    names, counts = (F.split(F.regexp_extract("line", CYCLES, n), r"\s*,\s*") for n in (1, 2))
    whole = (F.size(names) == PHASES) & (F.size(counts) == PHASES) & F.forall(counts, lambda c: F.trim(c).rlike(rf"^{NUMBER}$"))
    cycles = lines.where(F.col("line").contains("Running cycles")).where(whole).withColumn("_z", F.explode(F.arrays_zip(names.alias("phase"), counts.alias("count"))))
    kind = F.when(F.col("alive"), "reported statistic").otherwise("counter")
    cycles = cycles.withColumns({"metric": F.concat(F.lit("vd.cycles_"), slug(F.col("_z.phase"))), "raw_unit": F.lit("count"), "sample_kind": kind, "raw_value": F.trim("_z.count").try_cast("double")}).drop("_z")
    rows = rows.unionByName(cycles)
    way = F.when(F.col("device").startswith("NAWT") | F.col("output_device").startswith("NAWT"), "outgoing").when(F.col("device").startswith("NART"), "incoming").otherwise("unknown")
    micro = F.col("raw_unit") == "us"
    valid = (F.col("raw_value") >= 0) & (~F.col("raw_unit").isin(*WHOLE_UNITS) | (F.col("raw_value") == F.floor("raw_value")))
    return rows.withColumns({"value": F.when(micro, F.col("raw_value") / 1000).otherwise(F.col("raw_value")), "unit": F.when(micro, "ms").otherwise(F.col("raw_unit")), "valid": valid, "direction": way}).drop("line", "header", "connected", "alive")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\W+", "_")


# Labels of states, of stages, and of numbers of packets.
YES_NO = ["Currently in total buffer underrun", "Currently in partial buffer underrun", "Currently in buffer underrun on this VOD"]
STAGES = ["Current processing stage", "Last read processing stage known", "Last write processing stage known"]
RTP_NUMBERS = [
    "Last written RTP SN", "RTP last pkt SN", "RTP last pkt ROC", "RTP last pkt GOOD SN", "RTP last pkt GOOD ROC",
    "RTP first GOOD pkt SN", "RTP first BAD pkt SN", "RTP last GOOD pkt SN", "RTP last BAD pkt SN",
]
RTCP_STATES = {
    "RTCP Message n.": "rtcp.message_number",
    "Sender Report - ntp timestamp received from this source": "rtcp.ntp_timestamp",
    "Sender Report - rtp timestamp corresponding to ntp time": "rtcp.rtp_timestamp",
}
#: A stage's name, its code in brackets, and the time it was reached.
STAGE_VALUE = r"([^\s.(]+)(?:\((\d+)\))?(?:[.]\s*Timestamp\s+(.*?)[.]?)?\s*$"


def labelled(labels: list[str], more: str = "") -> str:
    """A pattern whose first group is one of the labels before a colon."""
    return "(" + "|".join([*(literal(x) for x in labels), *([more] if more else [])]) + r"):\s*"


def stage_json(line: Column, pattern: str, first: int) -> Column:
    """A stage as JSON; NULL where the line has none."""
    made = F.to_json(F.struct(group(line, pattern, first).alias("state"), group(line, pattern, first + 1).cast("int").alias("code"), group(line, pattern, first + 2).alias("timestamp")))
    return F.when(line.rlike(pattern), made)


def extract_periodic_states(records: DataFrame) -> DataFrame:
    """States, stages and numbers of periodic blocks, of device monitors and of RTCP blocks as ``value_json``."""
    rows = periodic_lines(records)
    line = F.col("line")
    yes_no = "(?i)" + labelled(YES_NO, r"Currently in \w+ error event") + r"(yes|no)\b"
    stage, number = labelled(STAGES) + STAGE_VALUE, labelled(RTP_NUMBERS) + r"(\d+)\b"
    found = [
        (slug(group(line, yes_no)), F.when(line.rlike(yes_no), (F.lower(F.regexp_extract(line, yes_no, 2)) == "yes").cast("string"))),
        (slug(group(line, stage)), stage_json(line, stage, 2)),
        (slug(group(line, number)), group(line, number, 2)),
        (F.lit("heartbeat_device_id"), F.when(F.col("offset") == 0, group(line, ALIVE))),
    ]
    out = with_states(rows, [(F.concat(F.lit("vd."), name), value) for name, value in found])
    monitor = r"(NART|NAWT) status:\s*" + STAGE_VALUE
    watched = exploded_lines(records.where((F.col("parser") == "vd") & F.col("text").rlike("NA[RW]T status:")).withColumn("_line", group(F.col("text"), r"(?i)\bLine\s+(\d+)").cast("int")))
    watched = watched.withColumns({"device": group(line, monitor), "line_id": F.col("_line"), "flow": F.lit("?")}).drop("_line")
    out = out.unionByName(with_states(watched, [(F.lit("vd.monitor_stage"), stage_json(line, monitor, 2))]), allowMissingColumns=True)
    reports = exploded_lines(records.where((F.col("parser") == "rtcp") & F.col("text").contains("RTCP ARRIVED")))
    reports = with_states(reports, [(F.lit(name), F.nullif(F.trim(group(line, literal(label) + r":\s*(.*)")), F.lit(""))) for label, name in RTCP_STATES.items()])
    return out.unionByName(reports, allowMissingColumns=True)


def with_states(lines: DataFrame, found: list[tuple[Column, Column]]) -> DataFrame:
    """A row (metric, value_json) for each value that a line has."""
    made = F.array(*[F.struct(name.alias("metric"), value.alias("value_json")) for name, value in found])
    rows = lines.withColumn("_s", F.explode(F.filter(made, lambda s: s["value_json"].isNotNull())))
    return rows.select(*[c for c in lines.columns if c not in ("line", "header", "connected", "alive")], "_s.*")


# The notice of a gap in sequence numbers.
PACKET_GAP = sentence("Packet loss occurred. Current packet SN is {d}. Previous packet SN was {d} SN delta is {d} ({d} missing packet")


def extract_missing_packets(records: DataFrame) -> DataFrame:
    """Notices of gaps in sequence numbers, 1 to 65535 packets."""
    lines = exploded_lines(records.where(F.col("text").contains("Packet loss occurred")))
    line = F.col("line")
    gap = f"(?i){PACKET_GAP}"
    out = lines.withColumns({"device": group(line, RECEIVER), "value": group(line, gap, 4).try_cast("double"), "current_sn": group(line, gap, 1).try_cast("long")})
    out = out.withColumns({"flow": group(F.col("device"), r"(?i)NART(\d+)"), "line_id": group(F.col("device"), r"(?i)Line (\d+)").cast("int")})
    return out.where("value BETWEEN 1 AND 65535 AND device IS NOT NULL").withColumns({"metric": F.lit("vd.missing_packets"), "unit": F.lit("packets"), "valid": F.lit(True)}).drop("line", "header")


# --- positions and networks --------------------------------------------------------------

def valid_position(lat: Column, lon: Column, accuracy: Column | None = None) -> Column:
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok & (accuracy.isNull() | (accuracy >= 0)) if accuracy is not None else ok, F.lit(False))


def extract_positions(records: DataFrame) -> DataFrame:
    """Fixes of location lines (fresh or cached) and X-Location headers of SIP messages (never of bodies)."""
    dated = android_timestamp(records.where("ts IS NOT NULL"))
    lines = exploded_lines(dated.where(F.col("text").contains("Location["))).where(F.col("line").contains("Location["))
    # the provider, latitude, longitude, and settings like et=
    lines = M.bind(lines, "_f", F.split(M.behind(F.col("line"), "Location["), r"[\s,\]]+"))
    setting = lambda name: F.nullif(M.behind(F.get(F.filter("_f", lambda x: x.startswith(name)), F.lit(0)), name), F.lit(""))
    place = lambda n: M.finite(F.get("_f", F.lit(n)))
    fixes = lines.withColumns({"latitude": place(1), "longitude": place(2), "accuracy": M.finite(setting("hAcc=")), "elapsed": setting("et="), "kind": F.when(F.col("line").contains("New location received:"), "fresh").otherwise("cached")})
    fixes = fixes.where("latitude IS NOT NULL AND longitude IS NOT NULL").drop("line", "header", "_f")
    sip = M.with_headers(dated.where(F.col("text").contains("SIP message:")))
    sip = M.bind(sip, "_g", M.geo_uri(M.word(M.header("x-location"))))
    sip = sip.withColumns({"latitude": F.col("_g.latitude"), "longitude": F.col("_g.longitude"), "accuracy": F.lit(None).cast("double"), "elapsed": F.lit(None).cast("string"), "kind": F.when(F.col("text").contains("OUTGOING SIP message:"), "sip_local").otherwise("sip_remote"), "offset": F.lit(0)})
    sip = sip.where("latitude IS NOT NULL AND longitude IS NOT NULL").drop("_title", "_headers", "_g", "text")
    return fixes.unionByName(sip, allowMissingColumns=True).withColumn("valid", valid_position(F.col("latitude"), F.col("longitude"), F.col("accuracy")))


# What a record of configured headers begins with.
EXTRA_HEADERS = "Adding extra headers to sip messages:"


def extract_config_positions(records: DataFrame) -> DataFrame:
    """Positions of configured extra headers, each place once a record."""
    rows = M.bind(records.where(F.col("text").contains(EXTRA_HEADERS)), "_m", M.tagged(F.col("text")))
    rows = rows.where(F.col("_m.tag").isin("KPECORE", "CORE") & (F.col("_m.level") == "INFO") & F.col("_m.message").startswith(EXTRA_HEADERS))
    body = F.ltrim(M.tail(F.col("_m.message"), len(EXTRA_HEADERS)))
    shape = "struct<extraHeaders:array<struct<headerName:string,values:array<struct<headerVal:string>>>>>"
    rows = M.bind(rows.where(body.startswith("{")), "_b", F.from_json(body, shape)).drop("_m")
    rows = rows.withColumn("_h", F.explode("_b.extraHeaders")).where("lower(_h.headerName) = 'x-location'").withColumn("_v", F.explode("_h.values.headerVal"))
    rows = M.bind(rows, "_g", M.geo_uri(F.col("_v"))).withColumns({"latitude": F.col("_g.latitude"), "longitude": F.col("_g.longitude")})
    rows = rows.drop("_g").where("latitude IS NOT NULL AND longitude IS NOT NULL")
    rows = rows.drop("_b", "_h", "_v", "text").dropDuplicates(["import_id", "name", "line_no", "latitude", "longitude"])
    return rows.withColumns({"kind": F.lit("config"), "valid": valid_position(F.col("latitude"), F.col("longitude"))})


def extract_network_obs(records: DataFrame) -> DataFrame:
    """Accesses that interface lines or device statuses declare; a cellular one goes out directly."""
    lines = exploded_lines(android_timestamp(records.where("ts IS NOT NULL").where(F.col("text").contains("Current network interface:") | F.col("text").contains("DeviceStatus:"))))
    interface = group(F.col("line"), r"\s:\sCurrent network interface:\s*(\w+)\s*$")
    status = F.when(F.col("line").rlike(r"\bProcessCallLogger[^\n]*\s:\sDeviceStatus:\s*\{"), F.get_json_object(F.substring_index("line", "DeviceStatus:", -1), "$.connectionType"))
    rows = lines.withColumns({"_v": F.lower(F.coalesce(interface, status)), "basis": F.when(interface.isNotNull(), "interface_observed").otherwise("device_status_observed")}).where("_v IS NOT NULL")
    access = F.when(F.col("_v").isin("wifi", "wi-fi"), "wifi").when(F.col("_v").isin("cellular", "ethernet"), F.col("_v")).otherwise("unknown")
    return rows.withColumn("access", access).withColumn("upstream", F.when(F.col("access") == "cellular", "mobile_direct").otherwise("unknown")).drop("_v", "line", "header")


# Fixed values: (file name, text of the first line, layer, state) and our word for why.
APP_FILES = r"^(?:app\.log$|phoneengine\.log$|application)"
CONNECTIVITY = [
    ("^vdklog", "Network UP for both pingers", "stun", "up", "both_probes_answer"),
    ("^vdklog", "Network DOWN for ONE pingers", "stun", "transient", "one_probe_silent"),
    ("^vdklog", "Network DOWN for BOTH pingers", "stun", "down", "both_probes_silent"),
    ("^vdklog", r"Stopping STUN pinger\.\.\.", "stun", "unknown", "probes_stopped"),
    ("^vdklog", r"Starting STUN pinger\.\.\.", "stun", "transient", "probes_starting"),
    (APP_FILES, r"Device is not connected to the network\.|\bNetwork (?:is )?lost\b", "device", "down", "network_unavailable"),
    (APP_FILES, "Code=-1009", "device", "transient", "request_failed_offline"),
    (APP_FILES, r"\bNetwork (?:is )?available\b|connectivityState = UP", "device", "available", "interface_available"),
    (APP_FILES, "Current network interface:", "device", "available", "interface_declared"),
    ("^ctilib", "login succeded!|We are still online!|Probe received!", "cti", "up", "service_answered"),
    ("^ctilib", "The remote host closed the connection", "cti", "down", "closed_by_peer"),
    ("^ctilib", "noACKtimeout|ConnectionTimeout", "cti", "down", "service_timeout"),
    ("^ctilib", "Destroying CtiLib", "cti", "unknown", "stopped_locally"),
    (r"^phoneengine\.log$", r"Kpe is unready\.\.\. try later", "app", "down", "engine_not_ready"),
    (r"^phoneengine\.log$", "KPE change state from: .*? to: connected$", "app", "up", "engine_state"),
    (r"^phoneengine\.log$", "KPE change state from: .*? to: (?:connecting|disconnecting)$", "app", "transient", "engine_state"),
    (r"^phoneengine\.log$", "KPE change state from: .*? to: .+$", "app", "down", "engine_state"),
    ("^resip", "Broken pipe|SSL_read error", "sip", "down", "transport_error"),
]


def extract_connectivity(records: DataFrame) -> DataFrame:
    """(layer, state, reason) that a record proves; of one layer the first rule that fits counts. Any SIP response proves SIP up."""
    base, h = base_name("name"), first_line()
    said = lambda state, reason: F.struct(F.lit(state).alias("state"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    found = []
    for layer in dict.fromkeys(x[2] for x in CONNECTIVITY):
        rules = [(base.rlike(file) & h.rlike(text), said(state, why)) for file, text, at, state, why in CONNECTIVITY if at == layer]
        if layer == "device":
            rules.insert(1, (base.rlike(APP_FILES) & F.col("text").contains("No network route"), said("down", "no_route")))
        if layer == "sip":
            code, method = M.response_code(F.col("_title")).cast("string"), M.word(M.header("cseq"), 1)
            answer = base.startswith("sip_debug") & h.contains("INCOMING SIP message:") & code.isNotNull() & method.isNotNull()
            rules.insert(0, (answer, said("up", F.concat(F.lit("answer_"), code, F.lit("_"), F.lower(method)))))
        value = F.when(F.lit(False), said("", ""))
        for holds, what in rules:
            value = value.when(holds, what)
        found.append(F.struct(F.lit(layer).alias("layer"), value["state"].alias("state"), value["reason"].alias("reason")))
    rows = M.with_headers(records.where("ts IS NOT NULL")).withColumn("_s", F.explode(F.filter(F.array(*found), lambda s: s["state"].isNotNull())))
    return rows.select(*[c for c in records.columns if c != "text"], "_s.*")


# Fixed values: (type, sentence of the first line, what its hole is, detail) of notifications; the hole is the
# next state, a code that the detail ends with, or nothing of interest.
TRANSIENTS = [
    ("scheduling_reset", "We reset the VOD timing to avoid continuous false warnings.", None, "vod_timing_reset_notification"),
    ("audio_reset_request", "AudioRoute: resetAudio. CurrentAudioRoute:", None, "reset_operation_not_device_recreation"),
    ("audio_route_change", "Received route change notification: AVAudioSessionRouteChangeReason(rawValue: {d})", "code", "reason_code:"),
    ("audio_route_change", "AudioState[communicationDeviceChanged -> {..}type='{W}'", "state", "communication_device_notification"),
    ("audio_session_start", "AudioState[startAudioSession]", None, "session_operation"),
    ("audio_session_stop", "AudioState[stopAudioSession]", None, "session_operation"),
    ("speakerphone_set", "Set isSpeakerphoneActive [{b}]", "state", "set_operation"),
    ("mute_set", "Setting audio input {#} mute status to {b}", "state", "set_operation"),
    ("hold_request", "On hold request sent, waiting for response...", None, "request_not_completion"),
    ("resume_request", "Blocking resume call on line {d}", None, "request_not_completion"),
    ("hold_change_accepted", "VDK reported that on-hold change request on line {d} has been ACCEPTED", None, "direction_unknown"),
]
# Notices that are the whole of a monitor's message, and the creation of a device.
MONITOR = r"/(?:NetworkMonitor|ConnectionChangeMonitor)[^:]* : Network (?:is )?"
WHOLE_NOTICES = [
    ("network_change_notification", r": Network connection changed\s*$", None, "interface_unknown"),
    ("network_available", MONITOR + r"available(?:\s*:\s*\d+)?\s*$", None, "availability_notification"),
    ("network_lost", MONITOR + r"lost(?:\s*:\s*\d+)?\s*$", None, "availability_notification"),
    ("device_created", r"Creating device\s+(Default Audio (?:In|Out)put|NA[RW]T\d+ of Line \d+)\s*$", "state", "creation_not_reset"),
]
ROUTES = ("BUILTIN_EARPIECE", "BUILTIN_SPEAKER", "BLUETOOTH_SCO", "BLUETOOTH_A2DP", "WIRED_HEADSET", "WIRED_HEADPHONES", "USB_HEADSET")
SSID = sentence(": Network changed from SSID: {*} - IP: {*} to SSID: {*} - IP: {*}") + r"\s*$"


def extract_transients(records: DataFrame) -> DataFrame:
    """Notifications of known formats with type, next_state and detail, never other text of the record."""
    h = first_line()
    found = []
    for kind, text, hole, detail in [*((k, sentence(x), hole, d) for k, x, hole, d in TRANSIENTS), *WHOLE_NOTICES]:
        value = group(h, text) if hole else F.lit(None).cast("string")
        if kind == "speakerphone_set":
            value = F.lower(value)
        if detail == "communication_device_notification":
            value = F.when(value.isin(*ROUTES), value).when(value.isNotNull(), "other")
        next_state = value if hole == "state" else F.lit(None).cast("string")
        note = F.concat(F.lit(detail), value) if hole == "code" else F.lit(detail)
        found.append(F.when(h.rlike(text), F.struct(F.lit(kind).alias("type"), next_state.alias("next_state"), note.alias("detail"))))
    changed = h.rlike(SSID) & ~(F.regexp_extract(h, SSID, 1).eqNullSafe(F.regexp_extract(h, SSID, 3)) & F.regexp_extract(h, SSID, 2).eqNullSafe(F.regexp_extract(h, SSID, 4)))
    plain = lambda kind, detail: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("next_state"), F.lit(detail).alias("detail"))
    found.append(F.when(changed, plain("network_configuration_change", "ssid_or_ip_changed_not_interface_proof")))
    again = F.exists(M.parameters(M.header("to", "t")), lambda x: x.startswith("tag=") & (x != "tag="))
    found.append(F.when(F.col("_title").startswith("INVITE ") & again, plain("sip_reinvite", "in_dialog_request")))
    rows = M.with_headers(android_timestamp(records.where("ts IS NOT NULL"))).withColumn("_t", F.explode(F.filter(F.array(*found), lambda t: t.isNotNull())))
    return rows.select(*[c for c in records.columns if c != "text"], "time_basis", "_t.*", F.sha2("text", 256).alias("text_hash"))


# The request to switch, who makes it, and the letters of a state's name.
SWITCH, SWITCH_TAG, SWITCH_LEVELS = "KPE was requested to handle a switchNetworkEvent", "KPECORE", ("INFO", "DEBUG", "WARNING")
STATE_NAME = "^[A-Za-z+ -]+$"
# States that a switch may name.
SWITCH_STATES = ("wifi", "cellular", "ethernet", "edge", "lte", "gprs", "umts", "hspa", "hspap", "nr", "nrnsa", "unknown")


def extract_network_switches(records: DataFrame) -> DataFrame:
    """Requests to switch the network: the marker is the whole message, not a part of another text."""
    rows = M.bind(records.where(base_name("name").startswith("kpelog") & F.col("text").contains("switchNetworkEvent")), "_m", M.tagged(first_line()))
    rows = rows.where((F.col("_m.tag") == SWITCH_TAG) & F.col("_m.level").isin(*SWITCH_LEVELS) & F.col("_m.message").startswith(SWITCH))
    rest = F.btrim(M.tail(F.col("_m.message"), len(SWITCH)), F.lit(" ."))
    rows = M.bind(rows, "_p", F.struct(rest.alias("rest"), F.when(rest.startswith("from "), F.split(M.tail(rest, 5), " to ")).alias("pair")))
    pair = F.col("_p.pair")
    fits = (F.col("_p.rest") == "") | F.coalesce((F.size(pair) == 2) & F.forall(pair, lambda x: x.rlike(STATE_NAME)), F.lit(False))
    state = lambda n: F.replace(F.lower(F.trim(F.get(pair, F.lit(n - 1)))), F.lit("wi-fi"), F.lit("wifi"))
    known = lambda c: F.when(c.isin(*SWITCH_STATES), c)
    rows = rows.where(fits).withColumns({"previous": known(state(1)), "next": known(state(2))}).drop("_m", "_p")
    return rows.withColumn("transition_basis", F.when(F.col("previous").isNotNull() & F.col("next").isNotNull(), "explicit_fields").otherwise("not_reported")).drop("text")


# What a watcher of a flow says, and what an underrun's notice says of its time.
FLOW_REPORT, FLOW_SILENT = sentence("Line {d} reported that flow {d}"), sentence("has not received RTP media for more than {n}{u}")
FLOW_BACK = ("has re-started receiving rtp media", "has started receiving rtp media again")
EVENT_LASTS = [sentence("Event was {n}{u}"), sentence("Event is currently {n}{u}")]


def extract_incident_signals(records: DataFrame) -> DataFrame:
    """Begin, continuation and end of audio underruns and of missing media, with the reported duration."""
    h = first_line()
    rows = records.where("ts IS NOT NULL").where(F.lower(h).contains("buffer underrun") | h.rlike(r"(?i)reported that flow\s+\d+"))
    media, missing = f"(?i){FLOW_REPORT}", f"(?i){FLOW_SILENT}"
    reported, low = h.rlike(media), F.lower(h)
    silent = F.when(reported, duration_ms(group(h, missing, 1), group(h, missing, 2)))
    lasts = F.coalesce(*[duration_ms(group(h, f"(?i){x}", 1), group(h, f"(?i){x}", 2)) for x in EVENT_LASTS])
    under = F.when(h.contains("Buffer underrun occurred"), "start").when(h.contains("Buffer underrun event terminated"), "end").when(h.contains("Still in buffer underrun"), "ongoing")
    of_media = F.when(silent.isNotNull(), "missing").when(reported & (low.contains(FLOW_BACK[0]) | low.contains(FLOW_BACK[1])), "end")
    named = F.split(h, "(?i)input device ", 2)
    source = F.coalesce(F.trim(F.get(F.split(F.get(named, F.lit(1)), r"[.](?:\s|$)", 2), F.lit(0))), F.lit(""))
    headers = F.regexp_extract_all(h, F.lit(r"\[([^\]]+)\]"), 1)
    rows = rows.withColumns({
        "kind": F.when(of_media.isNotNull(), "media_missing").when(under.isNotNull() & (source != ""), "buffer_underrun"),
        "phase": F.coalesce(of_media, under),
        "flow": F.when(of_media.isNotNull(), F.regexp_extract(h, media, 2)).otherwise(""),
        "device": F.when(of_media.isNotNull(), F.concat(F.lit("Line "), F.regexp_extract(h, media, 1))).otherwise(source),
        "observer": F.when(of_media.isNotNull(), F.concat(F.lit("RTP flow "), F.regexp_extract(h, media, 2))).otherwise(F.coalesce(F.get(headers, 1), F.lit("unknown"))),
        "duration_ms": F.when(of_media == "missing", silent).when(of_media.isNull(), lasts),
    })
    line = F.coalesce(group(F.col("observer"), r"(?i)of Line (\d+)"), group(F.col("device"), r"(?i)Line (\d+)")).cast("int")
    return rows.where("kind IS NOT NULL").withColumn("line_id", line).drop("text")


def extract_app_versions(records: DataFrame) -> DataFrame:
    """Name and version markers of an application."""
    pattern = r"(?i)\bapp(?:lication)? (?:name|version)\s*[:=]\s*([\w.+ -]{1,80})"
    return records.where(F.lower("text").contains("version")).withColumn("version", F.trim(group(first_line(), r"(?i)\bversion\s*[:=]\s*([\w.+-]{1,80})"))).withColumn("app_name", F.trim(group(F.col("text"), pattern))).where("version IS NOT NULL").drop("text")


def source_profile(files: DataFrame, records: DataFrame) -> DataFrame:
    """Platform of an import by its files' names, and model, system and app version of its info file."""
    names = files.groupBy("import_id").agg(F.bool_or(base_name("name").startswith("kpe-android")).alias("_a"), F.bool_or(base_name("name") == "ios_hwwrapper.log").alias("_i"))
    platform = F.when(F.col("_a"), "android").when(F.col("_i"), "ios").otherwise("unknown")
    lines = exploded_lines(records.where(base_name("name") == "info.log"))
    key, value = F.upper(F.btrim(F.substring_index("line", ":", 1))), F.btrim(M.behind(F.col("line"), ":"))
    known = key.isin("DEVICE MODEL", "OS VERSION", "APP VERSION") & F.length(value).between(1, 120)
    lines = lines.withColumns({"_k": F.when(known, key), "_v": value}).where("_k IS NOT NULL")
    order = F.struct("line_no", "offset")
    pick = lambda k: F.max_by(F.when(F.col("_k") == k, F.col("_v")), F.when(F.col("_k") == k, order))
    info = lines.groupBy("import_id").agg(pick("DEVICE MODEL").alias("model"), pick("OS VERSION").alias("os_version"), pick("APP VERSION").alias("app_version"))
    return names.select("import_id", platform.alias("platform")).join(info, "import_id", "left")


def call_id_of(text: str = "text") -> Column:
    """The Call-ID that a record names on a line of its own, whatever the record is."""
    return F.when(F.lower(text).contains("call-id"), M.word(M.header_of(M.trimmed_lines(F.col(text)), "call-id")))


# The authentication at the CTI server.
AUTH, AUTH_TAGS = "Sending auth to CTIServer", "[CTILIB] [INFO]"


def identity_markers(files: DataFrame, records: DataFrame) -> DataFrame:
    """What an import says of its producer, a row a proof: instance, device with its system, platform; ``malformed`` for a proof that can't be read.

    Instances are those of Contact headers of outgoing REGISTER requests, devices those of the
    authentication at the CTI server, platforms follow from file names.
    """
    base = base_name("name")
    none = F.lit(None).cast("string")
    platform = F.when(base == "ios_hwwrapper.log", "ios").when(base.startswith("kpe-android"), "android")
    out = files.select("import_id", none.alias("instance"), none.alias("device"), none.alias("os"), platform.alias("platform"), F.lit(False).alias("malformed")).where("platform IS NOT NULL").distinct()

    sent = M.with_headers(records.where(base.startswith("sip_debug") & F.col("text").contains("OUTGOING SIP message:") & ~F.col("text").contains("INCOMING SIP")))
    contacts = sent.where(F.col("_title").startswith("REGISTER ")).withColumn("_c", F.explode(F.filter("_headers", lambda x: M.is_header(x, ("contact",)) & x.contains("+sip.instance"))))
    instances = F.filter(M.parameters(F.col("_c")), lambda x: x.startswith("+sip.instance="))
    urn = F.btrim(M.behind(F.get(instances, F.lit(0)), "="), F.lit('"<>'))
    value = F.when(urn.startswith("urn:uuid:") | urn.startswith("urn:uid:"), F.substring_index(urn, ":", -1))
    good = (F.size(instances) == 1) & M.is_uuid(value)
    out = out.unionByName(contacts.select("import_id", F.when(good, value).alias("instance"), none.alias("device"), none.alias("os"), none.alias("platform"), (~F.coalesce(good, F.lit(False))).alias("malformed")))

    lines = exploded_lines(records.where(base.startswith("ctilib") & F.col("text").contains(AUTH))).where(F.col("line").contains(AUTH))
    head = F.rtrim(F.substring_index("line", AUTH, 1))
    items = F.split(M.behind(F.col("line"), AUTH), " - ")
    item = lambda name: M.word(F.ltrim(M.behind(F.get(F.filter(items, lambda x: x.startswith(name)), F.lit(0)), name)))
    os, device = F.get(F.split(item("OS:"), r"\W"), F.lit(0)), item("device ID:")
    whole = head.endswith(AUTH_TAGS) & os.isin("ios", "android") & F.exists(items, lambda x: x.startswith("pre-shared key:")) & F.length(device).between(1, 200)
    told = lines.where(whole).select("import_id", none.alias("instance"), device.alias("device"), os.alias("os"), none.alias("platform"), F.lit(False).alias("malformed"))
    return out.unionByName(told.where("device IS NOT NULL"))


def producer_identity(markers: DataFrame) -> DataFrame:
    """status and hashed ``producer`` per import, from markers (import_id, instance, device, platform; if known also os, malformed, source, role).

    resolved: exactly one of each, of one system, or one telemetry source and nothing else. ambiguous:
    several, a malformed proof, or systems that disagree. unknown: something is missing.
    """
    given = {c: F.col(c) if c in markers.columns else F.lit(None).cast("string") for c in ("instance", "device", "platform", "os", "source", "role")}
    malformed = F.col("malformed") if "malformed" in markers.columns else F.lit(False)
    rows = markers.select("import_id", *[v.alias(c) for c, v in given.items()], malformed.alias("malformed"))
    device, source = F.struct("os", "device"), F.struct("role", "source")
    several = {"instance": F.col("instance"), "device": F.when(F.col("device").isNotNull(), device), "platform": F.col("platform"), "source": F.when(F.col("source").isNotNull(), source)}
    counted = rows.groupBy("import_id").agg(F.max("malformed").alias("_bad"), F.min("os").alias("_os"), *[F.count_distinct(v).alias(f"_n{c}") for c, v in several.items()], *[F.min(v).alias(c) for c, v in several.items()])
    n = {c: F.col(f"_n{c}") for c in several}
    app = (n["instance"] == 1) & (n["device"] == 1) & (n["platform"] == 1)
    agree = F.coalesce(F.col("_os") == F.col("platform"), F.lit(True))
    status = (
        F.when(F.col("_bad"), "ambiguous")
        .when(n["source"] > 0, F.when((n["source"] == 1) & (n["instance"] == 0) & (n["device"] == 0), "resolved").otherwise("ambiguous"))
        .when(app, F.when(agree, "resolved").otherwise("ambiguous"))
        .when((n["instance"] > 1) | (n["device"] > 1) | (n["platform"] > 1), "ambiguous")
        .otherwise("unknown")
    )
    key = F.when(n["source"] > 0, F.to_json("source")).otherwise(F.to_json(F.array("platform", "instance", "device.device")))
    return counted.select("import_id", status.alias("status"), F.when(status == "resolved", F.sha2(key, 256)).alias("producer"))


def identity_candidates(sip: DataFrame, proofs: int = 5) -> DataFrame:
    """Local parties of REGISTER and INVITE messages with occurrences and the first proofs."""
    local = F.when(F.col("direction") == "outgoing", F.col("caller")).otherwise(F.col("callee"))
    rows = sip.where(F.col("method").isin("REGISTER", "INVITE") & F.col("response").isNull()).withColumn("account", local)
    by = Window.partitionBy("import_id", "account").orderBy("name", "line_no")
    rows = rows.withColumn("_n", F.row_number().over(by))
    proof = F.when(F.col("_n") <= proofs, F.struct("name", "line_no"))
    return rows.groupBy("import_id", "account").agg(F.count("*").alias("occurrences"), F.sort_array(F.collect_list(proof)).alias("proofs"))
