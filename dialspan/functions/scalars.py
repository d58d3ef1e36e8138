"""Expressions over columns: scores, cells, distances, units and calendar keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_195.08


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone (no zone is inferred)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_add("MICROSECOND", col(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def mos_score(loss: Column | str) -> Column:
    """Score of a loss percentage; NULL unless it is a number from 0 to 100. No loss gives 4.409285824."""
    loss = col(loss).cast("double")
    rating = F.least(F.greatest(F.lit(93.2) - F.lit(95.0) * loss / (loss + 25.1), F.lit(0.0)), F.lit(100.0))
    score = 1 + 0.035 * rating + 7e-6 * rating * (rating - 60) * (100 - rating)
    return F.when(~F.isnan(loss) & loss.between(0, 100), score)


def grid_cell(lat: Column | str, lon: Column | str, metres: float) -> Column:
    """``band:column`` of the cell of about ``metres`` that holds a position; columns widen towards the poles."""
    lat, lon = col(lat), col(lon)
    band = F.floor(lat / (metres / DEGREE_M))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat_ws(":", band.cast("string"), F.floor(lon / _width(band, metres)).cast("string")))


def _width(band: Column, metres: float) -> Column:
    step = metres / DEGREE_M
    centre = F.greatest(F.least((band + 0.5) * step, F.lit(89.9)), F.lit(-89.9))
    return F.lit(step) / F.cos(F.radians(centre))


def grid_bounds(cell: Column | str, metres: float) -> Column:
    """STRUCT<west, south, east, north> of a cell; NULL for what is no cell."""
    cell = col(cell)
    band, column = (F.split(cell, ":")[i].cast("long") for i in (0, 1))
    step = metres / DEGREE_M
    made = F.struct((column * _width(band, metres)).alias("west"), (band * step).alias("south"), ((column + 1) * _width(band, metres)).alias("east"), ((band + 1) * step).alias("north"))
    return F.when(cell.rlike(r"^-?\d{1,9}:-?\d{1,9}$"), made)


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def lon_arc(start: Column | str, end: Column | str) -> Column:
    """Degrees from one longitude to another the shorter way, -180 up to 180."""
    return F.pmod(col(end) - col(start) + 180, F.lit(360.0)) - 180


# Words for units of time, in milliseconds.
DURATION_UNITS = {
    "us": 0.001, "usec": 0.001, "usecs": 0.001, "µs": 0.001, "microsecond": 0.001, "microseconds": 0.001,
    "ms": 1.0, "msec": 1.0, "msecs": 1.0, "millisecond": 1.0, "milliseconds": 1.0,
    "s": 1000.0, "sec": 1000.0, "secs": 1000.0, "second": 1000.0, "seconds": 1000.0,
}


def mapped(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def duration_ms(value: Column | str, unit: Column | str) -> Column:
    """Milliseconds; NULL for an unknown unit."""
    return col(value).try_cast("double") * mapped(DURATION_UNITS, F.lower(F.trim(col(unit))))


def elapsed_seconds(text: Column | str) -> Column:
    """Seconds of parts like ``+1d2h3m4s5ms`` (in any order, repeated ones added up, the sign optional); NULL for other text."""
    text = col(text)
    units = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:ms|[dhms]))"), 1)
    seconds = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("double") * mapped(units, F.regexp_extract(p, r"([a-z]+)$", 1))
    return F.when(text.rlike(r"^\+?(?:\d+(?:ms|[dhms]))+$"), F.aggregate(parts, F.lit(0.0), lambda total, p: total + seconds(p)))


# Names of accesses as they are logged.
ACCESS = {
    "wifi": "wifi", "wi-fi": "wifi", "wlan": "wifi", "cellular": "cellular", "mobile": "cellular", "lte": "cellular", "nr": "cellular",
    "4g": "cellular", "5g": "cellular", "3g": "cellular", "ethernet": "ethernet", "wired": "ethernet", "none": "none",
}


def network_state(text: Column | str) -> Column:
    """The access that a logged name means; NULL for an unknown one."""
    return mapped(ACCESS, F.lower(F.trim(col(text))))


def series_key(*parts: Column | str) -> Column:
    """24 hexadecimal digits for an identity tuple; NULL and empty text differ."""
    texts = F.array(*[F.coalesce(col(p).cast("string"), F.lit("\x00")) for p in parts])
    return F.substring(F.sha2(F.to_json(texts), 256), 1, 24)


COUNT_UNITS = ("packets", "count", "frames", "samples", "bytes", "events")


def metric_valid(value: Column | str, unit: Column | str) -> Column:
    """Whether a value may have its unit: never negative or infinite, percentages up to 100, whole counts."""
    value, unit = col(value).cast("double"), col(unit)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return finite & (value >= 0) & ((unit != "%") | (value <= 100)) & (~unit.isin(*COUNT_UNITS) | (value == F.floor(value)))


def apply_clock_offset(ts: Column | str, seconds: Column | str) -> Column:
    """A time for display; offsets over a day count as none."""
    seconds = col(seconds).cast("double")
    usable = F.when(F.abs(seconds) <= 86_400, seconds).otherwise(0.0)
    return F.timestamp_add("MICROSECOND", F.round(usable * 1e6).cast("long"), col(ts))


def calendar_keys(ts: Column | str) -> dict[str, Column]:
    """Week (its Monday), hour, weekday (Monday 0), hour of the week, day, month and year."""
    ts = col(ts)
    return {
        "week": F.date_trunc("week", ts).cast("date"),
        "hour": F.hour(ts),
        "weekday": F.weekday(ts),
        "week_hour": F.weekday(ts) * 24 + F.hour(ts),
        "day": ts.cast("date"),
        "month": F.month(ts),
        "year": F.year(ts),
    }


def csv_safe(text: Column | str) -> Column:
    """Text that a spreadsheet doesn't take for a formula."""
    text = col(text)
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def first_json(line: Column | str) -> Column:
    """The text from the first opening brace to the last closing one."""
    return F.nullif(F.regexp_extract(col(line), r"(?s)(\{.*\})", 1), F.lit(""))


# Domains of metrics by their names: equal to, beginning with, or holding one of these.
# A beginning may follow ``vd.``. The first line that fits counts.
METRIC_DOMAINS = [
    ("scheduling", {"is": ["heartbeat_window"], "begins": ["cycles_"], "holds": ["scheduling"]}),
    ("rtp_transport", {"is": ["missing_packets", "max_arrival_delay", "telemetry.network_loss", "incident.media_missing"], "begins": ["rtcp.", "packets_", "streak_"]}),
    ("quality_model", {"is": ["derived.mos_reference", "derived.perceptual_quality"], "begins": ["mos."]}),
    ("network_probe", {"is": ["network.ping"]}),
    ("buffer_media", {"holds": ["buffer", "silence", "underrun", "dejitter", "samples_skipped"]}),
]
# What a metric says about the direction of the media.
METRIC_ORIENTATIONS = {
    "awt_quality": ["derived.perceptual_quality"],
    "roundtrip": ["rtcp.rtt"],
    "probe": ["network.ping"],
    "combined": ["derived.buffer_sum", "derived.dejitter_sum"],
    "receiver_report": ["rtcp.jitter", "rtcp.loss"],
    "model": ["derived.mos_reference"],
    "verified_loss": ["telemetry.network_loss"],
    "local_packets": ["rtcp.packets_received", "rtcp.packets_received_interval"],
    "peer_sent": ["rtcp.packets_sent_total", "rtcp.packets_sent_interval"],
    "peer_lost": ["rtcp.packets_lost_total", "rtcp.packets_lost_interval"],
    "rtp_receive": ["vd.missing_packets", "vd.max_arrival_delay", "incident.media_missing"],
    "device": ["derived.silence_delta", "derived.silence_played_delta", "incident.buffer_underrun"],
}


def metric_domain(name: Column | str) -> Column:
    """The part of the media path that a metric describes; processing for other device metrics, unspecified for unknown names."""
    name = col(name)
    key = F.regexp_replace(name, r"^vd\.", "")
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for domain, rule in METRIC_DOMAINS:
        tests = [name.isin(*rule["is"]) | key.isin(*rule["is"])] if "is" in rule else []
        tests += [key.startswith(x) for x in rule.get("begins", [])] + [name.contains(x) for x in rule.get("holds", [])]
        out = out.when(reduce(Column.__or__, tests), domain)
    return out.when(name.startswith("vd."), "processing").otherwise("unspecified")


def metric_orientation(name: Column | str) -> Column:
    """How a metric's direction is to be read; a device's own measure for other device metrics, unconfirmed for unknown names."""
    name = col(name)
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for rule, names in METRIC_ORIENTATIONS.items():
        out = out.when(name.isin(*names), rule)
    return out.when(name.startswith("vd."), "device").otherwise("unconfirmed")


# Who receives what a rule of orientation measures.
MEASURED_SIDE = {
    "awt_quality": "local", "local_packets": "local", "rtp_receive": "local", "peer_sent": "local", "peer_lost": "peer",
    "roundtrip": "both", "probe": "both", "combined": "both", "unconfirmed": "none",
    "receiver_report": "reported", "model": "reported", "verified_loss": "reported", "device": "device",
}
# Categories of what the local side and the peer receive, and of what is sent, by role.
SIDE_CATEGORIES = {
    "app": {"local": "downstream", "peer": "upstream", "sent": "upstream"},
    "gw": {"local": "upstream", "peer": "downstream", "sent": "downstream"},
}
SIDE_UNDECLARED = {"local": "local", "peer": "peer", "sent": "transmit"}


def network_device(name: Column, kind: str) -> Column:
    """Whether a device is the network's reader (NART) or writer (NAWT), of a line or not; never NULL."""
    return F.coalesce(name.rlike(rf"(?i)^{kind}(?:\d+ of Line \d+)?\z"), F.lit(False))


def metric_context(name: Column | str, direction: Column | str, role: Column | str, device: Column | str | None = None, output_device: Column | str | None = None, input_device: Column | str | None = None) -> Column:
    """What a metric measures as the app sees it: a struct of category, basis and rule; NULL for a metric without a name.

    Categories: downstream and upstream for an app or a gateway (``gw``); local, peer and transmit for
    another or no role; bidirectional; processing for devices of both ways or of none known; unknown where
    neither the metric nor its direction says. The way of a device's measure is that of the network
    reader or writer that it belongs to, and its reported direction only where it names no device.
    """
    name, direction, role = col(name), col(direction), col(role)
    given = [F.nullif(col(d), F.lit("")) if d is not None else F.lit(None).cast("string") for d in (device, output_device, input_device)]
    rule = metric_orientation(name)
    measured = F.coalesce(given[0], given[2])
    reads, writes = network_device(measured, "NART"), network_device(measured, "NAWT") | network_device(given[1], "NAWT")
    named = F.coalesce(*given).isNotNull()
    side = mapped(MEASURED_SIDE, rule)
    of_device = F.when(reads & writes, "processing").when(reads, "local").when(writes, "sent").when(named, "processing").when(direction == "incoming", "local").when(direction == "outgoing", "sent").otherwise("processing")
    reported = F.when(direction == "incoming", "local").when(direction == "outgoing", "peer").otherwise("none")
    way = F.when(side == "device", of_device).when(side == "reported", reported).otherwise(side)
    category = F.when(way == "both", "bidirectional").when(way == "none", "unknown").when(way == "processing", "processing")
    for declared, names in SIDE_CATEGORIES.items():
        category = category.when(role == declared, mapped(names, way))
    # a peer's own count of what it sent is no reception of anyone whose role isn't known
    category = category.when(rule == "peer_sent", "peer").otherwise(mapped(SIDE_UNDECLARED, way))
    basis = F.when(side != "device", "metric_field").when(named, "device_context").otherwise("reported_direction")
    return F.when(name.isNotNull(), F.struct(category.alias("category"), basis.alias("basis"), rule.alias("rule")))


def orientation(direction: Column | str, role: Column | str) -> Column:
    """upstream or downstream as the app sees it; a gateway sees it the other way round."""
    direction, role = F.lower(col(direction)), F.lower(F.coalesce(col(role), F.lit("app")))
    app = F.when(direction == "incoming", "downstream").when(direction == "outgoing", "upstream")
    gateway = F.when(direction == "incoming", "upstream").when(direction == "outgoing", "downstream")
    return F.when(role.isin("gw", "xcoder", "gateway"), gateway).when(role == "app", app)


# Labels of units.
UNIT_LABELS = {"%": "percent", "ms": "milliseconds", "s": "seconds", "packets": "packets", "bytes": "bytes", "raw": "raw value", "count": "count", "dB": "decibels"}


def unit_label(unit: Column | str) -> Column:
    return F.coalesce(mapped(UNIT_LABELS, col(unit)), col(unit))


def register_sql_functions(spark: SparkSession) -> None:
    """mos_score and grid_cell (of 200 m) for SQL text."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION mos_score(loss DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN NOT isnan(loss) AND loss BETWEEN 0 AND 100 THEN
        1 + 0.035 * least(greatest(93.2 - 95.0D * loss / (loss + 25.1D), 0), 100)
        + 7e-6 * least(greatest(93.2D - 95.0D * loss / (loss + 25.1D), 0), 100)
        * (least(greatest(93.2D - 95.0D * loss / (loss + 25.1D), 0), 100) - 60)
        * (100 - least(greatest(93.2D - 95.0D * loss / (loss + 25.1D), 0), 100)) END""")
    band = f"floor(lat / (200 / {DEGREE_M}D))"
    centre = f"greatest(least(({band} + 0.5D) * (200 / {DEGREE_M}D), 89.9D), -89.9D)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION grid_cell(lat DOUBLE, lon DOUBLE) RETURNS STRING RETURN
        CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN
        concat_ws(':', cast({band} AS STRING), cast(floor(lon / ((200 / {DEGREE_M}D) / cos(radians({centre})))) AS STRING)) END""")
