"""Which records an extractor has to read: a bit for each of them, told once a record, by which tables of records are laid out.

A table that is partitioned by ``marks`` gives each extractor the partitions with its bit only, so
that text is read by those that find something in it, however many extractors there are. A mark
may be set where its extractor finds nothing, but is never missing where it finds something.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.archives import base_name
from . import extract as X
from .attempts import APP_LOG
from .messages import SIP_VERSION


def conditions() -> dict[str, Column]:
    """What an extractor needs of a record (name, parser, text), by the extractor's mark."""
    text, parser, base = F.col("text"), F.col("parser"), base_name("name")
    says = lambda *parts: reduce(or_, [text.contains(p) for p in parts])
    low = F.lower(text)
    files = [base.rlike(f) for f in dict.fromkeys(rule[0] for rule in X.CONNECTIVITY)]
    notices = [x.split("{")[0].strip() for _, x, _, _ in X.TRANSIENTS]
    return {
        "rtcp": (parser == "rtcp") & says("RTCP ARRIVED", "RTT by this source"),
        "flow_stats": parser.isin("callinfo", "kpe") & says("call flow metric line", "Info about first media flow finished"),
        "ping": (parser == "callinfo") & says("time="),
        "devices": parser == "vd",
        "gaps": says("Packet loss occurred"),
        "positions": says("Location[", "SIP message:"),
        "config_positions": says(X.EXTRA_HEADERS),
        "networks": says("Current network interface:", "DeviceStatus:"),
        "connectivity": reduce(or_, files) | base.startswith("sip_debug"),
        "transients": says(*notices, "Network", "Creating device") | (says(SIP_VERSION) & says("INVITE ")),
        "switches": says("switchNetworkEvent"),
        "signals": low.contains("buffer underrun") | low.contains("reported that flow"),
        "sip": says("SIP message:"),
        "legs": ((parser == "kpe") & says("call list", "status changed to 1", "removed from list", "call terminated", "Info about call finished on line")) | ((parser == "callinfo") & says("connected line id:", "terminated line id:")),
        "versions": low.contains("version"),
        "info": base == "info.log",
        "producers": base.startswith("sip_debug") | base.startswith("ctilib"),
        "attempts": base == APP_LOG,
    }


#: The marks in the order of their bits.
NAMES = (
    "rtcp", "flow_stats", "ping", "devices", "gaps", "positions", "config_positions", "networks", "connectivity",
    "transients", "switches", "signals", "sip", "legs", "versions", "info", "producers", "attempts",
)


def with_marks(records: DataFrame) -> DataFrame:
    """``records`` with ``marks``, never NULL."""
    holds = conditions()
    bits = [F.when(holds[name], F.lit(1 << n)).otherwise(F.lit(0)) for n, name in enumerate(NAMES)]
    return records.withColumn("marks", reduce(lambda a, b: a.bitwiseOR(b), bits))


def marked(records: DataFrame, *names: str) -> DataFrame:
    """The records with one of the marks, without the column ``marks``."""
    bits = sum(1 << NAMES.index(name) for name in names)
    return records.where(F.col("marks").bitwiseAND(F.lit(bits)) != 0).drop("marks")
