"""The dictionary of metrics: what extractors and reports make, by unit, kind and meaning. Names of device metrics come from the extractors' own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import metric_domain, metric_orientation
from ..operators.extract import DEVICE_FIELDS, PERIODIC_FIELDS, PERIODIC_SENTENCES

# Fixed values: (metric, unit, kind, meaning).
METRICS = [
    ("rtcp.loss", "%", "sample", "packets lost between two reports"),
    ("rtcp.jitter", "ms", "sample", "interarrival jitter"),
    ("rtcp.rtt", "ms", "sample", "round trip time of a source"),
    ("rtcp.packets_received", "packets", "counter", "packets of a source that came so far"),
    ("rtcp.packets_received_interval", "packets", "interval", "packets of a source that came since the last report"),
    ("rtcp.packets_sent_total", "packets", "counter", "packets that the peer says it sent so far"),
    ("rtcp.packets_sent_interval", "packets", "interval", "packets that the peer says it sent since its last report"),
    ("rtcp.packets_lost_total", "packets", "counter", "packets that the peer says it missed so far"),
    ("rtcp.packets_lost_interval", "packets", "interval", "packets that the peer says it missed since its last report"),
    ("network.ping", "ms", "sample", "echo time of a probe, whose target may be another than the media's"),
    ("vd.missing_packets", "packets", "event", "gap in sequence numbers; not final loss"),
    ("telemetry.network_loss", "%", "interval", "loss of a verified window or between two consecutive reports"),
    ("derived.mos_reference", "MOS", "derived step", "score of a fixed profile by loss alone, held until it expires"),
    ("derived.perceptual_quality", "index", "derived step", "continuity of audio from the network's reader to the device, 0 to 100"),
    ("derived.silence_delta", "ms", "interval", "silence left out between two neighbouring samples"),
    ("derived.silence_played_delta", "ms", "interval", "silence played for underruns between two neighbouring samples"),
    ("derived.buffer_sum", "ms", "derived gauge", "audio in the buffers of both sides on one clock"),
    ("derived.dejitter_sum", "ms", "derived gauge", "targets of the jitter buffers of both sides on one clock"),
    ("incident.buffer_underrun", "ms", "episode", "how long a device's buffer was empty"),
    ("incident.media_missing", "ms", "episode", "how long a flow had no media; a lower bound"),
]
# Groups and names of the engine's statistics of a flow.
ENGINE = {"audio": ("dtmf_rtt", "jitter", "jitter_rfc3550", "ploss_jitter"), "common": ("ploss", "rtt", "rtp_pkt_rx", "rtp_pkt_tx")}
# Phases of a device's running cycles.
PHASES = ("tbody_runs", "read", "decode", "adapttomw", "append", "readfrommw", "adapttocodec", "encode", "write")
COLUMNS = "metric string, unit string, kind string, meaning string"


def entries() -> list[tuple[str, str, str, str]]:
    """(metric, unit, kind, meaning) of every metric, once, in order of its name; values in microseconds are kept in milliseconds."""
    found = {m: (m, u, k, text) for m, u, k, text in METRICS}
    declared = [(m, u, k, said[0].replace("{n}", "").strip(" :")) for m, said, u, k in DEVICE_FIELDS]
    declared += [(f"vd.{m}", u, k, label) for label, m, u, k in PERIODIC_FIELDS]
    declared += [(f"vd.{m}", u, k, said.replace("{n}", "…")) for said, m, u, k in PERIODIC_SENTENCES]
    declared += [(f"vd.cycles_{p}", "count", "counter / reported statistic", f"cycles of the phase {p}; of a heartbeat in its window") for p in PHASES]
    declared += [(f"kpe.{g}.{n}", "packets" if n.startswith("rtp_pkt") else "raw", "reported statistic", f"the engine's {n}; what it means isn't confirmed") for g, names in ENGINE.items() for n in names]
    for m, u, k, text in declared:
        found.setdefault(m, (m, "ms" if u == "us" else u, k, text))
    return sorted(found.values())


def dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary with each metric's domain and the rule of its direction."""
    known = spark.createDataFrame(entries(), COLUMNS)
    return known.withColumns({"domain": metric_domain("metric"), "rule": metric_orientation("metric")})
