"""Queries of what belongs to which call: open and contested windows, lost logs, repeated archives, copies of evidence; with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calls as C
from ..operators import extract as X
from ..operators import network as K
from . import jobs as Z
from .analysis_queries import BASE_US, SQUEEZED, as_time, cell_sql, events, squeezed
from .core_queries import HOUR
from .log_queries import rendered


def _calls(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Views as calls of some hours on their user's line, in fifty imports; each fortieth is never seen to end."""
    e = events(spark, sf_dir, "view")
    end = F.when(F.col("event_id") % 40 != 1, F.timestamp_add("HOUR", F.lit(hours), F.col("ts")))
    return e.select(F.concat(F.lit("i"), F.col("user_id") % 50).alias("import_id"), F.col("user_id").cast("int").alias("line_id"), F.concat(F.lit("c"), "event_id").alias("call_id"), F.col("event_id").alias("perspective_id"), F.col("ts").alias("start"), end.alias("end"))


def _rows(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    return events(spark, sf_dir, *types).select(F.concat(F.lit("i"), F.col("user_id") % 50).alias("import_id"), F.col("user_id").cast("int").alias("line_id"), "event_id", "ts")


def c4_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of events: by Call-ID, by the only window of their line, open ones among them, and of files of call information without a line by the only ended window of their import."""
    rows = _rows(spark, sf_dir).withColumn("parser", F.when(F.col("event_id") % 7 == 0, "callinfo").otherwise("kpe"))
    rows = rows.withColumns({"line_id": F.when(F.col("parser") == "kpe", F.col("line_id")), "call_id": F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("c"), "event_id"))})
    return C.attribute_events(rows, _calls(spark, sf_dir)).select("event_id", "owner")


def c1_callinfo_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks connect and purchases terminate a user's line in files of call information; views are the legs that engine logs have."""
    legs = _calls(spark, sf_dir, 24).where("line_id % 3 > 0")
    event = F.when(F.col("event_type") == "click", "connected").otherwise("terminated")
    e = events(spark, sf_dir, "click", "purchase")
    said = e.select(F.concat(F.lit("i"), F.col("user_id") % 50).alias("import_id"), F.col("user_id").cast("int").alias("line_id"), "ts", F.col("event_id").alias("ord"), event.alias("event"))
    return C.callinfo_legs(said, legs).select("line_id", "start", "end")


def c1_leg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of users' lines row by row: views add, clicks connect, purchases end, errors sum up (every second one without a Call-ID, which says nothing)."""
    e = events(spark, sf_dir, "view", "click", "purchase", "error")
    event = F.when(F.col("event_type") == "view", "added").when(F.col("event_type") == "click", "connected").when(F.col("event_type") == "purchase", "ended").otherwise("summary")
    call = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("c"), "event_id"))
    life = e.select(F.lit("i").alias("import_id"), F.col("user_id").cast("int").alias("line_id"), "ts", F.col("event_id").alias("ord"), event.alias("event"), call.alias("call_id"))
    return C.reconstruct_legs(life).where("leg IS NOT NULL").select("line_id", F.col("leg").cast("long").alias("leg"), "start", "end", "call_id", "incomplete")


def c3_local_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as legs without a Call-ID: lines that ring on the same day are calls of their own, as are two legs of one line."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    legs = o.select(F.concat(F.lit("i"), F.col("o_orderkey") % 3).alias("import_id"), F.lit(None).cast("string").alias("call_id"), (F.col("o_custkey") % 7).cast("int").alias("line_id"), (F.col("o_orderkey") % 5).alias("leg"), day.alias("start"), day.alias("end"), day.alias("connected"))
    parts = F.split("call_key", ":")
    return C.build_calls(legs).select(parts[1].alias("import_id"), parts[2].cast("int").alias("line_id"), parts[3].cast("long").alias("leg"), "start", "perspectives")


def c11_known_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of an appended archive that stand in the window of a known call (every third) and in none of a new one are left out."""
    calls = _calls(spark, sf_dir)
    known = F.col("perspective_id") % 3 == 0
    return C.drop_known_rows(_rows(spark, sf_dir, "click"), calls.where(known), calls.where(~known), "event_id").select("event_id")


def c11_known_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of known calls go, but for blocks that speak of devices of another line, too; those lose their owner."""
    e = events(spark, sf_dir)
    other = F.when(F.col("event_id") % 4 == 0, F.format_string("\nDevice name: NART0 of Line %d", F.col("user_id") + 1)).otherwise("")
    own = F.when(F.col("event_id") % 3 > 0, F.format_string("\nDevice name: NAWT1 of Line %d", F.col("user_id"))).otherwise("")
    owned = e.select("event_id", F.col("user_id").cast("int").alias("line_id"), (F.col("user_id") % 9).alias("owner"), F.concat(F.lit("block"), own, other).alias("text"))
    skipped = e.where("user_id % 9 < 4").select((F.col("user_id") % 9).alias("perspective_id")).distinct()
    skipped = owned.join(skipped, owned["owner"] == skipped["perspective_id"]).groupBy("perspective_id").agg(F.min("line_id").alias("line_id"))
    return C.drop_known_events(owned, skipped).select("event_id", "owner")


def x11_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of heartbeats: the device that is alive is in scope, and a reader of the default input only by a writer's line."""
    device = "CASE event_id % 3 WHEN 0 THEN 'NART' WHEN 1 THEN 'NAWT' ELSE 'VOD' END"
    alive = rendered(spark, sf_dir, "vdlog", "vd", "[t] [reader] VD %d ( %s%d of Line %d ) is alive and kicking\nAudio currently in buffer (ms): %d", "event_id", device, "event_id % 4", "user_id % 6", "event_id % 100").where("line_no % 2 = 0")
    form = "[t] [reader] READING Virtual Output Device Running Info\nDevice name: %s%d of Line %d\nCONNECTED INPUT DEVICE\nDevice name: Default Audio Input\nAudio currently in buffer (ms): %d"
    read_ = rendered(spark, sf_dir, "vdlog", "vd", form, device, "event_id % 4", "user_id % 6", "event_id % 100").where("line_no % 2 = 1")
    out = X.extract_periodic(alive.unionByName(read_)).where("metric = 'vd.buffer'")
    return out.select(F.col("line_no").alias("event_id"), "line_id", "flow", "direction", "value")


def j10_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as requests (every tenth names its states): several states at a time, or an unknown one, near a request leave it without a transition."""
    asked = events(spark, sf_dir, "error").select("user_id", "ts", F.col("event_id").alias("request_id"), *[F.when(F.col("event_id") % 10 == 0, F.lit(x)).alias(c) for c, x in (("previous", "a"), ("next", "b"))])
    e = events(spark, sf_dir, "click", "view")
    one = e.select("user_id", "ts", F.when(F.col("event_id") % 12 == 0, "unknown").otherwise(F.floor(F.col("value") / 20).cast("string")).alias("state"))
    two = e.where("event_id % 6 = 1").select("user_id", "ts", F.floor(F.col("value") / 10).cast("string").alias("state"))
    return K.nearby_transition(asked, one.unionByName(two), ["user_id"], 12 * HOUR, 18 * HOUR).select("request_id", "from_state", "to_state")


def z5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases' intervals in two imports of their users: copies count once, those with two scores not at all, at fresh fixes and at fresh and declared ones."""
    q = squeezed(spark, sf_dir)
    each = lambda df: df.unionByName(df.withColumn("import_id", F.concat(F.lit("b"), F.col("user_id"))))
    here = q.withColumns({"import_id": F.concat(F.lit("a"), "user_id"), "call_id": F.concat(F.lit("c"), "user_id")})
    spans = each(here.where("event_type = 'purchase'").select("user_id", "import_id", "call_id", F.col("call_id").alias("call_key"), F.col("event_id").alias("text"), F.lit("wifi").alias("access"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(90), F.col("ts")).alias("end")))
    spans = spans.withColumn("mos", F.when(F.col("import_id").startswith("b") & (F.col("text") % 5 == 0), 3.0).otherwise(4.0)).drop("user_id")
    fixes = each(here.where("event_type IN ('view', 'click')").select("user_id", "import_id", "call_id", "ts", F.when(F.col("event_type") == "view", "fresh").otherwise("sip_local").alias("kind"), (F.col("event_id") % 50).cast("double").alias("latitude"), (F.col("user_id") % 50).cast("double").alias("longitude"), F.lit(5.0).alias("accuracy"), F.lit(True).alias("valid"))).drop("user_id")
    out = Z.geo_report(spans, fixes, 100_000.0, ["access"])
    return out["cells"].select("quality", "cell", F.round("seconds", 3).alias("seconds"), F.round("mean", 6).alias("mean"))


def z10_switch_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with two copies each, some with explicit states, between fixes of their import: one row a request, with its place."""
    said = "CASE WHEN event_type = 'error' THEN concat('[t] [KPECORE] [INFO] KPE was requested to handle a switchNetworkEvent', CASE WHEN event_id % 3 = 0 THEN ' from wifi to lte' ELSE '' END) ELSE concat('x : Current network interface: ', CASE WHEN event_id % 2 = 0 THEN 'wifi' ELSE 'cellular' END) END"
    r = rendered(spark, sf_dir, "kpelog", "kpe", "%s", said).withColumns({"import_id": F.col("name"), "ts": S.from_micros(F.floor((S.micros("ts") - BASE_US) / 5000) + BASE_US)})
    r = r.unionByName(r.withColumn("name", F.concat("name", F.lit(".1"))))
    fixes = events(spark, sf_dir, "purchase").select(F.concat(F.lit("kpelog"), "user_id").alias("import_id"), S.from_micros(F.floor((S.micros("ts") - BASE_US) / 5000) + BASE_US).alias("ts"), (45 + F.col("event_id") % 100 / 100).alias("latitude"), F.lit(9.0).alias("longitude"), F.lit(5.0).alias("accuracy"), F.lit(True).alias("valid"))
    w = r.limit(0).select("import_id", F.col("line_no").alias("perspective_id"), F.lit("c").alias("call_id"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    out = Z.switch_report(r, w, fixes)
    return out.select(F.col("line_no").alias("event_id"), "proofs", "from_state", "to_state", F.round("latitude", 6).alias("latitude"))


CALLS = "c AS (SELECT event_id AS pid, user_id AS u, user_id % 50 AS i, ts AS a, CASE WHEN event_id % 40 <> 1 THEN ts + INTERVAL {hours} HOUR END AS b FROM events WHERE event_type = 'view')"
SIX = CALLS.format(hours=6)
PERIODIC = "event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 3 < 2 ELSE event_id % 3 = 1 END AS known"

ORACLE: dict[str, str] = {
    "c4_open_windows": f"""WITH {SIX}, l AS (SELECT e.event_id, any_value(c.pid) AS pid FROM events e JOIN c ON c.u = e.user_id AND e.ts >= c.a AND (c.b IS NULL OR e.ts <= c.b + INTERVAL 250 MILLISECOND) WHERE e.event_id % 7 > 0 GROUP BY e.event_id HAVING count(*) = 1),
        w AS (SELECT e.event_id, any_value(c.pid) AS pid FROM events e JOIN c ON c.i = e.user_id % 50 AND e.ts >= c.a AND e.ts <= c.b WHERE e.event_id % 7 = 0 GROUP BY e.event_id HAVING count(*) = 1)
        SELECT e.event_id, coalesce(x.pid, l.pid, w.pid) AS owner FROM events e LEFT JOIN c x ON x.pid = e.event_id AND e.event_id % 11 = 0 LEFT JOIN l ON l.event_id = e.event_id LEFT JOIN w ON w.event_id = e.event_id""",
    "c1_callinfo_legs": f"""WITH {CALLS.format(hours=24)}, s AS (SELECT event_id, user_id AS u, ts, event_type = 'purchase' AS z FROM events WHERE event_type IN ('click', 'purchase')),
        k AS (SELECT * FROM s WHERE z OR NOT EXISTS (SELECT 1 FROM c WHERE c.u % 3 > 0 AND c.u = s.u AND s.ts >= c.a AND (c.b IS NULL OR s.ts <= c.b))),
        r AS (SELECT *, coalesce(sum(CASE WHEN z THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k)
        SELECT CAST(u AS INTEGER) AS line_id, min(ts) FILTER (WHERE NOT z) AS start, max(ts) FILTER (WHERE z) AS "end" FROM r GROUP BY u, run HAVING count(*) FILTER (WHERE NOT z) > 0""",
    "c1_leg_rows": """WITH e AS (SELECT user_id AS u, ts, event_id, event_type AS t, CASE WHEN event_type = 'error' THEN 'c' || event_id END AS cid FROM events WHERE event_type IN ('view', 'click', 'purchase') OR (event_type = 'error' AND event_id % 2 = 0)),
        g AS (SELECT *, sum(CASE WHEN t = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY ts, event_id) AS leg FROM e),
        f AS (SELECT *, min(CASE WHEN t = 'error' THEN ts END) OVER (PARTITION BY u, leg) AS done FROM g WHERE leg > 0),
        l AS (SELECT u, leg, min(ts) AS a, max(CASE WHEN t IN ('purchase', 'error') THEN ts END) AS b, max(cid) AS cid FROM f WHERE done IS NULL OR ts <= done GROUP BY u, leg),
        n AS (SELECT *, lead(a) OVER (PARTITION BY u ORDER BY leg) AS na FROM l)
        SELECT CAST(u AS INTEGER) AS line_id, CAST(leg AS BIGINT) AS leg, a AS start, coalesce(b, na) AS "end", cid AS call_id, b IS NULL AND na IS NOT NULL AS incomplete FROM n""",
    "c3_local_calls": """SELECT 'i' || o_orderkey % 3 AS import_id, CAST(o_custkey % 7 AS INTEGER) AS line_id, o_orderkey % 5 AS leg, CAST(o_orderdate AS TIMESTAMP) AS start, count(*) AS perspectives FROM orders GROUP BY ALL""",
    "c11_known_rows": f"""WITH {SIX}, h AS (SELECT e.event_id, c.pid % 3 = 0 AS known FROM events e JOIN c ON c.u = e.user_id AND e.ts >= c.a AND (c.b IS NULL OR e.ts <= c.b + INTERVAL 250 MILLISECOND) WHERE e.event_type = 'click')
        SELECT event_id FROM events WHERE event_type = 'click' AND (event_id NOT IN (SELECT event_id FROM h WHERE known) OR event_id IN (SELECT event_id FROM h WHERE NOT known))""",
    "c11_known_events": """WITH s AS (SELECT user_id % 9 AS o, min(user_id) AS line FROM events WHERE user_id % 9 < 4 GROUP BY ALL),
        e AS (SELECT event_id, user_id % 9 AS o, CASE WHEN event_id % 3 > 0 THEN user_id END AS x, CASE WHEN event_id % 4 = 0 THEN user_id + 1 END AS y FROM events),
        j AS (SELECT e.*, line FROM e LEFT JOIN s USING (o))
        SELECT event_id, CASE WHEN line IS NULL THEN o END AS owner FROM j WHERE line IS NULL OR NOT ((x IS NULL AND y IS NULL) OR (x IS NULL AND y = line) OR (y IS NULL AND x = line))""",
    "x11_heartbeats": f"""WITH k AS (SELECT user_id, {PERIODIC} FROM events)
        SELECT event_id, CASE WHEN known THEN CAST(user_id % 6 AS INTEGER) END AS line_id, CASE WHEN known THEN CAST(event_id % 4 AS VARCHAR) ELSE '?' END AS flow,
        CASE WHEN event_id % 3 = 1 THEN 'outgoing' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'incoming' ELSE 'unknown' END AS direction, CAST(event_id % 100 AS DOUBLE) AS value FROM k""",
    "j10_contested": f"""WITH r AS (SELECT user_id AS u, ts, event_id AS id FROM events WHERE event_type = 'error'),
        a AS (SELECT user_id AS u, ts, CASE WHEN event_id % 12 = 0 THEN 'unknown' ELSE CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) END AS state FROM events WHERE event_type IN ('click', 'view')
              UNION ALL SELECT user_id, ts, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) FROM events WHERE event_type IN ('click', 'view') AND event_id % 6 = 1),
        s AS (SELECT u, ts, min(state) AS state, min(state) = max(state) AND min(state) <> 'unknown' AS ok FROM a GROUP BY u, ts),
        c AS (SELECT r.id, count(DISTINCT o.ts) AS n FROM r JOIN r o ON r.u = o.u AND abs(epoch_us(r.ts) - epoch_us(o.ts)) <= {18 * HOUR} GROUP BY r.id),
        m AS (SELECT r.id, s.ts, s.state, s.ok, lag(s.state) OVER (PARTITION BY r.id ORDER BY s.ts) AS p FROM r JOIN s ON r.u = s.u AND abs(epoch_us(r.ts) - epoch_us(s.ts)) <= {12 * HOUR}),
        k AS (SELECT id, arg_min(state, ts) FILTER (WHERE p IS DISTINCT FROM state) AS a, arg_max(state, ts) FILTER (WHERE p IS DISTINCT FROM state) AS b FROM m GROUP BY id HAVING bool_and(ok) AND count(*) FILTER (WHERE p IS DISTINCT FROM state) = 2)
        SELECT r.id AS request_id, CASE WHEN r.id % 10 = 0 THEN 'a' WHEN n = 1 THEN a END AS from_state, CASE WHEN r.id % 10 = 0 THEN 'b' WHEN n = 1 THEN b END AS to_state FROM r JOIN c USING (id) LEFT JOIN k USING (id)""",
    "z5_copies": f"""WITH {SQUEEZED}, f AS (SELECT k.quality, user_id, t, (event_id % 50)::DOUBLE AS lat, (user_id % 50)::DOUBLE AS lon, least(t + 120000000, coalesce(lead(t) OVER (PARTITION BY k.quality, user_id ORDER BY t), t + 120000000)) AS z
              FROM q, (VALUES ('fresh'), ('declared')) k(quality) WHERE event_type = 'view' OR (event_type = 'click' AND k.quality = 'declared'))
        SELECT quality, {cell_sql("lat", "lon", 100000.0)} AS cell, round(sum(least(p.t + 90000000, f.z) - greatest(p.t, f.t)) / 1e6, 3) AS seconds, 4.0::DOUBLE AS mean FROM q p JOIN f ON f.user_id = p.user_id AND f.t < p.t + 90000000 AND f.z > p.t WHERE p.event_type = 'purchase' AND p.event_id % 5 > 0 GROUP BY ALL""",
    "z10_switch_places": f"""WITH e AS (SELECT user_id AS u, event_id, event_type, event_id % 3 = 0 AS named, CASE WHEN event_id % 2 = 0 THEN 'wifi' ELSE 'cellular' END AS state, CAST(floor((epoch_us(ts) - {BASE_US}) / 5000.0) AS BIGINT) + {BASE_US} AS t FROM events),
        r AS (SELECT u, t, named, min(event_id) AS event_id, 2 * count(*) AS proofs FROM e WHERE event_type = 'error' GROUP BY u, t, named),
        c AS (SELECT a.event_id, count(DISTINCT b.t) AS n FROM r a JOIN r b ON a.u = b.u AND abs(a.t - b.t) <= 6000000 GROUP BY a.event_id),
        s AS (SELECT u, t, min(state) AS state, min(state) = max(state) AS ok FROM e WHERE event_type <> 'error' GROUP BY u, t),
        m AS (SELECT a.event_id, s.t, s.state, s.ok, lag(s.state) OVER (PARTITION BY a.event_id ORDER BY s.t) AS p FROM r a JOIN s ON a.u = s.u AND abs(a.t - s.t) <= 3000000),
        k AS (SELECT event_id, arg_min(state, t) FILTER (WHERE p IS DISTINCT FROM state) AS x, arg_max(state, t) FILTER (WHERE p IS DISTINCT FROM state) AS y FROM m GROUP BY event_id HAVING bool_and(ok) AND count(*) FILTER (WHERE p IS DISTINCT FROM state) = 2),
        f AS (SELECT u, t, min(45 + event_id % 100 / 100) AS lat, count(DISTINCT event_id % 100) = 1 AS ok FROM e WHERE event_type = 'purchase' GROUP BY u, t),
        b AS (SELECT r.event_id, r.t, arg_max(struct_pack(t := f.t, lat := f.lat, ok := f.ok), f.t) FILTER (WHERE f.t <= r.t) AS lo, arg_min(struct_pack(t := f.t, lat := f.lat, ok := f.ok), f.t) FILTER (WHERE f.t >= r.t) AS hi FROM r JOIN f ON f.u = r.u GROUP BY ALL)
        SELECT r.event_id, r.proofs, CASE WHEN r.named THEN 'wifi' WHEN n = 1 THEN x END AS from_state, CASE WHEN r.named THEN 'lte' WHEN n = 1 THEN y END AS to_state,
               round(CASE WHEN lo.ok AND hi.ok AND hi.t - lo.t <= 120000000 THEN lo.lat + (hi.lat - lo.lat) * CASE WHEN hi.t = lo.t THEN 0 ELSE (r.t - lo.t) / (hi.t - lo.t) END END, 6) AS latitude
        FROM r JOIN c USING (event_id) LEFT JOIN k USING (event_id) LEFT JOIN b ON b.event_id = r.event_id""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE}
