"""Queries of references in time, reused numbers and two measures on one calendar; with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import network as K
from ..operators import telemetry as T
from . import jobs as Z
from . import reports as R
from .analysis_queries import as_time, events
from .core_queries import HOUR

NAMES = ["request", "plan", "position", "config"]


def _domain(df: DataFrame) -> DataFrame:
    return df.withColumns({"source_id": (F.col("user_id") % 5).cast("string"), "session_id": F.lit("x"), "boot_id": F.lit("b"), "mono_ms": F.unix_micros(F.col("ts").cast("timestamp")) / 1000})


def _ref() -> Column:
    return F.concat(F.lit("r"), F.floor(F.col("value")) % 40)


def i17_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and errors declare requests, plans, positions and configurations; clicks and purchases refer to them, each to two of a kind that its number names."""
    kind = lambda n: F.element_at(F.array(*[F.lit(x) for x in NAMES]), (n % 4 + 1).cast("int"))
    d = _domain(events(spark, sf_dir, "view", "error"))
    said = d.select(*T.DOMAIN, "mono_ms", kind(F.col("event_id")).alias("kind"), _ref().alias("ref"), (F.col("event_id") % 11 > 0).alias("usable"), F.when(F.floor("value") % 3 == 0, F.concat(F.lit("b"), F.col("event_id") % 2)).otherwise("b").alias("body"), (F.col("mono_ms") + 86_400_000 * (F.col("event_id") % 9)).alias("until_ms"))
    d = _domain(events(spark, sf_dir, "click", "purchase")).withColumn("_more", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = d.select(*T.DOMAIN, "mono_ms", "event_id", kind(F.col("event_id") + F.col("_more")).alias("kind"), F.concat(F.lit("r"), (F.floor("value") + F.col("_more")) % 40).alias("ref"), ((F.col("event_id") + F.col("_more")) % 4 == 1).alias("activates"))
    return T.audit_references(asked, said).select("event_id", F.array_join("issues", ",").alias("issues"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of users' streams whose numbers go on by a hundred, at times back, in a space of 65536 that is gone round."""
    e = events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 997 - F.when(F.col("event_id") % 17 == 0, 1500).otherwise(0)
    rows = e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("start_ms"), n.alias("n"))
    return rows.withColumns({"sequence_first": F.pmod("n", F.lit(65536)).cast("long"), "sequence_last": F.pmod(F.col("n") + 900, F.lit(65536)).cast("long")})


def i14_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that use numbers another one of their stream uses, where numbers begin again after 65535."""
    return T.reused_sequences(_sequences(spark, sf_dir), ["user_id"], 65536).select("event_id", "reused")


def i14_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with numbers that never begin again; windows without numbers reuse nothing."""
    rows = _sequences(spark, sf_dir).withColumns({"sequence_first": F.when(F.col("event_id") % 13 > 0, F.col("n").cast("long")), "sequence_last": (F.col("n") + 900).cast("long")})
    return T.reused_sequences(rows, ["user_id"]).select("event_id", "reused")


def a20_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold an hour and a half after purchases, and deltas of up to 59 minutes of an hour, by places, with calls, sources and empty bins."""
    e = events(spark, sf_dir)
    names = [(F.col("user_id") % 3).alias("place"), F.col("user_id").alias("call"), (F.col("event_id") % 4).alias("source"), "value"]
    held = e.where("event_type = 'purchase' AND user_id % 10 > 0").select(*names, F.col("ts").alias("start"), F.timestamp_add("MINUTE", F.lit(90), F.col("ts")).alias("end"))
    deltas = e.where("event_type = 'click' AND user_id % 10 = 0").select(*names, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), F.col("ts").alias("end"))
    out = R.calendar_profile(held, ["place"]).withColumn("measure", F.lit("mean")).unionByName(R.calendar_profile(deltas, ["place"], "delta").withColumn("measure", F.lit("delta")))
    return out.select("measure", "place", "kind", "bin", *[F.round(c, 6).alias(c) for c in ("seconds", "mean", "day_mean", "total", "rate", "low", "high")], "days", "calls", "sources", "limited")


def i12_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the lanes of every user with the records behind them, by which neighbours differ, too."""
    e = events(spark, sf_dir)
    layer = F.element_at(F.array(*[F.lit(x) for x in ("stun", "cti", "sip", "device", "app")]), (F.col("event_id") % 5).cast("int") + 1)
    said = e.select("user_id", "ts", F.col("event_id").alias("ord"), F.col("event_id").alias("evidence_id"), layer.alias("layer"), F.when(F.col("value") < 60, "up").otherwise("down").alias("state"))
    bounds = e.groupBy("user_id").agg(F.min("ts").alias("begin"), F.max("ts").alias("stop"))
    out = K.connectivity_timeline(said, bounds, ["user_id"], 6 * HOUR)
    return out.select("user_id", "lane", "start", "end", "state", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


def z3_creations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of users' devices, which clicks create anew: what began before a creation isn't closed after it."""
    e = events(spark, sf_dir)
    named = [F.col("user_id").alias("import_id"), F.col("user_id").alias("perspective_id"), F.lit("NART0 of Line 1").alias("device")]
    signals = e.where("event_type IN ('error', 'purchase')").select(*named, F.lit("AWT").alias("observer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.when(F.col("event_type") == "error", "start").otherwise("end").alias("phase"), F.lit(None).cast("double").alias("duration_ms"))
    creations = e.where("event_type = 'click'").select("user_id", "event_id", "ts").select(F.col("user_id").alias("import_id"), F.when(F.col("event_id") % 2 == 0, "Default Audio Output").otherwise("NART0 of Line 1").alias("device"), "ts", "event_id")
    none = signals.limit(0)
    bounds = none.select("import_id", "perspective_id", *[F.lit(0).cast("long").alias(c) for c in ("anchor_us", "begin_us", "stop_us")])
    out = Z.incident_report(signals, bounds, none.select("perspective_id"), ["import_id", "perspective_id"], 1_000_000, creations=creations)["episodes"]
    return out.select(F.col("import_id").alias("user_id"), "output_device_created", "input_device_created", "start_us", "end_us", "status", "signals")


KIND = "CASE ({n}) % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'plan' WHEN 2 THEN 'position' ELSE 'config' END"
SEQUENCES = """e AS (SELECT event_id, user_id AS u, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 997 - CASE WHEN event_id % 17 = 0 THEN 1500 ELSE 0 END AS n FROM events)"""
AGAIN = "coalesce(n <= lag(n + 900) OVER w, false) OR coalesce(lead(n) OVER w <= n + 900, false)"

ORACLE: dict[str, str] = {
    "i17_references": f"""WITH d AS (SELECT user_id % 5 AS s, ts, {KIND.format(n="event_id")} AS kind, 'r' || CAST(floor(value) AS BIGINT) % 40 AS ref, event_id % 11 > 0 AS ok, CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN 'b' || event_id % 2 ELSE 'b' END AS body, ts + to_days(CAST(event_id % 9 AS INTEGER)) AS until FROM events WHERE event_type IN ('view', 'error')),
        r AS (SELECT user_id % 5 AS s, ts, event_id, m, {KIND.format(n="event_id + m")} AS kind, 'r' || (CAST(floor(value) AS BIGINT) + m) % 40 AS ref, (event_id + m) % 4 = 1 AS act FROM events, (VALUES (0), (1)) v(m) WHERE event_type IN ('click', 'purchase')),
        x AS (SELECT r.event_id, r.m, any_value(r.kind) AS kind, any_value(r.act) AS act, any_value(r.ts) AS ts, count(*) FILTER (WHERE d.ok AND d.ts <= r.ts) AS known, max(d.until) FILTER (WHERE d.ok AND d.ts <= r.ts) AS ends, count(DISTINCT d.body) AS bodies, arg_max(d.ok, d.ts) FILTER (WHERE d.ts <= r.ts) AS last
              FROM r LEFT JOIN d ON d.s = r.s AND d.kind = r.kind AND d.ref = r.ref GROUP BY r.event_id, r.m),
        i AS (SELECT event_id, CASE WHEN NOT CASE WHEN kind = 'config' THEN coalesce(last, false) AND bodies <= 1 ELSE known > 0 END THEN kind || '_reference_unresolved' WHEN act AND ends <= ts THEN 'expired_plan_activation' END AS issue FROM x)
        SELECT event_id, coalesce(string_agg(DISTINCT issue, ',' ORDER BY issue), '') AS issues FROM i GROUP BY event_id""",
    "i12_evidence": f"""WITH v AS (SELECT user_id AS u, epoch_us(ts) AS t, event_id, CASE event_id % 5 WHEN 0 THEN 'stun' WHEN 1 THEN 'cti' WHEN 2 THEN 'sip' WHEN 3 THEN 'device' ELSE 'app' END AS layer, CASE WHEN value < 60 THEN 'up' ELSE 'down' END AS state FROM events),
        b AS (SELECT u, min(t) AS a, max(t) AS z FROM v GROUP BY u), c AS (SELECT DISTINCT v.u, x.t FROM (SELECT u, t FROM v UNION SELECT u, t + {6 * HOUR} FROM v) x JOIN v USING (u) JOIN b ON b.u = x.u WHERE x.t >= a AND x.t < z),
        lay AS (SELECT unnest(['stun', 'cti', 'sip', 'device', 'app', 'media']) AS layer), cl AS (SELECT c.*, layer FROM c, lay),
        f AS (SELECT cl.u, cl.t, cl.layer, CASE WHEN cl.t < v.t + {6 * HOUR} THEN v.state ELSE 'unknown' END AS state, CASE WHEN cl.t < v.t + {6 * HOUR} THEN v.event_id END AS ev FROM cl ASOF LEFT JOIN v ON cl.u = v.u AND cl.layer = v.layer AND cl.t >= v.t),
        g AS (SELECT *, layer IN ('stun', 'cti', 'sip', 'media') AND state = 'up' AS p, layer IN ('device', 'stun') AND state = 'down' AS m FROM f),
        n AS (SELECT u, t, coalesce(bool_or(p), false) AS up, coalesce(bool_or(m), false) AS dn, string_agg(ev, ',' ORDER BY ev) FILTER (WHERE m) AS evm, string_agg(ev, ',' ORDER BY ev) FILTER (WHERE p) AS evp, string_agg(ev, ',' ORDER BY ev) FILTER (WHERE p OR m) AS evb FROM g GROUP BY u, t),
        al AS (SELECT u, t, layer, coalesce(state, 'unknown') AS state, coalesce(CAST(ev AS VARCHAR), '') AS ev FROM f UNION ALL
               SELECT u, t, 'network', CASE WHEN up AND dn THEN 'transient' WHEN dn THEN 'down' WHEN up THEN 'up' ELSE 'unknown' END, CASE WHEN up AND dn THEN evb WHEN dn THEN evm WHEN up THEN evp ELSE '' END FROM n),
        ch AS (SELECT *, lag(state) OVER w IS DISTINCT FROM state OR lag(ev) OVER w IS DISTINCT FROM ev AS new FROM al WINDOW w AS (PARTITION BY u, layer ORDER BY t)),
        se AS (SELECT u, layer, t, state, ev, lead(t) OVER (PARTITION BY u, layer ORDER BY t) AS nt FROM ch WHERE new)
        SELECT se.u AS user_id, layer AS lane, {as_time("t")} AS start, {as_time("coalesce(nt, z)")} AS "end", state, ev AS evidence FROM se JOIN b ON b.u = se.u""",
    "z3_creations": """WITH k AS (SELECT user_id AS u, ts, event_id, event_id % 2 = 0 AS o FROM events WHERE event_type = 'click'),
        s0 AS (SELECT DISTINCT user_id AS u, ts, event_type = 'error' AS s FROM events WHERE event_type IN ('error', 'purchase')),
        s1 AS (SELECT s0.*, k.event_id AS oc FROM s0 ASOF LEFT JOIN (SELECT * FROM k WHERE o) k ON k.u = s0.u AND s0.ts >= k.ts),
        s2 AS (SELECT s1.*, k.event_id AS ic FROM s1 ASOF LEFT JOIN (SELECT * FROM k WHERE NOT o) k ON k.u = s1.u AND s1.ts >= k.ts),
        l AS (SELECT *, epoch_us(ts) AS t, lag(s) OVER w AS ps, lag(epoch_us(ts)) OVER w AS pt, lead(s) OVER w AS ns FROM s2 WINDOW w AS (PARTITION BY u, oc, ic ORDER BY ts, NOT s))
        SELECT u AS user_id, oc AS output_device_created, ic AS input_device_created, CASE WHEN ps THEN pt ELSE t END AS start_us, t AS end_us, 'closed' AS status, CASE WHEN ps THEN 2 ELSE 1 END AS signals FROM l WHERE NOT s
        UNION ALL SELECT u, oc, ic, t, NULL, 'open', 1 FROM l WHERE s AND (ns IS NULL OR ns)""",
    "i14_reused": f"WITH {SEQUENCES} SELECT event_id, {AGAIN} AS reused FROM e WINDOW w AS (PARTITION BY u ORDER BY ts)",
    "i14_extended": f"WITH {SEQUENCES}, k AS (SELECT event_id, {AGAIN} AS reused FROM e WHERE event_id % 13 > 0 WINDOW w AS (PARTITION BY u ORDER BY ts)) SELECT e.event_id, coalesce(reused, false) AS reused FROM e LEFT JOIN k USING (event_id)",
    "a20_calendar": """WITH h AS (SELECT 'mean' AS measure, user_id % 3 AS place, user_id AS call, event_id % 4 AS source, value, ts AS a, ts + INTERVAL 90 MINUTE AS b FROM events WHERE event_type = 'purchase' AND user_id % 10 > 0
              UNION ALL SELECT 'delta', user_id % 3, user_id, event_id % 4, value, date_trunc('hour', ts), ts FROM events WHERE event_type = 'click' AND user_id % 10 = 0),
        z AS (SELECT *, unnest(generate_series(date_trunc('hour', a), greatest(a, b - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS h FROM h),
        c AS (SELECT *, (epoch_us(least(b, h + INTERVAL 1 HOUR)) - epoch_us(greatest(a, h))) / 1e6 AS s, CAST(h AS DATE) AS day FROM z),
        w AS (SELECT *, CASE WHEN measure = 'mean' THEN s ELSE 1 END AS n FROM c WHERE measure = 'delta' OR s > 0),
        k AS (SELECT *, unnest([{'kind': 'day', 'bin': CAST(day AS VARCHAR)}, {'kind': 'hour', 'bin': lpad(CAST(hour(h) AS VARCHAR), 2, '0')}, {'kind': 'weekday', 'bin': CAST(isodow(h) - 1 AS VARCHAR)},
              {'kind': 'week_hour', 'bin': lpad(CAST((isodow(h) - 1) * 24 + hour(h) AS VARCHAR), 3, '0')}, {'kind': 'month', 'bin': lpad(CAST(month(h) AS VARCHAR), 2, '0')},
              {'kind': 'history_week', 'bin': CAST(CAST(date_trunc('week', h) AS DATE) AS VARCHAR)}, {'kind': 'history_month', 'bin': strftime(h, '%Y-%m')}, {'kind': 'history_year', 'bin': CAST(year(h) AS VARCHAR)}]) AS x FROM w),
        d AS (SELECT measure, place, x.kind AS kind, x.bin AS bin, day, sum(value * n) / sum(n) AS m FROM k GROUP BY ALL), dm AS (SELECT measure, place, kind, bin, avg(m) AS day_mean FROM d GROUP BY ALL),
        o AS (SELECT measure, place, x.kind AS kind, x.bin AS bin, sum(s) AS seconds, sum(value * n) AS t, sum(n) AS n, min(value) AS low, max(value) AS high, count(DISTINCT day) AS days, count(DISTINCT call) AS calls, count(DISTINCT source) AS sources FROM k GROUP BY ALL),
        sp AS (SELECT * FROM (SELECT DISTINCT measure, place FROM h) p, (SELECT 'hour' AS kind, lpad(CAST(i AS VARCHAR), 2, '0') AS bin FROM range(24) t(i) UNION ALL SELECT 'weekday', CAST(i AS VARCHAR) FROM range(7) t(i)
              UNION ALL SELECT 'week_hour', lpad(CAST(i AS VARCHAR), 3, '0') FROM range(168) t(i) UNION ALL SELECT 'month', lpad(CAST(i AS VARCHAR), 2, '0') FROM range(1, 13) t(i)) b)
        SELECT measure, place, kind, bin, round(coalesce(seconds, 0), 6) AS seconds, round(CASE WHEN measure = 'mean' THEN t / n END, 6) AS mean, round(CASE WHEN measure = 'mean' THEN day_mean END, 6) AS day_mean,
               round(CASE WHEN measure = 'delta' THEN t END, 6) AS total, round(CASE WHEN measure = 'delta' AND seconds > 0 THEN t / seconds END, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high, coalesce(days, 0) AS days, coalesce(calls, 0) AS calls, coalesce(sources, 0) AS sources,
               coalesce(days, 0) < 7 OR coalesce(sources, 0) < 3 OR coalesce(calls, 0) < 10 AS limited
        FROM o FULL JOIN sp USING (measure, place, kind, bin) LEFT JOIN dm USING (measure, place, kind, bin)""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE}
