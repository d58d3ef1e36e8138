"""Queries of the generic operators over the given tables, with DuckDB SQL for the same rows.

``events`` stands in for metric samples: a series is an event type of a user, floor(value) a counter,
value % 100 a loss; values whose floor is a multiple of 17 count as invalid. A user has some events
a day, so that gaps and holds are days here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import windows as W

HOUR, MINUTE = 3_600_000_000, 60_000_000
GAP, HOLD = 72 * HOUR, 36 * HOUR


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    whole = F.floor("value").cast("double")
    return e.select(F.concat_ws(":", "event_type", "user_id").alias("series"), "user_id", "ts", F.col("event_id").alias("ord"), whole.alias("value"), (whole % 17 != 0).alias("valid"), (F.col("value") % 100).alias("loss"))


SAMPLES = "s AS (SELECT event_type || ':' || user_id AS series, user_id, ts, event_id AS ord, floor(value) AS value, floor(value) % 17 <> 0 AS valid, value % 100 AS loss FROM events)"
MICROS = "epoch_us({})"
W1 = f"""{SAMPLES},
l AS (SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv, lag(valid) OVER w AS pok, lag(many) OVER w AS pm
      FROM (SELECT *, count(*) OVER (PARTITION BY series, ts) AS many FROM s) WINDOW w AS (PARTITION BY series ORDER BY ts, ord)),
c AS (SELECT *, CASE WHEN pts IS NULL THEN 'initial' WHEN NOT valid OR NOT pok THEN 'invalid' WHEN many > 1 OR pm > 1 OR ts = pts THEN 'conflict'
             WHEN value < pv THEN 'reset' WHEN epoch_us(ts) - epoch_us(pts) > {GAP} THEN 'gap' ELSE 'ok' END AS status FROM l)"""
HELD = f"""{SAMPLES},
g AS (SELECT series, ts, bool_and(valid) AND min(loss) = max(loss) AS good, max(loss) AS loss FROM s GROUP BY series, ts),
n AS (SELECT *, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS nxt FROM g),
h AS (SELECT series, ts AS a, least(coalesce(nxt, ts + INTERVAL 36 HOUR), ts + INTERVAL 36 HOUR) AS b, loss FROM n WHERE good),
m AS (SELECT *, greatest(least(93.2 - 95.0 * loss / (loss + 25.1), 100), 0) AS r FROM h WHERE a < b),
v AS (SELECT series, a, b, loss, 1 + 0.035 * r + 7e-6 * r * (r - 60) * (100 - r) AS mos FROM m)"""
SPANS = "sp AS (SELECT l_suppkey AS k, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem)"
ISLANDS = f"""{SPANS}, x AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp WHERE a < b),
y AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < a THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM x),
u AS (SELECT k, min(a) AS a, max(b) AS b FROM y GROUP BY k, isl)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    held = I.hold_intervals(s, ["series"], value="loss", valid=F.col("valid"), hold_us=HOLD)
    return held.withColumnRenamed("value", "loss").withColumn("mos", S.mos_score("loss"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))


def w1_counter_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.counter_intervals(samples(spark, sf_dir), ["series"], ["ord"], gap_us=GAP)
    return out.select("series", "ord", "status", "delta")


def w2_counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.counter_deltas(samples(spark, sf_dir), ["series"], ["ord"], gap_us=GAP)
    return out.groupBy("series").agg(F.count("*").alias("pairs"), F.sum("delta").alias("total"))


def w3_located_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("hour", F.hour("ts"))
    out = W.located_deltas(s, ["series"], ["hour"], gap_us=GAP)
    return out.select("series", "ts", "hour", "delta")


def w4_bad_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.bad_episodes(_held(spark, sf_dir), ["series"], F.col("mos") < 3, least_us=10 * MINUTE)
    return out.select("series", "start", "end", "intervals")


def w5_coalesce_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _held(spark, sf_dir).withColumn("state", F.when(F.col("mos") < 3, "bad").otherwise("good"))
    return W.coalesce_segments(state.select("series", "start", "end", "state"), ["series"], ["state"])


def w7_route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.route_segments(read(spark, sf_dir, "events"), ["user_id"], gap_us=6 * HOUR)
    return rows.groupBy("user_id").agg(F.max("segment").alias("segments"))


def w8_cell_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("cell", F.floor(F.col("value") / 50).cast("long"))
    rows = rows.groupBy("user_id", "ts").agg(F.min("cell").alias("cell"))
    return W.cell_passes(rows, ["user_id"], gap_us=12 * HOUR)


def w9_copy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", "user_id", (F.col("event_id") % 3).alias("source"), "event_id")
    out = W.copy_ranking(rows, ["event_type", "user_id"], "source", ["event_id"])
    return out.groupBy("event_type", "source").agg(F.count("*").alias("kept"), F.sum("copies").alias("copies"))


def i1_union_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_intervals(_spans(spark, sf_dir), ["k"])


def i2_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_length(_spans(spark, sf_dir), ["k"])


def i3_overlap_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlap_per_window(_spans(spark, sf_dir), ["k"], 30)


def i4_hold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).select("series", "start", "end", F.round("mos", 6).alias("mos"))


def a6_mos_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reports import series_summary

    out = series_summary(_held(spark, sf_dir), ["series"], 3.0)
    return out.select("series", *[F.round(c, 3).alias(c) for c in ("covered", "bad", "bad_percent", "mean", "low", "high")])


def z2_mos_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with at least one episode of MOS below 3, worst first by bad seconds."""
    held = _held(spark, sf_dir)
    seconds = (S.micros("end") - S.micros("start")) / 1e6
    episodes = W.bad_episodes(held, ["series"], F.col("mos") < 3).groupBy("series").agg(F.count("*").alias("episodes"), F.sum(seconds).alias("bad_seconds"))
    return episodes.where("episodes >= 1").select("series", "episodes", F.round("bad_seconds", 3).alias("bad_seconds"))


def j1_asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    out = J.asof_latest(left, right, ["user_id"], ["click_id"])
    return out.select("event_id", "click_id", F.col("seen").alias("click_ts"))


def j2_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    states = J.state_stamps(e.where("event_type = 'view'").withColumn("state", F.floor(F.col("value") / 25).cast("long")), ["user_id"], ["state"], valid=F.floor("value") % 17 != 0)
    return J.state_at(left, states, ["user_id"], ["state"], expiry_us=24 * HOUR).select("event_id", "state")


def j4_split_at_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    spans = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id")).select("user_id", "event_id", F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(36), F.col("ts")).alias("end"))
    states = J.state_stamps(e.where("event_type = 'view'").withColumn("state", F.floor(F.col("value") / 25).cast("long")), ["user_id"], ["state"])
    out = I.split_at_states(spans, states, ["user_id"], ["state"], 12 * HOUR)
    seconds = (S.micros("end") - S.micros("start")) / 1e6
    return out.groupBy("state").agg(F.round(F.sum(seconds), 3).alias("seconds"))


def j5_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    span = lambda kind, p, hours: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_start"), F.timestamp_add("HOUR", F.lit(hours), F.col("ts")).alias(f"{p}_end"))
    return J.interval_overlap_join(span("error", "a", 2), span("view", "b", 3), ["user_id"], 6 * HOUR).select("user_id", "a_id", "b_id")


def j6_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    points = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("point_id"))
    spans = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("end"))
    out = J.within_tolerance_join(points, spans, ["user_id"], 2 * HOUR)
    return out.select("point_id", "span_id", "distance_us")


def j7_nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    spans = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("end"))
    clicks = e.where("event_type = 'click'").select("user_id", "ts")
    return J.nearest_event(spans, clicks, ["user_id"]).select("span_id", "nearest_us")


def j8_bracket_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    points = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    fixes = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.min("value").alias("low"), F.max("value").alias("x")).withColumn("ok", F.col("low") == F.col("x"))
    out = J.bracket_interpolate(points, fixes.select("user_id", "ts", "ok", "x"), ["user_id"], ["x"], most_us=24 * HOUR, longitudes=())
    return out.select("event_id", F.round("x", 4).alias("x"))


def j12_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    from .listings import with_and_without

    told = with_and_without(customers.withColumn("key", F.col("c_custkey")), orders.select(F.col("o_custkey").alias("key")), ["key"], "active")
    return told.groupBy("c_nationkey", F.when(F.col("active"), "active").otherwise("idle").alias("kind")).agg(F.count("*").alias("customers"))


def c4_unique_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    windows = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(6), F.col("ts")).alias("end"))
    rows = e.where("event_type <> 'purchase'").select("user_id", "event_id", "ts")
    return J.unique_window(rows, windows, ["user_id"], ["window_id"], "event_id").select("event_id", "window_id")


def a1_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .listings import metric_summary

    return metric_summary(samples(spark, sf_dir), ["series", "user_id"]).withColumn("mean", F.round("mean", 6))


def a2_metric_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .listings import metric_inventory

    return metric_inventory(samples(spark, sf_dir).withColumn("kind", F.substring_index("series", ":", 1)), ["kind", "valid"], "user_id")


def a8_receiver_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reports import receiver_ranking

    s = samples(spark, sf_dir)
    held = I.hold_intervals(s, ["user_id", "series"], value="loss", valid=F.col("valid"), hold_us=30 * MINUTE)
    out = receiver_ranking(held.withColumn("mos", S.mos_score("value")), ["user_id"], "series")
    return out.select("user_id", "calls", F.round("covered", 3).alias("covered"), F.round("bad_percent", 4).alias("bad_percent"))


def a15_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reports import cell_summary

    e = read(spark, sf_dir, "events")
    place = e.select((F.lit(48.0) + (F.col("user_id") % 50) / 500).alias("lat"), (F.lit(16.0) + F.floor("value") % 40 / 400).alias("lon"), F.col("ts").alias("start"), F.timestamp_add("SECOND", F.lit(20), F.col("ts")).alias("end"), (F.col("value") % 5).alias("mos"))
    out = cell_summary(place.withColumn("cell", S.grid_cell("lat", "lon", 1000)))
    return out.select("cell", F.round("seconds", 3).alias("seconds"), F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), "days", "limited")


def a20_temporal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reports import temporal_profile

    held = _held(spark, sf_dir).withColumnRenamed("mos", "x").withColumn("place", F.lit("all"))
    out = temporal_profile(held.select("place", "start", "end", F.col("x").alias("value")), ["place"])
    return out.select("kind", "bin", F.round("seconds", 3).alias("seconds"), F.round("mean", 5).alias("mean"), F.round("day_mean", 5).alias("day_mean"), "days")


def t1_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50).select("o_orderkey", "o_custkey")


def t2_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.page(read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 100, 25)[0]


def t3_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.counter_intervals(samples(spark, sf_dir), ["series"], ["ord"], gap_us=GAP)
    best = F.struct("value", -F.col("ord"))
    return s.groupBy("series").agg(F.max(F.when(F.col("valid"), F.col("value"))).alias("peak"), F.max_by("ord", F.when(F.col("valid"), best)).alias("evidence"), F.count_if(F.col("status") == "reset").alias("resets"))


def t4_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_per_key(read(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])


def u1_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    both = c.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).unionByName(s.select(F.col("s_nationkey").alias("nation")), allowMissingColumns=True)
    return both.groupBy("nation").agg(F.count("*").alias("parties"), F.count("balance").alias("with_balance"))


def u2_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).union(s.select("s_nationkey")).distinct()


def u3_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and twice their numbers, that no order has."""
    from .listings import missing_ids

    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return missing_ids(c.select(F.explode(F.array("c_custkey", F.col("c_custkey") * 2)).alias("id")), o.select(F.col("o_custkey").alias("id")), "id")


def f1_mos_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("ord", F.round(S.mos_score(F.col("value") - 50), 6).alias("mos"))


def f14_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    keys = S.calendar_keys("ts")
    return e.groupBy(keys["week"].alias("week"), keys["weekday"].alias("weekday"), keys["week_hour"].alias("week_hour")).agg(F.count("*").alias("events"))


def f4_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    lat, lon = F.col("user_id") % 80, F.col("value") % 179
    return e.select("event_id", F.round(S.haversine(lat, lon, lat + 1, lon + 2), 2).alias("metres"), F.round(S.lon_arc(lon, F.col("value") * 3), 6).alias("arc"))


def x7_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the JSON of each event, by type and key."""
    e = read(spark, sf_dir, "events")
    pairs = e.select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return pairs.groupBy("event_type", "k").agg(F.count("v").alias("n"), F.countDistinct("v").alias("values"))


HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"
BIN = "((({0}) % 360) + 360) % 360"

ORACLE: dict[str, str] = {
    "w1_counter_intervals": f"WITH {W1} SELECT series, ord, status, CASE WHEN status = 'ok' THEN value - pv END AS delta FROM c",
    "w2_counter_deltas": f"WITH {W1} SELECT series, count(*) AS pairs, sum(value - pv) AS total FROM c WHERE status = 'ok' GROUP BY series",
    "w3_located_deltas": f"""WITH {SAMPLES},
        g AS (SELECT series, ts, hour(ts) AS hour, bool_and(valid) AND min(value) = max(value) AS good, min(value) AS v FROM s GROUP BY series, ts),
        r AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS run FROM g),
        p AS (SELECT *, lag(ts) OVER w AS pts, lag(v) OVER w AS pv, lag(hour) OVER w AS ph FROM r WHERE good WINDOW w AS (PARTITION BY series, run ORDER BY ts))
        SELECT series, ts, CAST(hour AS INT) AS hour, v - pv AS delta FROM p WHERE epoch_us(ts) - epoch_us(pts) BETWEEN 1 AND {GAP} AND v >= pv AND hour = ph""",
    "w4_bad_episodes": f"""WITH {HELD}, q AS (SELECT *, lag(b) OVER (PARTITION BY series ORDER BY a, b) AS pb FROM v WHERE mos < 3),
        i AS (SELECT *, sum(CASE WHEN pb IS NOT DISTINCT FROM a THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM q),
        e AS (SELECT series, min(a) AS start, max(b) AS "end", count(*) AS intervals FROM i GROUP BY series, isl)
        SELECT * FROM e WHERE epoch_us("end") - epoch_us(start) >= {10 * MINUTE}""",
    "w5_coalesce_segments": f"""WITH {HELD}, t AS (SELECT *, CASE WHEN mos < 3 THEN 'bad' ELSE 'good' END AS state FROM v),
        q AS (SELECT *, lag(b) OVER w AS pb, lag(state) OVER w AS ps FROM t WINDOW w AS (PARTITION BY series ORDER BY a)),
        i AS (SELECT *, sum(CASE WHEN pb IS NOT DISTINCT FROM a AND ps IS NOT DISTINCT FROM state THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY a ROWS UNBOUNDED PRECEDING) AS isl FROM q)
        SELECT series, state, min(a) AS start, max(b) AS "end" FROM i GROUP BY series, isl, state""",
    "w7_route_segments": f"""WITH g AS (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {6 * HOUR} THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
        SELECT user_id, CAST(sum(n) AS BIGINT) AS segments FROM g GROUP BY user_id""",
    "w8_cell_passes": f"""WITH g AS (SELECT user_id, ts, min(CAST(floor(value / 50) AS BIGINT)) AS cell FROM events GROUP BY user_id, ts),
        p AS (SELECT *, lag(cell) OVER w AS pc, lag(ts) OVER w AS pt FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts))
        SELECT user_id, cell, count(*) FILTER (WHERE pc IS DISTINCT FROM cell OR epoch_us(ts) - epoch_us(pt) > {12 * HOUR}) AS passes FROM p GROUP BY user_id, cell""",
    "w9_copy_ranking": """WITH o AS (SELECT event_type, user_id, event_id % 3 AS source, row_number() OVER (PARTITION BY event_id % 3, event_type, user_id ORDER BY event_id) AS nth FROM events),
        r AS (SELECT *, count(*) OVER w AS copies, row_number() OVER (PARTITION BY event_type, user_id, nth ORDER BY source DESC) AS rk FROM o WINDOW w AS (PARTITION BY event_type, user_id, nth))
        SELECT event_type, source, count(*) AS kept, CAST(sum(copies) AS BIGINT) AS copies FROM r WHERE rk = 1 GROUP BY event_type, source""",
    "i1_union_intervals": f'WITH {ISLANDS} SELECT k, a AS start, b AS "end" FROM u',
    "i2_union_length": f"WITH {ISLANDS} SELECT k, CAST(sum(b - a) AS BIGINT) AS length FROM u GROUP BY k",
    "i3_overlap_per_window": f"""WITH {ISLANDS}, z AS (SELECT k, a, b, unnest(generate_series(CAST(floor(a / 30.0) AS BIGINT), CAST(floor((b - 1) / 30.0) AS BIGINT))) AS bin FROM u)
        SELECT k, bin, CAST(sum(least(b, bin * 30 + 30) - greatest(a, bin * 30)) AS BIGINT) AS covered FROM z GROUP BY k, bin""",
    "i4_hold_intervals": f'WITH {HELD} SELECT series, a AS start, b AS "end", round(mos, 6) AS mos FROM v',
    "a6_mos_series_summary": f"""WITH {HELD}, d AS (SELECT *, (epoch_us(b) - epoch_us(a)) / 1e6 AS s FROM v)
        SELECT series, round(sum(s), 3) AS covered, round(sum(CASE WHEN mos < 3 THEN s ELSE 0 END), 3) AS bad, round(100 * sum(CASE WHEN mos < 3 THEN s ELSE 0 END) / sum(s), 3) AS bad_percent,
               round(sum(mos * s) / sum(s), 3) AS mean, round(min(mos), 3) AS low, round(max(mos), 3) AS high FROM d GROUP BY series""",
    "z2_mos_report": f"""WITH {HELD}, q AS (SELECT *, lag(b) OVER (PARTITION BY series ORDER BY a, b) AS pb FROM v WHERE mos < 3)
        SELECT series, count(*) FILTER (WHERE pb IS DISTINCT FROM a) AS episodes, round(sum(epoch_us(b) - epoch_us(a)) / 1e6, 3) AS bad_seconds FROM q GROUP BY series""",
    "j1_asof_latest": """WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
        SELECT e.event_id, c.click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""",
    "j2_state_at": f"""WITH c AS (SELECT user_id, ts, bool_and(floor(value) % 17 <> 0) AS ok, CASE WHEN min(floor(value / 25)) = max(floor(value / 25)) THEN CAST(min(floor(value / 25)) AS BIGINT) END AS state FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
        SELECT e.event_id, CASE WHEN c.ok AND epoch_us(e.ts) - epoch_us(c.ts) < {24 * HOUR} THEN c.state END AS state
        FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""",
    "j4_split_at_states": f"""WITH c AS (SELECT user_id, epoch_us(ts) AS f, CASE WHEN min(floor(value / 25)) = max(floor(value / 25)) THEN CAST(min(floor(value / 25)) AS BIGINT) END AS state FROM events WHERE event_type = 'view' GROUP BY user_id, ts),
        d AS (SELECT *, least(f + {12 * HOUR}, coalesce(lead(f) OVER (PARTITION BY user_id ORDER BY f), f + {12 * HOUR})) AS t FROM c),
        p AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + {36 * HOUR} AS b FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts),
        k AS (SELECT state, least(b, t) - greatest(a, f) AS us FROM p JOIN d ON p.user_id = d.user_id AND f < b AND t > a),
        w AS (SELECT state, sum(us) AS us FROM k GROUP BY state UNION ALL SELECT NULL, (SELECT sum(b - a) FROM p) - (SELECT sum(us) FROM k))
        SELECT state, round(sum(us) / 1e6, 3) AS seconds FROM w GROUP BY state""",
    "j5_interval_overlap": """SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view'
        AND a.ts < b.ts + INTERVAL 3 HOUR AND a.ts + INTERVAL 2 HOUR > b.ts""",
    "j6_within_tolerance": f"""WITH d AS (SELECT p.event_id AS point_id, s.event_id AS span_id, greatest(epoch_us(s.ts) - epoch_us(p.ts), epoch_us(p.ts) - epoch_us(s.ts) - {HOUR}, 0) AS distance_us
        FROM events p JOIN events s ON p.user_id = s.user_id AND p.event_type = 'click' AND s.event_type = 'error') SELECT * FROM d WHERE distance_us <= {2 * HOUR}""",
    "j7_nearest_event": f"""SELECT s.event_id AS span_id, min(greatest(epoch_us(s.ts) - epoch_us(p.ts), epoch_us(p.ts) - epoch_us(s.ts) - {HOUR}, 0)) AS nearest_us
        FROM (SELECT * FROM events WHERE event_type = 'error') s LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON p.user_id = s.user_id GROUP BY s.event_id""",
    "j8_bracket_interpolate": f"""WITH f AS (SELECT user_id, ts, min(value) = max(value) AS ok, max(value) AS x FROM events WHERE event_type = 'view' GROUP BY user_id, ts),
        p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
        b AS (SELECT p.*, f.ts AS bt, f.ok AS bo, f.x AS bx FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.ts >= f.ts),
        c AS (SELECT b.*, f.ts AS nt, f.ok AS ao, f.x AS ax FROM b ASOF LEFT JOIN f ON b.user_id = f.user_id AND b.ts <= f.ts)
        SELECT event_id, round(CASE WHEN bo AND ao AND epoch_us(nt) - epoch_us(bt) <= {24 * HOUR} THEN bx + (ax - bx) * (CASE WHEN nt = bt THEN 0 ELSE (epoch_us(ts) - epoch_us(bt)) / (epoch_us(nt) - epoch_us(bt)) END) END, 4) AS x FROM c""",
    "j12_semi_anti": """WITH k AS (SELECT c_nationkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'active' ELSE 'idle' END AS kind FROM customer)
        SELECT c_nationkey, count(*) AS customers, kind FROM k GROUP BY ALL""",
    "c4_unique_window": f"""WITH w AS (SELECT user_id, event_id AS window_id, epoch_us(ts) AS a, epoch_us(ts) + {6 * HOUR} + 250000 AS b FROM events WHERE event_type = 'purchase'),
        m AS (SELECT e.event_id, count(*) AS n, min(window_id) AS window_id FROM events e JOIN w ON e.user_id = w.user_id AND epoch_us(e.ts) BETWEEN a AND b WHERE e.event_type <> 'purchase' GROUP BY e.event_id)
        SELECT e.event_id, m.window_id FROM events e LEFT JOIN m ON e.event_id = m.event_id AND m.n = 1 WHERE e.event_type <> 'purchase'""",
    "a1_metric_summary": f"WITH {SAMPLES} SELECT series, user_id, count(*) FILTER (WHERE valid) AS samples, min(value) FILTER (WHERE valid) AS low, round(avg(value) FILTER (WHERE valid), 6) AS mean, max(value) FILTER (WHERE valid) AS high, count(*) FILTER (WHERE NOT valid) AS invalid FROM s GROUP BY series, user_id",
    "a2_metric_inventory": f"WITH {SAMPLES} SELECT split_part(series, ':', 1) AS kind, valid, count(*) AS samples, count(DISTINCT user_id) AS sources FROM s GROUP BY ALL",
    "a8_receiver_ranking": f"""WITH {SAMPLES}, g AS (SELECT user_id, series, ts, bool_and(valid) AND min(loss) = max(loss) AS good, max(loss) AS loss FROM s GROUP BY user_id, series, ts),
        n AS (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id, series ORDER BY ts) AS nxt FROM g),
        h AS (SELECT user_id, series, (least(coalesce(nxt, epoch_us(ts) + {30 * MINUTE}), epoch_us(ts) + {30 * MINUTE}) - epoch_us(ts)) / 1e6 AS s, greatest(least(93.2 - 95.0 * loss / (loss + 25.1), 100), 0) AS r FROM n WHERE good),
        v AS (SELECT *, 1 + 0.035 * r + 7e-6 * r * (r - 60) * (100 - r) AS mos FROM h)
        SELECT user_id, count(DISTINCT series) AS calls, round(sum(s), 3) AS covered, round(100 * sum(CASE WHEN mos < 3 THEN s ELSE 0 END) / nullif(sum(s), 0), 4) AS bad_percent FROM v GROUP BY user_id""",
    "a15_cells": """WITH p AS (SELECT 48.0::DOUBLE + (user_id % 50) / 500 AS lat, 16.0::DOUBLE + floor(value) % 40 / 400 AS lon, ts AS a, ts + INTERVAL 20 SECOND AS b, value % 5 AS mos FROM events),
        c AS (SELECT *, floor(lat / (1000 / 111195.08)) AS band FROM p),
        d AS (SELECT *, CAST(band AS BIGINT) || ':' || CAST(floor(lon / ((1000 / 111195.08) / cos(radians(greatest(least((band + 0.5) * (1000 / 111195.08), 89.9), -89.9))))) AS BIGINT) AS cell FROM c),
        y AS (SELECT cell, CAST(a AS DATE) AS day FROM d UNION SELECT cell, CAST(b - INTERVAL 1 MICROSECOND AS DATE) FROM d),
        n AS (SELECT cell, count(*) AS days FROM y GROUP BY cell)
        SELECT d.cell, round(count(*) * 20.0, 3) AS seconds, round(avg(mos), 6) AS mean, round(min(mos), 6) AS low, any_value(days) AS days, count(*) * 20.0 < 60 OR any_value(days) < 2 AS limited FROM d JOIN n USING (cell) GROUP BY d.cell""",
    "a20_temporal_profile": f"""WITH {HELD}, z AS (SELECT mos, a, b, unnest(generate_series(date_trunc('hour', a), b - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS h FROM v),
        c AS (SELECT mos, h, (epoch_us(least(b, h + INTERVAL 1 HOUR)) - epoch_us(greatest(a, h))) / 1e6 AS s, CAST(h AS DATE) AS day FROM z),
        k AS (SELECT mos, s, day, unnest([{{'kind': 'day', 'bin': CAST(CAST(h AS DATE) AS VARCHAR)}}, {{'kind': 'hour', 'bin': lpad(CAST(hour(h) AS VARCHAR), 2, '0')}}, {{'kind': 'weekday', 'bin': CAST(isodow(h) - 1 AS VARCHAR)}},
              {{'kind': 'week_hour', 'bin': lpad(CAST((isodow(h) - 1) * 24 + hour(h) AS VARCHAR), 3, '0')}}, {{'kind': 'month', 'bin': lpad(CAST(month(h) AS VARCHAR), 2, '0')}},
              {{'kind': 'history_week', 'bin': CAST(CAST(date_trunc('week', h) AS DATE) AS VARCHAR)}}, {{'kind': 'history_month', 'bin': strftime(h, '%Y-%m')}}, {{'kind': 'history_year', 'bin': CAST(year(h) AS VARCHAR)}}]) AS x FROM c WHERE s > 0),
        d AS (SELECT x.kind AS kind, x.bin AS bin, day, sum(s) AS s, sum(mos * s) AS w FROM k GROUP BY ALL)
        SELECT kind, bin, round(sum(s), 3) AS seconds, round(sum(w) / sum(s), 5) AS mean, round(avg(w / s), 5) AS day_mean, count(*) AS days FROM d GROUP BY kind, bin""",
    "t1_latest": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "t2_page": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25 OFFSET 100",
    "t3_peaks": f"WITH {W1} SELECT series, max(value) FILTER (WHERE valid) AS peak, min(ord) FILTER (WHERE valid AND value = top) AS evidence, count(*) FILTER (WHERE status = 'reset') AS resets FROM (SELECT *, max(CASE WHEN valid THEN value END) OVER (PARTITION BY series) AS top FROM c) GROUP BY series",
    "t4_first_per_key": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events WHERE event_type = 'error' GROUP BY user_id",
    "u1_union_sources": "SELECT nation, count(*) AS parties, count(balance) AS with_balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier) GROUP BY nation",
    "u2_distinct_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "u3_missing_ids": "(SELECT c_custkey AS id FROM customer UNION SELECT c_custkey * 2 FROM customer) EXCEPT SELECT o_custkey FROM orders",
    "f1_mos_score": f"""WITH {SAMPLES}, m AS (SELECT ord, value - 50 AS l FROM s), r AS (SELECT *, greatest(least(93.2 - 95.0 * l / (l + 25.1), 100), 0) AS r FROM m)
        SELECT ord, CASE WHEN l BETWEEN 0 AND 100 THEN round(1 + 0.035 * r + 7e-6 * r * (r - 60) * (100 - r), 6) END AS mos FROM r""",
    "f14_calendar": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INT) AS week_hour, count(*) AS events FROM events GROUP BY ALL",
    "f4_haversine": "SELECT event_id, round(" + HAVERSINE.format("user_id % 80", "user_id % 80 + 1", "value % 179", "value % 179 + 2") + ", 2) AS metres, round(" + BIN.format("value * 3 - value % 179 + 180") + " - 180, 6) AS arc FROM events",
    "x7_props": """WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events)
        SELECT event_type, k, count(json_extract_string(props, k)) AS n, count(DISTINCT json_extract_string(props, k)) AS "values" FROM k GROUP BY event_type, k""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        w1_counter_intervals, w2_counter_deltas, w3_located_deltas, w4_bad_episodes, w5_coalesce_segments, w7_route_segments, w8_cell_passes, w9_copy_ranking,
        i1_union_intervals, i2_union_length, i3_overlap_per_window, i4_hold_intervals, a1_metric_summary, a2_metric_inventory, a6_mos_series_summary, a8_receiver_ranking,
        a15_cells, a20_temporal_profile, z2_mos_report, j1_asof_latest, j2_state_at, j4_split_at_states, j5_interval_overlap, j6_within_tolerance, j7_nearest_event,
        j8_bracket_interpolate, j12_semi_anti, c4_unique_window, t1_latest, t2_page, t3_peaks, t4_first_per_key, u1_union_sources, u2_distinct_union, u3_missing_ids,
        f1_mos_score, f4_haversine, f14_calendar, x7_props,
    )
}
