"""Joins by time: as of, with expiry, overlap, tolerance, nearest and interpolated.

Right sides of as-of joins are united with the left and carried along one ordered window;
range joins meet in time buckets and are tested exactly afterwards, each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lon_arc, micros
from .windows import SECOND


def row_hash(columns: list[str]) -> Column:
    """A number of a row's values that tells nulls in different columns apart (equal rows have one number)."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))])


def asof_latest(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], ts: str = "ts", ties: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``left`` with ``fields`` and ``seen`` of the latest right row of its key at or before (``strict``: before) its time; of equal times the greatest ``ties``."""
    values = F.struct(F.col(ts).alias("seen"), *[F.col(c).alias(c) for c in fields])
    a = left.select(F.struct(*left.columns).alias("_left"), *key, F.col(ts).alias("_ts"), F.lit(0 if strict else 1).alias("_side"), *[F.lit(None).cast(dict(right.dtypes)[t]).alias(f"_t{i}") for i, t in enumerate(ties or [])])
    b = right.select(*key, F.col(ts).alias("_ts"), F.lit(1 if strict else 0).alias("_side"), values.alias("_right"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties or [])])
    both = a.unionByName(b, allowMissingColumns=True)
    by = Window.partitionBy(*key).orderBy("_ts", "_side", *[f"_t{i}" for i in range(len(ties or []))]).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_right", ignorenulls=True).over(by)).where("_left IS NOT NULL")
    return both.select("_left.*", "_last.*")


def state_stamps(df: DataFrame, key: list[str], fields: list[str], ts: str = "ts", valid: Column | None = None) -> DataFrame:
    """One row a time: ``ok`` unless any row there is invalid; a field with two values at a time is NULL."""
    good = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    one = [F.when(F.min(f).eqNullSafe(F.max(f)) & (F.count(f) == F.count("*")), F.min(f)).alias(f) for f in fields]
    return df.groupBy(*key, ts).agg(F.min(good).alias("ok"), *one)


def state_at(left: DataFrame, states: DataFrame, key: list[str], fields: list[str], ts: str = "ts", expiry_us: int = 30 * SECOND) -> DataFrame:
    """The state at a time: the last stamp's, if it is ok and younger than ``expiry_us``; else NULL, never an older one's."""
    found = asof_latest(left, states, key, ["ok", *fields], ts)
    live = F.col("ok") & (micros(ts) - micros("seen") < expiry_us)
    return found.withColumns({f: F.when(live, F.col(f)) for f in fields}).drop("ok", "seen")


def _spread(df: DataFrame, low: Column, high: Column, width: int, name: str) -> DataFrame:
    first, last = F.floor(low / width), F.floor(high / width)
    return df.withColumns({f"_first_{name}": first}).withColumn("_bucket", F.explode(F.sequence(first, last)))


def interval_overlap_join(a: DataFrame, b: DataFrame, key: list[str], width_us: int, a_span: tuple[str, str] = ("a_start", "a_end"), b_span: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Pairs with equal keys whose half-open intervals overlap, each once. Durations are not added up."""
    left = _spread(a.where(F.col(a_span[0]) < F.col(a_span[1])), micros(a_span[0]), micros(a_span[1]) - 1, width_us, "a")
    right = _spread(b.where(F.col(b_span[0]) < F.col(b_span[1])), micros(b_span[0]), micros(b_span[1]) - 1, width_us, "b")
    met = left.join(right, [*key, "_bucket"]).where(F.col("_bucket") == F.greatest("_first_a", "_first_b"))
    met = met.where((F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0])))
    return met.drop("_bucket", "_first_a", "_first_b")


def within_tolerance_join(points: DataFrame, spans: DataFrame, key: list[str], tolerance_us: int, ts: str = "ts", span: tuple[str, str] = ("start", "end"), width_us: int | None = None) -> DataFrame:
    """Points at most ``tolerance_us`` (inclusive) from an interval, with ``distance_us`` (0 inside)."""
    width = width_us or max(tolerance_us, SECOND)
    t, a, b = micros(ts), micros(span[0]), micros(span[1])
    left = points.withColumn("_bucket", F.floor(t / width))
    right = spans.withColumn("_bucket", F.explode(F.sequence(F.floor((a - tolerance_us) / width), F.floor((b + tolerance_us) / width))))
    met = left.join(right, [*key, "_bucket"]).drop("_bucket")
    return met.withColumn("distance_us", F.greatest(a - t, t - b, F.lit(0))).where(F.col("distance_us") <= tolerance_us)


def nearest_event(spans: DataFrame, events: DataFrame, key: list[str], ts: str = "ts", span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """``spans`` with ``nearest_us``: the distance to the nearest event of the key (0 inside); NULL without any."""
    def carried(at: str, side: int, last: bool) -> DataFrame:
        a = spans_id.select(*key, F.col(at).alias("_ts"), F.lit(side).alias("_side"), "_row", F.lit(None).cast("timestamp_ntz").alias("_event"))
        b = events.select(*key, F.col(ts).alias("_ts"), F.lit(1 - side).alias("_side"), F.lit(None).cast("long").alias("_row"), F.col(ts).alias("_event"))
        by = ["_ts", "_side"] if last else [F.desc("_ts"), F.desc("_side")]  # a running value in either order
        pick = F.last("_event", ignorenulls=True).over(Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
        return a.unionByName(b).withColumn("_near", pick).where("_row IS NOT NULL").select("_row", F.col("_near").alias("_before" if last else "_after"))

    spans_id = spans.withColumn("_row", row_hash(spans.columns))
    found = spans_id.join(carried(span[1], 1, True).dropDuplicates(["_row"]), "_row").join(carried(span[0], 0, False).dropDuplicates(["_row"]), "_row")
    back = F.when(F.col("_before").isNotNull(), F.greatest(micros(span[0]) - micros("_before"), F.lit(0)))
    ahead = F.when(F.col("_after").isNotNull(), F.greatest(micros("_after") - micros(span[1]), F.lit(0)))
    return found.withColumn("nearest_us", F.least(back, ahead)).drop("_row", "_before", "_after")


def bracket_interpolate(points: DataFrame, samples: DataFrame, key: list[str], fields: list[str], ts: str = "ts", most_us: int = 120 * SECOND, longitudes: tuple[str, ...] = ("longitude",)) -> DataFrame:
    """``points`` with ``fields`` between the last sample at or before and the first at or after.

    Both must be ok and at most ``most_us`` apart; a sample at the point's own time is taken as it
    is. Nothing is extrapolated, and a sample that isn't ok is a barrier. ``samples`` has one row a
    time with ``ok``.
    """
    value = F.struct(F.col(ts).alias("at"), "ok", *fields)
    a = points.select(F.struct(*points.columns).alias("_point"), *key, F.col(ts).alias("_ts"))
    both = a.unionByName(samples.select(*key, F.col(ts).alias("_ts"), value.alias("_sample")), allowMissingColumns=True)
    by = Window.partitionBy(*key).orderBy("_ts")
    back = F.last("_sample", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_sample", ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("_ts")).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"_b": back, "_a": ahead}).where("_point IS NOT NULL")
    t, low, high = micros("_ts"), micros("_b.at"), micros("_a.at")
    usable = F.col("_b.ok") & F.col("_a.ok") & (high - low <= most_us)
    share = F.when(high == low, F.lit(0.0)).otherwise((t - low) / (high - low))

    def between(f: str) -> Column:
        x, y = F.col(f"_b.{f}"), F.col(f"_a.{f}")
        if f in longitudes:
            return F.pmod(x + lon_arc(x, y) * share + 180, F.lit(360.0)) - 180
        return x + (y - x) * share

    return both.select("_point.*", *[F.when(usable, between(f)).alias(f) for f in fields])


def series_sum_interpolated(a: DataFrame, b: DataFrame, key: list[str], ts: str = "ts", value: str = "value", most_us: int = 30 * SECOND) -> DataFrame:
    """A + B at all times of either, linear between samples at most ``most_us`` apart, where both are known."""
    times = a.select(*key, ts).unionByName(b.select(*key, ts)).distinct()
    out = times
    for name, side in (("_x", a), ("_y", b)):
        one = side.select(*key, ts, F.col(value).alias(name)).withColumn("ok", F.lit(True))
        out = bracket_interpolate(out, one, key, [name], ts, most_us)
    return out.where("_x IS NOT NULL AND _y IS NOT NULL").select(*key, ts, (F.col("_x") + F.col("_y")).alias(value))


def unique_window(rows: DataFrame, windows: DataFrame, key: list[str], fields: list[str], row_id: str, ts: str = "ts", span: tuple[str, str] = ("start", "end"), grace_us: int = 250_000, width_us: int = 3600 * SECOND) -> DataFrame:
    """``rows`` with ``fields`` of the only window of their key that holds their time (end inclusive, with grace).

    No window, or several, give NULLs: what two may claim belongs to none. Windows without an end
    are the caller's to bound.
    """
    spread = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(micros(span[0]) / width_us), F.floor((micros(span[1]) + grace_us) / width_us))))
    found = rows.select(*key, row_id, F.col(ts).alias("_ts")).withColumn("_bucket", F.floor(micros("_ts") / width_us)).join(spread, [*key, "_bucket"])
    t = micros("_ts")
    found = found.where((t >= micros(span[0])) & (t <= micros(span[1]) + grace_us))
    one = found.groupBy(row_id).agg(F.count("*").alias("_n"), *[F.first(f).alias(f) for f in fields]).where("_n = 1").drop("_n")
    return rows.drop(*fields).join(one, row_id, "left")


def open_windows(rows: DataFrame, windows: DataFrame, key: list[str], row_id: str, ts: str = "ts", span: tuple[str, str] = ("start", "end"), grace_us: int = 0, width_us: int = 86_400 * SECOND) -> DataFrame:
    """(row_id, open, mark): how many windows (with a number ``mark``) of its key are open at a row's time, and the exclusive or of their marks.

    A window is open from its start to its end, both inclusive, with grace; without an end it stays
    open. Starts, rows and ends are swept in the order of time. The sweep is cut into days: the sums of
    earlier days are carried into a day as one row, so that a window without an end isn't spread over
    time and a key with a long history isn't one task. Rows without a key or a time see no window.
    """
    known = lambda df, *more: df.dropna(subset=[*key, *more])
    start, end = micros(span[0]), micros(span[1]) + grace_us
    edge = lambda t, side, n: F.struct(t.alias("t"), F.lit(side).alias("side"), F.lit(n).alias("n"))
    edges = known(windows, span[0]).where(F.col(span[1]).isNull() | (end >= start))
    edges = edges.withColumn("_e", F.explode(F.array(edge(start, 0, 1), edge(end, 2, -1)))).where("_e.t IS NOT NULL").select(*key, "_e.*", "mark")
    points = known(rows, ts).select(*key, micros(ts).alias("t"), F.lit(1).alias("side"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("mark"), F.col(row_id).alias("_row"))
    both = points.unionByName(edges, allowMissingColumns=True).withColumn("_day", F.floor(F.col("t") / width_us))
    days = both.groupBy(*key, "_day").agg(F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"))
    before = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*key, "_day", F.lit(None).cast("long").alias("t"), F.lit(-1).alias("side"), F.sum("n").over(before).cast("int").alias("n"), F.bit_xor("mark").over(before).alias("mark")).where("n > 0")
    swept = both.unionByName(carried, allowMissingColumns=True)
    order = Window.partitionBy(*key, "_day").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)  # what is carried has no t and so comes first
    swept = swept.select("_row", "side", F.sum("n").over(order).alias("open"), F.bit_xor("mark").over(order).alias("mark"))
    return swept.where("side = 1").select(F.col("_row").alias(row_id), "open", "mark")


def only_open_window(rows: DataFrame, windows: DataFrame, key: list[str], fields: list[str], row_id: str, ts: str = "ts", span: tuple[str, str] = ("start", "end"), grace_us: int = 250_000) -> DataFrame:
    """``rows`` (with a ``row_id`` each) with ``fields`` of the only window of their key that is open at their time; windows without an end stay open.

    No window, or several, give NULLs: what two may claim belongs to none.
    """
    marked = windows.select(*key, *fields, *span).withColumn("mark", row_hash([*key, *fields, *span]))
    found = open_windows(rows, marked, key, row_id, ts, span, grace_us).where("open = 1").select(row_id, "mark")
    return rows.drop(*fields).join(found.join(marked.select("mark", *fields).distinct(), "mark").drop("mark"), row_id, "left")
