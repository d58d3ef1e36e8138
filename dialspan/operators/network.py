"""Connectivity lanes, movement, switches and the attachment of notices to calls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, haversine, micros
from .joins import unique_window
from .windows import SECOND

LAYERS = ("device", "stun", "cti", "sip", "media", "app")


def connectivity_timeline(events: DataFrame, bounds: DataFrame, key: list[str], ttl_us: int = 30 * SECOND) -> DataFrame:
    """Gap-free segments (key, lane, start, end, state) of six layers and the network lane between the bounds.

    ``events``: key, ts, ord, layer, state and, if wanted, ``reason`` and ``evidence_id``, which segments then carry
    and differ by (``evidence``: the ids of the one record behind a layer's state, of at most one a layer
    behind the network's); ``bounds``: key, begin, stop. Of equal times the greatest ``ord`` counts. The newest state of a layer holds
    ``ttl_us``. The network is transient where up and down disagree, else down, up, transient where something is
    merely uncertain, else unknown; its reason lists the layers that say so.

    One shuffle by the key: the states of all layers are carried along its stamps and expiries, and
    only what changes becomes a row of a lane.
    """
    explained, proven = "reason" in events.columns, "evidence_id" in events.columns
    proof = F.array("evidence_id") if proven else F.array().cast("array<string>")
    value = F.struct("state", (F.col("reason") if explained else F.lit(None)).cast("string").alias("reason"), proof.alias("evidence"))
    said = events.where(F.col("layer").isin(*LAYERS)).select(*key, micros("ts").alias("_t"), "layer", F.struct("ord", value.alias("v")).alias("_said"))
    ends = said.select(*key, (F.col("_t") + ttl_us).alias("_t"))
    edges = bounds.select(*key, micros("begin").alias("_t"), micros("begin").alias("_begin"), micros("stop").alias("_stop"))
    stamps = said.unionByName(ends, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True).repartition(*key)
    own = [F.max(F.when(F.col("layer") == x, F.col("_said"))).alias(f"_{x}") for x in LAYERS]
    stamps = stamps.groupBy(*key, "_t").agg(*own, F.max("_begin").alias("_begin"), F.max("_stop").alias("_stop"))
    whole, before = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    carried = {f"_{x}": F.last(F.when(F.col(f"_{x}").isNotNull(), F.struct(F.col("_t").alias("at"), F.col(f"_{x}.v").alias("v"))), ignorenulls=True).over(before) for x in LAYERS}
    stamps = stamps.withColumns(carried | {"_begin": F.max("_begin").over(whole), "_stop": F.max("_stop").over(whole)})
    stamps = stamps.where("_t >= _begin AND _t < _stop")
    kind = f"array<{dict(events.dtypes)['evidence_id']}>" if proven else "array<string>"
    unknown = F.struct(F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("reason"), F.array().cast(kind).alias("evidence"))
    live = {f"_{x}": F.coalesce(F.when(F.col(f"_{x}.at") + ttl_us > F.col("_t"), F.col(f"_{x}.v")), unknown) for x in LAYERS}
    stamps = stamps.withColumns(live).withColumn("_network", network_lane(explained, kind))
    following = Window.partitionBy(*key).orderBy("_t")
    lanes = [F.struct(F.lit(x).alias("lane"), F.col(f"_{x}").alias("v"), (~F.lag(f"_{x}").over(following).eqNullSafe(F.col(f"_{x}"))).alias("new")) for x in (*LAYERS, "network")]
    rows = stamps.select(*key, "_t", "_stop", F.array(*lanes).alias("_l"))
    rows = rows.select(*key, "_t", "_stop", F.explode(F.filter("_l", lambda x: x["new"])).alias("_l")).select(*key, "_t", "_stop", "_l.lane", "_l.v")
    until = F.coalesce(F.lead("_t").over(Window.partitionBy(*key, "lane").orderBy("_t")), F.col("_stop"))
    rows = rows.select(*key, "lane", from_micros("_t").alias("start"), from_micros(until).alias("end"), "v.*")
    return rows.drop(*([] if explained else ["reason"]), *([] if proven else ["evidence"]))


def network_lane(explained: bool, kind: str) -> Column:
    """State, reason and evidence of the network from the states of the layers."""
    says = {
        "_up": [(x, ("up",)) for x in ("stun", "cti", "sip", "media")],
        "_down": [(x, ("down",)) for x in ("device", "stun")],
        "_unsure": [(x, ("transient", "available")) for x in ("device", "stun")],
    }
    named = {n: F.array_compact(F.array(*[F.when(F.col(f"_{x}.state").isin(*states), F.lit(x)) for x, states in rules])) for n, rules in says.items()}
    is_ = {n: F.size(layers) > 0 for n, layers in named.items()}
    cases = [
        (is_["_up"] & is_["_down"], "transient", F.concat(named["_up"], named["_down"])),
        (is_["_down"], "down", named["_down"]),
        (is_["_up"], "up", named["_up"]),
        (is_["_unsure"], "transient", named["_unsure"]),
    ]
    state, reason, evidence = F.lit("unknown"), F.lit(None).cast("string"), F.array().cast(kind)
    for holds, name, layers in reversed(cases):
        state = F.when(holds, name).otherwise(state)
        reason = F.when(holds, F.array_join(layers, ",")).otherwise(reason)
        proofs = F.concat(*[F.when(F.array_contains(layers, x), F.col(f"_{x}.evidence")).otherwise(F.array().cast(kind)) for x in LAYERS])
        evidence = F.when(holds, F.sort_array(proofs)).otherwise(evidence)
    return F.struct(state.alias("state"), (reason if explained else F.lit(None).cast("string")).alias("reason"), evidence.alias("evidence"))


def movement_sequences(fixes: DataFrame, key: str = "import_id", gap_us: int = 30 * SECOND, speed: float = 150.0) -> DataFrame:
    """Kept fixes in sequences (``part``), with ordinal and, on a sequence's first, the reason it began.

    ``fixes``: key, t_us, ok (one unambiguous fix at the time), latitude, longitude, accuracy, elapsed,
    elapsed_s. A fix that isn't ok is a barrier. A fix that repeats the elapsed text of the one before
    (within the gap) is a delivery of the same fix: it is left out, and is a barrier, too, if its place
    differs. Between kept fixes a barrier, an elapsed time running back, a gap or a jump (farther than
    ``speed`` and both accuracies allow) begins a sequence; the reason is the first of these that holds.

    Sorted windows of one partitioning by key; islands of repeats that span more than the gap or
    change their place are scanned once in the order of time, with one fix carried along.
    """
    by = Window.partitionBy(key).orderBy("t_us")
    text = F.nullif(F.col("elapsed"), F.lit(""))
    again = F.col("ok") & F.lag("ok").over(by) & text.eqNullSafe(F.lag(text).over(by)) & text.isNotNull() & (F.col("t_us") - F.lag("t_us").over(by) <= gap_us)
    rows = fixes.withColumn("_island", F.sum(F.when(F.coalesce(again, F.lit(False)), 0).otherwise(1)).over(by))
    island = Window.partitionBy(key, "_island")
    rows = rows.withColumns({
        "_many": F.count("*").over(island),
        "_plain": (F.max("t_us").over(island) - F.min("t_us").over(island) <= gap_us) & (F.min("latitude").over(island) == F.max("latitude").over(island)) & (F.min("longitude").over(island) == F.max("longitude").over(island)),
        "_nth": F.row_number().over(island.orderBy("t_us")),
    })
    mixed = F.col("ok") & ~F.col("_plain") & (F.col("_many") > 1)
    mark = F.when(~F.col("ok"), "ambiguous_or_invalid").when((F.col("_many") == 1) | (F.col("_nth") == 1), "kept").otherwise("left_out")
    rows = rows.withColumn("_mixed", F.coalesce(mixed, F.lit(False)))
    rows = rows.where("NOT _mixed").withColumn("_mark", mark).unionByName(repeat_marks(rows.where("_mixed"), key, gap_us)).drop("_mixed").where("_mark <> 'left_out'")
    barrier = F.when(F.col("_mark") != "kept", F.struct("t_us", F.col("_mark").alias("why")))
    rows = rows.withColumn("_barrier", F.last(barrier, ignorenulls=True).over(by)).where("_mark = 'kept'")
    rows = rows.withColumns({f"_p{c}": F.lag(c).over(by) for c in ("t_us", "latitude", "longitude", "accuracy", "elapsed_s")})
    gap = F.col("t_us") - F.col("_pt_us")
    reach = speed * gap / 1e6 + F.coalesce("accuracy", F.lit(0.0)) + F.coalesce("_paccuracy", F.lit(0.0))
    reason = (
        F.when(F.col("_barrier").isNotNull() & (F.col("_pt_us").isNull() | (F.col("_barrier.t_us") > F.col("_pt_us"))), F.col("_barrier.why"))
        .when(F.col("_pt_us").isNull(), "first_sample")
        .when(F.col("elapsed_s") < F.col("_pelapsed_s"), "monotonic_reset")
        .when(gap > gap_us, "time_gap")
        .when((gap <= 0) | (haversine("_platitude", "_plongitude", "latitude", "longitude") > reach), "implausible_jump")
    )
    rows = rows.withColumn("reason", reason)
    rows = rows.withColumn("part", F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).over(by))
    ordinal = F.row_number().over(Window.partitionBy(key, "part").orderBy("t_us")).cast("long")
    return rows.select(F.col(key).cast("string").alias(key), "t_us", "latitude", "longitude", "part", ordinal.alias("ordinal"), "reason")


def repeat_marks(rows: DataFrame, key: str, gap_us: int) -> DataFrame:
    """``rows`` of islands of repeats with ``_mark``: kept, left_out or conflicting_fix.

    One scan of each island (key, ``_island``) by time: a fix later than the gap after the last kept one is kept,
    one at its place is left out, any other ends it, and the next one is kept again. Partitions are
    sorted, and a batch goes on where the last one stopped, so that an island of any length
    needs the memory of a batch.
    """
    names, types = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, last = None, None
        for batch in batches:
            marks = []
            for own, t, *place in zip(zip(*(batch.column(c).to_pylist() for c in (key, "_island")), strict=True), *(batch.column(c).to_pylist() for c in ("t_us", "latitude", "longitude")), strict=True):
                if own != island:
                    island, last = own, None
                if last is None or t - last[0] > gap_us:
                    last = (t, place)
                    marks.append("kept")
                elif place == last[1]:
                    marks.append("left_out")
                else:
                    last = None
                    marks.append("conflicting_fix")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=[*names, "_mark"])

    return rows.repartition(key, "_island").sortWithinPartitions(key, "_island", "t_us").mapInArrow(run, f"{types}, _mark string")


def notices_to_calls(notices: DataFrame, windows: DataFrame, signature: list[str], row_id: str) -> DataFrame:
    """Notices with their own perspective where they have one (``perspective_id``), else the only active window of their import.

    Copies of one signature are one row with all proofs counted; what no or several windows claim has no call.
    """
    if "perspective_id" in notices.columns:
        calls = windows.select("perspective_id", "call_id").dropDuplicates(["perspective_id"])
        own = notices.where("perspective_id IS NOT NULL").join(calls, "perspective_id", "left")
        rest = unique_window(notices.where("perspective_id IS NULL").drop("perspective_id"), windows, ["import_id"], ["perspective_id", "call_id"], row_id, grace_us=0)
        rows = own.unionByName(rest)
    else:
        rows = unique_window(notices, windows, ["import_id"], ["perspective_id", "call_id"], row_id, grace_us=0)
    return rows.groupBy(*signature, "perspective_id", "call_id").agg(F.count("*").alias("proofs"), F.min(row_id).alias("first_proof"))


def nearby_transition(requests: DataFrame, states: DataFrame, key: list[str], near_us: int = 3 * SECOND, alone_us: int = 6 * SECOND) -> DataFrame:
    """from and to of a switch request: exactly two different states within ``near_us`` after equal neighbours are one, and no request at another time within ``alone_us``.

    A time at which several states are declared, or one that is unknown, says that nothing is known: the
    request has no transition. Requests that name both states (``previous`` and ``next``) keep them.
    """
    t = micros("ts")
    others = requests.select(*key, t.alias("_o")).distinct().withColumn("_k", F.floor(F.col("_o") / alone_us))
    rows = requests.withColumn("_t", t).withColumn("_k", F.explode(F.sequence(F.floor((t - alone_us) / alone_us), F.floor((t + alone_us) / alone_us))))
    count = rows.join(others, [*key, "_k"]).where(F.abs(F.col("_o") - F.col("_t")) <= alone_us).groupBy(*key, "request_id").agg(F.count("*").alias("_n"))
    clear = (F.min("state") == F.max("state")) & (F.count("state") == F.count("*")) & (F.min("state") != "unknown")
    s = states.groupBy(*key, micros("ts").alias("_s")).agg(F.coalesce(clear, F.lit(False)).alias("_clear"), F.min("state").alias("state")).withColumn("_k", F.floor(F.col("_s") / near_us))
    rows = requests.withColumn("_t", t).withColumn("_k", F.explode(F.sequence(F.floor((t - near_us) / near_us), F.floor((t + near_us) / near_us))))
    near = rows.join(s, [*key, "_k"]).where(F.abs(F.col("_s") - F.col("_t")) <= near_us)
    by = Window.partitionBy(*key, "request_id").orderBy("_s")
    turns = near.withColumn("_turn", ~F.lag("state").over(by).eqNullSafe(F.col("state")))
    when = F.when(F.col("_turn"), F.col("_s"))
    seen = turns.groupBy(*key, "request_id").agg(F.min("_clear").alias("_clear"), F.count_if("_turn").alias("_turns"), F.min_by("state", when).alias("_from"), F.max_by("state", when).alias("_to"))
    out = requests.join(count, [*key, "request_id"], "left").join(seen.where("_clear AND _turns = 2"), [*key, "request_id"], "left")
    ok = F.col("_n") == 1
    made = {"from_state": F.when(ok, F.col("_from")), "to_state": F.when(ok, F.col("_to"))}
    if "previous" in requests.columns and "next" in requests.columns:
        named = F.col("previous").isNotNull() & F.col("next").isNotNull()
        made = {c: F.when(named, F.col(own)).otherwise(made[c]) for c, own in (("from_state", "previous"), ("to_state", "next"))}
    return out.withColumns(made).drop("_n", "_clear", "_turns", "_from", "_to")


def matches(fields: dict[str, str]) -> Column:
    """Whether a context fits a filter; ``all`` fits everything."""
    out = F.lit(True)
    for name, value in fields.items():
        if value != "all":
            out = out & (F.coalesce(F.col(name), F.lit("unknown")) == value)
    return out
