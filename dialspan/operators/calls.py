"""Legs, perspectives and calls, attribution, duplicates and groups of calls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros
from .joins import only_open_window, open_windows, row_hash, unique_window
from .windows import SECOND

#: Runs that one call of a walking function gets.
RUNS = 1000


def reconstruct_legs(lifecycle: DataFrame) -> DataFrame:
    """Legs of (import_id, line_id, ts, ord, event, call_id) rows; event is added, connected, ended or summary.

    ``added`` opens a leg, what follows on the line belongs to it until its summary; a leg that
    another one opens upon without an end is incomplete. A summary with a Call-ID that closes no
    leg is a leg of its own, without a start (that of its SIP messages counts) and without a number.
    A summary without a Call-ID says nothing.
    """
    lifecycle = lifecycle.where("event <> 'summary' OR call_id IS NOT NULL")
    line = Window.partitionBy("import_id", "line_id").orderBy("ts", "ord")
    rows = lifecycle.withColumn("leg", F.sum(F.when(F.col("event") == "added", 1).otherwise(0)).over(line))
    own = Window.partitionBy("import_id", "line_id", "leg").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_over", (F.col("leg") == 0) | F.coalesce(F.max(F.when(F.col("event") == "summary", True)).over(own), F.lit(False)))
    lone = rows.where("_over AND event = 'summary' AND call_id IS NOT NULL").select("import_id", "line_id", F.col("ts").alias("end"), "call_id", F.lit(False).alias("incomplete"))
    at = lambda *events: F.when(F.col("event").isin(*events), F.col("ts"))
    legs = rows.where("NOT _over").groupBy("import_id", "line_id", "leg").agg(
        F.min("ts").alias("start"),
        F.min(at("connected")).alias("connected"),
        F.max(at("ended", "summary")).alias("end"),
        F.max(F.when(F.col("event") == "summary", F.col("call_id"))).alias("call_id"),
    )
    following = F.lead("start").over(Window.partitionBy("import_id", "line_id").orderBy("leg"))
    legs = legs.withColumn("_next", following)
    legs = legs.withColumns({"incomplete": F.col("end").isNull() & F.col("_next").isNotNull(), "end": F.coalesce("end", "_next")}).drop("_next")
    return legs.unionByName(lone, allowMissingColumns=True)


def sip_only_legs(sip: DataFrame, legs: DataFrame) -> DataFrame:
    """A leg without a line for each Call-ID of an import that no leg has."""
    ids = sip.where(F.col("method").isin("INVITE", "ACK", "BYE", "CANCEL", "REFER", "PRACK", "UPDATE")).groupBy("import_id", "call_id").agg(F.min("ts").alias("start"))
    return ids.join(legs.where("call_id IS NOT NULL").select("import_id", "call_id"), ["import_id", "call_id"], "left_anti")


def callinfo_legs(said: DataFrame, legs: DataFrame) -> DataFrame:
    """Local legs from (import_id, line_id, ts, ord, event) rows of call information files, event is connected or terminated, where ``legs`` don't cover them.

    A connection opens a leg unless a leg of its line is open then (one without an end is open for
    good) or one of these legs is; the line's next termination ends it.
    """
    said = said.where("line_id IS NOT NULL AND ts IS NOT NULL").withColumn("_id", row_hash(["import_id", "line_id", "ts", "ord", "event"]))
    known = legs.where("line_id IS NOT NULL AND start IS NOT NULL").select("import_id", "line_id", "start", "end", F.lit(0).cast("long").alias("mark"))
    covered = open_windows(said.where("event = 'connected'"), known, ["import_id", "line_id"], "_id").where("open > 0").select("_id")
    rows = said.join(covered, "_id", "left_anti").drop("_id")
    by = Window.partitionBy("import_id", "line_id").orderBy("ts", "ord")
    over = F.col("event") == "terminated"
    rows = rows.withColumn("_run", F.sum(F.when(over, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_run", F.coalesce("_run", F.lit(0)))
    runs = rows.groupBy("import_id", "line_id", "_run").agg(F.collect_set(F.when(~over, F.col("ts"))).alias("_at"), F.max(F.when(over, F.col("ts"))).alias("end"))
    last = F.lag("end").over(Window.partitionBy("import_id", "line_id").orderBy("_run"))
    led = F.coalesce(F.lag(F.size("_at")).over(Window.partitionBy("import_id", "line_id").orderBy("_run")) > 0, F.lit(False))
    runs = runs.withColumns({"_last": last, "_led": led})  # at the moment of its end a leg still covers its line
    start = F.array_min(F.filter("_at", lambda t: ~F.col("_led") | (t > F.col("_last"))))
    return runs.withColumn("start", start).where("start IS NOT NULL").select("import_id", "line_id", "start", F.col("start").alias("connected"), "end", F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("incomplete"))


def build_perspectives(legs: DataFrame, sip: DataFrame) -> DataFrame:
    """One row per call and import: window, direction and status, from legs and SIP messages.

    Only answers to INVITE connect or fail a call; its end is the last BYE or CANCEL, answers to them too.
    A leg without a Call-ID is a local call of its own.
    """
    ok = (F.col("method") == "INVITE") & F.col("response").between(200, 299)
    failed = (F.col("method") == "INVITE") & (F.col("response") >= 400) & ~F.col("response").isin(401, 407)
    first = (F.col("method") == "INVITE") & F.col("response").isNull()
    order = F.struct("ts", "ord")
    said = sip.groupBy("import_id", "call_id").agg(
        F.min("ts").alias("_first"),
        F.min(F.when(ok, F.col("ts"))).alias("_ok"),
        F.max(F.when(F.col("method").isin("BYE", "CANCEL"), F.col("ts"))).alias("_bye"),
        F.max(F.when(failed, F.col("ts"))).alias("_failed"),
        F.min_by("direction", F.when(first, order)).alias("direction"),
        F.min_by("caller", F.when(first, order)).alias("caller"),
        F.min_by("callee", F.when(first, order)).alias("callee"),
    )
    one = legs.where("call_id IS NOT NULL").groupBy("import_id", "call_id").agg(F.min("start").alias("start"), F.min("connected").alias("connected"), F.max("end").alias("end"), F.max("line_id").alias("line_id"), F.max("incomplete").alias("incomplete"))
    rows = one.join(said, ["import_id", "call_id"], "full")
    if "leg" not in legs.columns:
        legs = legs.withColumn("leg", F.lit(None).cast("long"))
    local = legs.where("call_id IS NULL").select("import_id", "call_id", "start", "connected", "end", "line_id", "incomplete", F.col("leg").cast("long").alias("leg"))
    rows = rows.unionByName(local, allowMissingColumns=True)
    rows = rows.withColumns({"start": F.least("start", "_first"), "connected": F.least("connected", "_ok")})
    rows = rows.withColumn("end", F.coalesce("end", "_bye", F.when(F.col("connected").isNull(), F.col("_failed"))))
    up = F.col("connected").isNotNull()
    status = F.when(up & F.col("end").isNotNull() & ~F.coalesce("incomplete", F.lit(False)), "completed").when(up, "connected / partial").when(F.col("_failed").isNotNull(), "failed").otherwise("partial")
    return rows.withColumn("status", status).drop("_first", "_ok", "_bye", "_failed", "incomplete")


def call_key(perspectives: DataFrame) -> Column:
    """A Call-ID's key, or that of a local call: its import, line, start and the number of its leg."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("import_id", "line_id", "leg") if c in perspectives.columns]
    return F.coalesce(F.concat(F.lit("sip:"), "call_id"), F.concat_ws(":", F.lit("local"), *parts, F.date_format("start", "yyyyMMddHHmmssSSSSSS")))


def build_calls(perspectives: DataFrame) -> DataFrame:
    return perspectives.withColumn("call_key", call_key(perspectives)).groupBy("call_key").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("connected").alias("connected"), F.count("*").alias("perspectives"))


def attribute_events(events: DataFrame, perspectives: DataFrame, row_id: str = "event_id", grace_us: int = 250_000) -> DataFrame:
    """``events`` with ``owner``: the perspective of their Call-ID, else the only one whose window is open on their line then.

    Perspectives without an end stay open, so that they own what nothing else claims, and what they and
    another one claim belongs to none. Rows of call information files without a line (where
    ``events`` has ``parser``) go to the only ended window of their import that holds them.
    """
    by_id = perspectives.where("call_id IS NOT NULL").select("import_id", "call_id", F.col("perspective_id").alias("_exact"))
    rows = events.join(by_id, ["import_id", "call_id"], "left")
    rows = only_open_window(rows, perspectives.withColumnRenamed("perspective_id", "_by_line"), ["import_id", "line_id"], ["_by_line"], row_id, grace_us=grace_us)
    owners = ["_exact", "_by_line"]
    if "parser" in events.columns:
        loose = rows.where("parser = 'callinfo' AND line_id IS NULL").select("import_id", row_id, "ts")
        ended = perspectives.where("end IS NOT NULL").withColumnRenamed("perspective_id", "_anywhere")
        found = only_open_window(loose, ended, ["import_id"], ["_anywhere"], row_id, grace_us=0).where("_anywhere IS NOT NULL")
        rows = rows.join(found.select(row_id, "_anywhere"), row_id, "left")
        owners.append("_anywhere")
    return rows.withColumn("owner", F.coalesce(*owners)).drop(*owners)


def drop_known_events(owned: DataFrame, skipped: DataFrame) -> DataFrame:
    """``owned`` events (owner, text, line_id) without those of ``skipped`` perspectives (perspective_id, line_id).

    A block that speaks of devices of other lines, too, stays, without an owner.
    """
    known = skipped.select(F.col("perspective_id").alias("owner"), F.col("line_id").alias("_line"), F.lit(True).alias("_known"))
    lines = F.array_distinct(F.regexp_extract_all("text", F.lit(r"Device name:[^\n]*?\bLine (\d+)"), 1))
    own = (F.size(lines) == 0) | F.coalesce((F.size(lines) == 1) & (F.get(lines, F.lit(0)).cast("int") == F.col("_line")), F.lit(False))
    rows = owned.join(known, "owner", "left").where(F.col("_known").isNull() | ~own)
    return rows.withColumn("owner", F.when(F.col("_known").isNull(), F.col("owner"))).drop("_known", "_line").select(*owned.columns)


def drop_known_rows(rows: DataFrame, skipped: DataFrame, kept: DataFrame, row_id: str, grace_us: int = 250_000) -> DataFrame:
    """``rows`` (import_id, line_id, ts) without those that stand in a window of a skipped call of their line and in none of a kept one."""
    key = ["import_id", "line_id"]
    held = lambda w: open_windows(rows, w.select(*key, "start", "end", F.lit(0).cast("long").alias("mark")), key, row_id, grace_us=grace_us).where("open > 0").select(row_id)
    return rows.join(held(skipped).join(held(kept), row_id, "left_anti"), row_id, "left_anti")


def dedup_metrics(metrics: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """Equal observations of an import once: the first by ``order``."""
    rest = [c for c in metrics.columns if c not in signature]
    return metrics.groupBy(*signature).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*signature, "_r.*")


def dedup_within_gap(df: DataFrame, key: list[str], ts: str = "ts", gap_us: int = SECOND) -> DataFrame:
    """Rows more than ``gap_us`` after the last row that was kept (not the last row).

    A row more than the gap after its predecessor is kept whatever came before, so that runs
    between such rows are groups of their own and only dense runs are walked.
    """
    by = Window.partitionBy(*key).orderBy(ts)
    far = micros(ts) - micros(F.lag(ts).over(by)) > gap_us
    rows = df.withColumn("_t", micros(ts)).withColumn("_run", F.sum(F.when(far, 1).otherwise(0)).over(by))

    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_run", "_t"], kind="stable")
        kept, last, run = [], 0, None
        for r, t in zip(batch["_run"], batch["_t"], strict=True):
            kept.append(r != run or t - last > gap_us)
            run, last = r, t if kept[-1] else last
        return batch[kept]

    rows = rows.withColumn("_part", F.floor(F.col("_run") / RUNS))
    return rows.groupBy(*key, "_part").applyInPandas(walk, rows.schema).drop("_t", "_run", "_part")


def mark_duplicates(perspectives: DataFrame, producers: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``perspectives`` with ``duplicate_of``: the earliest import of the same resolved producer that has the call.

    A mark goes where either import declares another role.
    """
    known = producers.where("status = 'resolved'").select("import_id", "producer")
    rows = perspectives.join(known, "import_id", "left")
    firsts = rows.where("producer IS NOT NULL AND call_id IS NOT NULL").groupBy("producer", "call_id").agg(F.min(F.struct("import_seq", "import_id")).alias("_f"))
    rows = rows.join(firsts, ["producer", "call_id"], "left")
    rows = rows.withColumn("duplicate_of", F.when(F.col("_f.import_id") != F.col("import_id"), F.col("_f.import_id"))).drop("_f")
    if roles is not None:
        own, other = roles.select("import_id", F.col("role").alias("_own")), roles.select(F.col("import_id").alias("duplicate_of"), F.col("role").alias("_other"))
        rows = rows.join(own, "import_id", "left").join(other, "duplicate_of", "left")
        rows = rows.withColumn("duplicate_of", F.when(~(F.coalesce(F.col("_own") != F.col("_other"), F.lit(False))), F.col("duplicate_of"))).drop("_own", "_other")
    return rows


def skip_known_calls(new: DataFrame, known: DataFrame) -> DataFrame:
    """Perspectives of an appended archive whose call the same producer hasn't brought yet."""
    held = known.where("producer IS NOT NULL").select("producer", "call_id").distinct()
    return new.join(held, ["producer", "call_id"], "left_anti")


def bound_open_windows(windows: DataFrame, evidence: DataFrame, key: list[str], terminations: DataFrame | None = None) -> DataFrame:
    """Windows without an end are over after their own last evidence, or at the first of ``terminations`` (key, ts) since their start."""
    last = evidence.groupBy(*key).agg(F.max("ts").alias("_last"))
    rows = windows.join(last, key, "left")
    if terminations is None:
        rows = rows.withColumn("_cut", F.lit(None).cast("timestamp_ntz"))
    else:
        both = rows.withColumn("_at", F.col("start")).unionByName(terminations.select(*key, F.col("ts").alias("_at"), F.lit(True).alias("_over")), allowMissingColumns=True)
        ahead = Window.partitionBy(*key).orderBy(F.desc("_at"), F.coalesce("_over", F.lit(False)).desc()).rowsBetween(Window.unboundedPreceding, 0)
        rows = both.withColumn("_cut", F.min(F.when(F.col("_over"), F.col("_at"))).over(ahead)).where("_over IS NULL").drop("_at", "_over")
    basis = F.when(F.col("end").isNotNull(), "observed_termination").when(F.col("_cut").isNotNull(), "terminate_event").when(F.col("_last").isNotNull(), "last_call_evidence")
    rows = rows.withColumn("end_basis", basis)
    return rows.withColumn("end", F.coalesce("end", "_cut", F.timestamp_add("MICROSECOND", F.lit(1), F.col("_last")))).drop("_last", "_cut")


def assign_manual_windows(rows: DataFrame, windows: DataFrame, row_id: str) -> DataFrame:
    """``rows`` without an owner get the analyst's window of their line that holds them; overlapping windows claim nothing."""
    loose, owned = rows.where("owner IS NULL").drop("owner"), rows.where("owner IS NOT NULL")
    given = windows.select("import_id", "line_id", "start", "end", F.col("window_id").alias("owner"))
    return unique_window(loose, given, ["import_id", "line_id"], ["owner"], row_id, grace_us=0).unionByName(owned)


def pair_attempts(records: DataFrame, most_us: int = SECOND) -> DataFrame:
    """Block notices with the request right before them in their file, at most a second earlier; else alone."""
    by = Window.partitionBy("import_id", "name").orderBy("line_no")
    rows = records.where("ts IS NOT NULL").withColumns({f"_p{c}": F.lag(c).over(by) for c in ("kind", "ts", "target", "line_no")})
    gap = micros("ts") - micros("_pts")
    paired = (F.col("_pkind") == "request") & gap.between(0, most_us)
    rows = rows.withColumn("paired", F.coalesce(paired, F.lit(False))).where("kind = 'blocked'")
    return rows.select("import_id", "name", "line_no", "ts", "paired", F.when(F.col("paired"), F.col("_ptarget")).otherwise(F.col("target")).alias("target"))


def conversation_groups(uuids: DataFrame, perspectives: DataFrame, manual: DataFrame | None = None, sessions: DataFrame | None = None, spread_us: int = 86_400 * SECOND) -> DataFrame:
    """Groups of calls, a row a member (group, basis, call_id, start, review): those that share a UUID, then calls with several perspectives, then given ones and sessions.

    ``uuids``: uuid, call_id, start. ``manual``: conversation, call_id. ``sessions``: session, call_id.
    ``start`` is that of the group's first call; ``review`` marks a group that has a call with several
    UUIDs or is spread over more than ``spread_us``. No group is gathered into one row.
    """
    several = uuids.groupBy("call_id").agg(F.count_distinct("uuid").alias("_n"))
    by_uuid = uuids.join(several, "call_id").groupBy("uuid").agg(F.min("start").alias("start"), F.max("start").alias("last"), F.max(F.col("_n") > 1).alias("_twice"))
    wide = F.coalesce(micros("last") - micros("start") > spread_us, F.lit(False))
    named = lambda prefix, c, basis: [F.concat(F.lit(prefix), F.col(c).cast("string")).alias("group"), F.lit(basis).alias("basis"), "call_id"]
    shared = uuids.select("uuid", "call_id").distinct().join(by_uuid, "uuid").select(*named("uuid:", "uuid", "shared_uuid"), "start", (F.col("_twice") | wide).alias("review"))
    rest = perspectives.join(uuids.select("call_id"), "call_id", "left_anti").where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("_n"), F.min("start").alias("start")).where("_n > 1")
    out = shared.unionByName(rest.select(*named("call:", "call_id", "several_perspectives"), "start", F.lit(False).alias("review")))
    none = [F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(False).alias("review")]
    if manual is not None:
        out = out.unionByName(manual.select(*named("manual:", "conversation", "manual"), *none).distinct())
    if sessions is not None:
        out = out.unionByName(sessions.select(*named("session:", "session", "session"), *none).distinct())
    return out


def local_receiver(perspectives: DataFrame, roles: DataFrame, accounts: DataFrame, producers: DataFrame) -> DataFrame:
    """Who receives: the declared participant, else the account, the producer or the import, with the basis."""
    rows = perspectives.join(roles.select("perspective_id", "participant"), "perspective_id", "left").join(accounts.select("import_id", "account"), "import_id", "left").join(producers.where("status = 'resolved'").select("import_id", "producer"), "import_id", "left")
    order = [("participant", "participant"), ("account", "account"), ("producer", "producer"), ("import_id", "import")]
    basis = F.lit(None).cast("string")
    for c, name in reversed(order):
        basis = F.when(F.col(c).isNotNull(), name).otherwise(basis)
    return rows.withColumns({"receiver": F.coalesce(*[F.col(c).cast("string") for c, _ in order]), "receiver_basis": basis})


def import_counts(perspectives: DataFrame) -> DataFrame:
    """Calls of an import: all, those it has brought first, those known before."""
    firsts = perspectives.groupBy("call_id").agg(F.min("import_seq").alias("_first"))
    rows = perspectives.select("import_id", "import_seq", "call_id").distinct().join(firsts, "call_id")
    return rows.groupBy("import_id", "import_seq").agg(F.count("*").alias("calls"), F.count_if(F.col("_first") == F.col("import_seq")).alias("new"), F.count_if(F.col("_first") < F.col("import_seq")).alias("known"))


def scope(tables: dict[str, DataFrame], call_ids: list[str] | None = None, start: Column | None = None, end: Column | None = None, include_duplicates: bool = False) -> dict[str, DataFrame]:
    """The perspectives that overlap [start, end) (of the given calls, without duplicates), and the rows of other tables that depend on them."""
    p = tables["perspectives"]
    if call_ids is not None:
        p = p.where(F.col("call_id").isin(*call_ids))
    if start is not None:
        p = p.where(F.col("end").isNull() | (F.col("end") > start))
    if end is not None:
        p = p.where(F.col("start") < end)
    if not include_duplicates and "duplicate_of" in p.columns:
        p = p.where("duplicate_of IS NULL")
    ids = p.select("perspective_id")
    return {n: p if n == "perspectives" else d.join(ids, "perspective_id", "left_semi") if "perspective_id" in d.columns else d for n, d in tables.items()}
