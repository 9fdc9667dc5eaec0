"""Ledger operators (B1-B10): old snapshot + event table -> new snapshot.

The reference mutates one row per call.  Here each mutation is a batch
transform: events are reduced per tool with *aggregates* (``max_by`` on the
arrival sequence, ``sum``) — partial aggregation means a tool with a huge
number of events never lands whole in one task — and the one-row-per-tool
result is joined to the snapshot.  Last-writer semantics follow arrival
order (``seq``), never the business date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions.dates import hours_between, ts_lit
from fleetkit.operators.sequence import WHOLE, hot_key_plan
from fleetkit.sources.tables import TOOL_COLUMNS

REQUIRED = ("tool_code", "tool_name", "category", "location")


# ---------------------------------------------------------------- B1, B2, C6
def classify_intake(intake: DataFrame, tools: DataFrame) -> DataFrame:
    """Every intake row with ``reject_reason`` (null when accepted).

    Sequential semantics of one-insert-per-row: a row with a missing required
    field fails; a code already stored fails; among the remaining rows of a
    code the first in arrival order wins, later ones are duplicates.  A row
    that is marked ``malformed`` (``files.with_malformed``) fails before all that.
    """
    missing = None
    for c in REQUIRED:
        cond = F.col(c).isNull()
        missing = cond if missing is None else (missing | cond)
    # stored codes among the batch's codes: an inner join, so AQE may
    # broadcast the (small) batch side and the tools table is only scanned
    batch_codes = intake.where(F.col("tool_code").isNotNull()).select("tool_code").distinct()
    stored = (tools.select("tool_code").join(batch_codes, "tool_code", "inner")
              .distinct().withColumn("_stored", F.lit(True)))
    sound = F.col("malformed").isNull() if "malformed" in intake.columns else F.lit(True)
    candidates = intake.where(sound & ~missing)
    # first arrival per code among complete rows (aggregate, not a window)
    first = candidates.groupBy("tool_code").agg(F.min("seq").alias("_first_seq"))
    out = (intake.join(stored, "tool_code", "left").join(first, "tool_code", "left"))
    broken = F.col("malformed") if "malformed" in intake.columns else F.lit(None).cast("string")
    reason = (F.when(~sound, F.concat(F.lit("malformed "), broken))
               .when(missing, F.lit("missing_required"))
               .when(F.col("_stored"), F.lit("already_exists"))
               .when(F.col("seq") > F.col("_first_seq"), F.lit("duplicate_in_batch")))
    return (out.withColumn("reject_reason", reason)
               .withColumn("outcome", F.when(F.col("reject_reason").isNull(), F.lit("added"))
                                        .otherwise(F.lit("error")))
               .drop("_stored", "_first_seq"))


def accepted_tools(intake: DataFrame, tools: DataFrame, as_of) -> DataFrame:
    """B1: accepted intake rows as new tool rows with table defaults."""
    ok = classify_intake(intake, tools).where(F.col("reject_reason").isNull())
    now = ts_lit(as_of)
    cols = {c: F.col(c) for c in ok.columns}
    return ok.select(
        "tool_code", "tool_name", "category", "location",
        (cols["purchase_date"] if "purchase_date" in cols else F.lit(None).cast("date")).alias("purchase_date"),
        (cols["last_maintenance_date"] if "last_maintenance_date" in cols else F.lit(None).cast("date"))
        .alias("last_maintenance_date"),
        (cols["next_maintenance_due"] if "next_maintenance_due" in cols else F.lit(None).cast("date"))
        .alias("next_maintenance_due"),
        F.coalesce(cols["status"] if "status" in cols else F.lit(None).cast("string"),
                   F.lit(K.DEFAULT_STATUS)).alias("status"),
        F.coalesce(F.col("condition_score"), F.lit(K.DEFAULT_CONDITION)).alias("condition_score"),
        F.lit(0.0).alias("usage_hours"),
        F.lit(0).cast("decimal(18,2)").alias("maintenance_cost"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def intake_summary(classified: DataFrame) -> DataFrame:
    """B2: one row of outcome counts."""
    r = F.col("reject_reason")
    return classified.agg(
        F.count_if(r.isNull()).alias("added"),
        F.count_if(r.isNotNull()).alias("errors"),
        F.count_if(r == "missing_required").alias("missing_required"),
        F.count_if(r == "already_exists").alias("already_exists"),
        F.count_if(r == "duplicate_in_batch").alias("duplicate_in_batch"),
        F.count(F.lit(1)).alias("total"),
    )


def form_valid(intake: DataFrame) -> DataFrame:
    """The form's stricter check (required fields non-null and non-empty)."""
    ok = None
    for c in REQUIRED:
        cond = F.col(c).isNotNull() & (F.col(c) != "")
        ok = cond if ok is None else (ok & cond)
    return intake.withColumn("form_valid", ok)


# ---------------------------------------------------------------- B3
def apply_status(tools: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """Latest update per code (arrival order) replaces the status and
    bumps ``updated_at`` even when the value is unchanged."""
    last = (updates.groupBy("tool_code")
            .agg(F.max_by("status", "seq").alias("_new_status"))
            .withColumn("_hit", F.lit(True)))
    j = tools.join(last, "tool_code", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[
        F.when(hit, F.col("_new_status")).otherwise(F.col("status")).alias("status") if c == "status"
        else F.when(hit, ts_lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at"
        else F.col(c)
        for c in TOOL_COLUMNS])


def unmatched_updates(tools: DataFrame, updates: DataFrame) -> DataFrame:
    """Codes whose update touched no row (the call would return False)."""
    return (updates.join(tools.select("tool_code"), "tool_code", "left_anti")
            .groupBy("tool_code").agg(F.count(F.lit(1)).alias("n_updates")))


# ---------------------------------------------------------------- B4
def usage_deltas(usage: DataFrame) -> DataFrame:
    """B4, first half: per-tool sum of the truthy durations (neither null
    nor 0) — one row per touched tool."""
    d = F.col("usage_duration")
    return (usage.where(d.isNotNull() & (d != 0)).groupBy("tool_code")
            .agg(F.sum(d).alias("added_hours")))


def apply_usage_deltas(tools: DataFrame, deltas: DataFrame, as_of) -> DataFrame:
    """B4, second half: add per-tool deltas (several rows per tool allowed,
    e.g. one per stream batch) to the snapshot."""
    per_tool = (deltas.groupBy("tool_code").agg(F.sum("added_hours").alias("_added"))
                .withColumn("_hit", F.lit(True)))
    j = tools.join(per_tool, "tool_code", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[
        (F.col("usage_hours") + F.coalesce(F.col("_added"), F.lit(0.0))).alias("usage_hours") if c == "usage_hours"
        else F.when(hit, ts_lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at"
        else F.col(c)
        for c in TOOL_COLUMNS])


def apply_usage(tools: DataFrame, usage: DataFrame, as_of) -> DataFrame:
    """usage_hours += sum of truthy durations; updated_at bumps only when
    some duration is neither null nor 0.  Orphan rows change nothing."""
    return apply_usage_deltas(tools, usage_deltas(usage), as_of)


# ---------------------------------------------------------------- B5
def apply_maintenance(tools: DataFrame, maintenance: DataFrame, as_of) -> DataFrame:
    """The last *arrived* record sets last_maintenance_date and the
    condition (10.0 when condition_after is absent); costs accumulate."""
    # fixed-width values only, so this plans as a HashAggregate
    per_tool = (maintenance.groupBy("tool_code").agg(
        F.max_by("maintenance_date", "seq").alias("_d"),
        F.max_by(F.coalesce(F.col("condition_after"), F.lit(K.DEFAULT_CONDITION)), "seq").alias("_c"),
        F.sum(F.coalesce(F.col("cost"), F.lit(0).cast("decimal(18,2)"))).alias("_cost"))
        .withColumn("_hit", F.lit(True)))
    j = tools.join(per_tool, "tool_code", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for c in TOOL_COLUMNS:
        if c == "last_maintenance_date":
            out.append(F.when(hit, F.col("_d")).otherwise(F.col(c)).alias(c))
        elif c == "condition_score":
            out.append(F.when(hit, F.col("_c")).otherwise(F.col(c)).alias(c))
        elif c == "maintenance_cost":
            out.append((F.col(c) + F.coalesce(F.col("_cost"), F.lit(0))).cast("decimal(18,2)").alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, ts_lit(as_of)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


# ---------------------------------------------------------------- B7
def orphan_rows(tools: DataFrame, usage: DataFrame, maintenance: DataFrame,
                predictions: DataFrame) -> DataFrame:
    """Rows of the three history tables whose tool does not exist."""
    keys = tools.select("tool_code")
    parts = []
    for name, df in (("usage_history", usage), ("maintenance_history", maintenance),
                     ("predictions", predictions)):
        parts.append(df.join(keys, "tool_code", "left_anti")
                       .select(F.lit(name).alias("source_table"), "tool_code"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- B8, B9
def _with_last_change(events: DataFrame, rows_per_task: int) -> DataFrame:
    """Adds prev_kind (of the tool's event before) and last_change: time, user, kind of the latest earlier event whose
    kind differs from the one before it, and whether it is the tool's first event.

    One window per tool.  A hot tool is cut into buckets (``operators.sequence``); what reaches a bucket from
    the earlier ones (the kind before it, the last change before it) comes from one summary row per
    bucket.  The summary has a bounded number of rows and is broadcast, so events are shuffled once."""
    ev, hot = hot_key_plan(events, "tool_code", ["ts", "seq"], "_bucket", rows_per_task)
    keys = ["tool_code", "_bucket"] if hot else ["tool_code"]
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    kind, prev = F.col("event_kind"), F.col("prev_kind")
    what = lambda first: F.struct("ts", "user_id", "event_kind", first.alias("first"))
    ev = ev.withColumn("prev_kind", F.lag(kind).over(w))
    carry = F.lit(None)
    if hot:
        at = F.struct("ts", "seq")
        edges = ev.where(F.col("_bucket") != WHOLE).groupBy(*keys).agg(
            F.min_by(what(F.lit(False)), at).alias("_first"), F.max_by(kind, at).alias("_last_kind"),
            F.max_by(what(F.lit(False)), F.when(kind != prev, at)).alias("_inside"))
        by_tool = Window.partitionBy("tool_code").orderBy("_bucket")
        edges = edges.withColumn("_before", F.lag("_last_kind").over(by_tool))
        start = F.when(F.col("_before").isNull() | (F.col("_first.event_kind") != F.col("_before")), F.struct(
            "_first.ts", "_first.user_id", "_first.event_kind", F.col("_before").isNull().alias("first")))
        edges = (edges.withColumn("_change", F.coalesce("_inside", start))
                 .withColumn("_carry", F.last("_change", ignorenulls=True).over(by_tool.rowsBetween(Window.unboundedPreceding, -1)))
                 .select(F.col("tool_code").alias("_t"), F.col("_bucket").alias("_b"), "_before", "_carry"))
        ev = (ev.join(F.broadcast(edges), (F.col("tool_code") == F.col("_t")) & (F.col("_bucket") == F.col("_b")), "left")
              .withColumn("prev_kind", F.coalesce("prev_kind", "_before")))
        carry = F.col("_carry")
    change = F.when(prev.isNull() | (kind != prev), what(prev.isNull()))
    last = F.last(change, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ev.withColumn("last_change", F.coalesce(last, carry)).select(
        "seq", "ts", "tool_code", "user_id", "event_kind", "prev_kind", "last_change")


def accepted_events(tools: DataFrame, usage: DataFrame, events: DataFrame,
                    rows_per_task: int = 2_000_000) -> DataFrame:
    """B8/B9 guards applied in arrival order per tool; events without a tool
    code, or of a kind that is neither check-out nor check-in, are never accepted.

    Check-out needs status 'available', check-in needs 'in_use' (and some
    usage row of the tool).  With two alternating states the event at
    position i > 1 is accepted exactly when its kind differs from the kind of
    event i-1; the first event must match the snapshot status.  A tool in use
    without any usage row, in maintenance, or unknown accepts nothing.

    Returns seq, ts, tool_code, user_id, event_kind and, for check-ins, the check-out that ends (out_time,
    out_user_id): the accepted event before, which is the last change of kind; the first accepted event
    of a tool that was already in use takes the newest stored usage row as of
    its own time: check-outs after the check-in do not count (a row without a
    check-out time counts, last).  Without such a row both are null.

    Events are shuffled once (by tool, see ``_with_last_change``); usage rows are read for tools in use only.
    """
    kind = F.col("event_kind")
    ev = events.where(F.col("tool_code").isNotNull() & kind.isin(K.CHECKOUT, K.CHECKIN))
    # a tool in use accepts its first check-in, whatever came before: that needs the stored history
    need = (tools.where(F.col("status") == "in_use").select("tool_code")
            .join(ev.where(kind == K.CHECKIN).groupBy("tool_code").agg(F.min(F.struct("ts", "seq"))["ts"].alias("_asof")), "tool_code"))
    as_of = F.col("checkout_time").isNull() | (F.col("checkout_time") <= F.col("_asof"))
    newest = F.struct(F.col("checkout_time").isNotNull(), F.col("checkout_time"), -F.col("seq"))
    stored = (usage.select("tool_code", "seq", "user_id", "checkout_time").join(need, "tool_code").groupBy("tool_code")
              .agg(F.max_by(F.struct("checkout_time", "user_id"), F.when(as_of, newest)).alias("_stored"))
              .withColumn("_has_usage", F.lit(True)))
    state = (tools.where(F.col("status").isin("available", "in_use")).select("tool_code", F.col("status").alias("_s0"))
             .join(stored, "tool_code", "left"))
    j = _with_last_change(ev, rows_per_task).join(state, "tool_code")
    available = F.col("_s0") == "available"
    first_kind = F.when(available, F.lit(K.CHECKOUT)).otherwise(F.lit(K.CHECKIN))
    prev, last = F.col("prev_kind"), F.col("last_change")
    ok = (available | F.col("_has_usage").isNotNull()) & F.when(prev.isNull(), kind == first_kind).otherwise(kind != prev)
    # the last change is the accepted event before, unless it is a first event that did not fit the snapshot
    known = last.isNotNull() & (~last["first"] | (last["event_kind"] == first_kind))
    out = lambda a, b: F.when(kind == K.CHECKIN, F.when(known, last[a]).otherwise(F.col("_stored")[b]))
    return j.where(ok).select("seq", "ts", "tool_code", "user_id", "event_kind", out("ts", "checkout_time").alias("out_time"),
                              out("user_id", "user_id").alias("out_user_id"))


def event_usage_rows(accepted: DataFrame) -> DataFrame:
    """The usage row that every accepted event writes, in one pass.

    A check-out row has no check-in time and duration.  A check-in row copies the
    user from its check-out; duration = elapsed seconds / 3600."""
    back = F.col("event_kind") == K.CHECKIN
    return accepted.select(
        "seq", "tool_code", F.when(back, F.col("out_user_id")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(back, F.col("out_time")).otherwise(F.col("ts")).alias("checkout_time"),
        F.when(back, F.col("ts")).alias("checkin_time"),
        F.when(back, hours_between(F.col("out_time"), F.col("ts"))).alias("usage_duration"),
        F.col("event_kind").alias("usage_type"))


def checkout_rows(accepted: DataFrame) -> DataFrame:
    """Usage rows written by accepted check-outs."""
    return event_usage_rows(accepted.where(F.col("event_kind") == K.CHECKOUT))


def checkin_rows(accepted: DataFrame) -> DataFrame:
    """Usage rows written by accepted check-ins."""
    return event_usage_rows(accepted.where(F.col("event_kind") == K.CHECKIN))


def latest_usage_row(usage: DataFrame) -> DataFrame:
    """the newest usage row per tool (checkout_time desc, nulls last;
    ties by arrival) — an aggregate, so hot tools stay split across tasks."""
    order = F.struct(F.col("checkout_time").isNotNull(), F.col("checkout_time"), -F.col("seq"))
    row = F.struct("seq", "user_id", "checkout_time", "usage_duration", "usage_type")
    return (usage.groupBy("tool_code").agg(F.max_by(row, order).alias("_r"))
            .select("tool_code", "_r.*"))


def status_after_events(tools: DataFrame, accepted: DataFrame, as_of) -> DataFrame:
    """Snapshot after B8/B9: the last accepted event decides the status."""
    last = (accepted.groupBy("tool_code")
            .agg(F.max_by("event_kind", F.struct("ts", "seq")).alias("_k"))
            .select("tool_code", F.when(F.col("_k") == K.CHECKOUT, F.lit("in_use"))
                    .otherwise(F.lit("available")).alias("status"), F.lit(True).alias("_hit")))
    j = tools.join(last.withColumnRenamed("status", "_new"), "tool_code", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[
        F.when(hit, F.col("_new")).otherwise(F.col("status")).alias("status") if c == "status"
        else F.when(hit, ts_lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at"
        else F.col(c) for c in TOOL_COLUMNS])


# ---------------------------------------------------------------- B10
def retained_usage(usage: DataFrame, as_of, days: int = K.RETENTION_DAYS_DEFAULT) -> DataFrame:
    """Usage rows younger than ``days`` days (by check-out, else check-in)."""
    cutoff = F.timestamp_add("DAY", F.lit(-days), ts_lit(as_of))
    out, back = F.col("checkout_time"), F.col("checkin_time")
    keep = (out >= cutoff) | (out.isNull() & (back >= cutoff))       # reaches the scan, a coalesce would not
    if "usage_month" in usage.columns:
        keep = keep & (F.col("usage_month") >= F.date_format(cutoff, "yyyy-MM"))
    return usage.where(keep)


# ---------------------------------------------------------------- G6
def usage_union(history: DataFrame, *new_rows: DataFrame) -> DataFrame:
    """Append rows to the usage history (missing columns become null)."""
    out = history
    for df in new_rows:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
