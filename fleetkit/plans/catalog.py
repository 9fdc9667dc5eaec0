"""Registered queries: key -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)``, reads the scale directory through the
adapters and runs library operators over the *whole* tables.  Computed
floating columns are rounded to 6 digits in both engines (``r6``) so the
value hash compares numbers, not summation order.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions import rules as R
from fleetkit.functions.dates import days_since, days_until, tolerant_date, tolerant_timestamp
from fleetkit.operators import digests, encode, filters, joins, kpis, labels, ledger, risk, windows
from fleetkit.operators.features import prepare_features
from fleetkit.plans.adapters_sql import with_adapters
from fleetkit.sources import files
from fleetkit.sources import tables as A
from fleetkit.sources.testdata import load

AS_OF = K.AS_OF
LOOKUP_CODE = "TL-000042"
USAGE_CODE = "TL-000007"
TODAY = _dt.date(2000, 6, 15)
FACET_STATUSES = ["available", "in_use"]
FACET_CATEGORIES = ["ECONOMY", "PROMO", "SMALL"]
FACET_LOCATIONS = [f"Brand#{i}" for i in range(1, 13)]
RECIPIENTS = "maintenance@example.org, supervisor@example.org,, ,planner@example.org"
RETENTION_DAYS = 90

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

# SQL spellings of the shared rules ------------------------------------------
ASOF_TS = "TIMESTAMP '2001-12-01 12:00:00'"
ASOF_D = "DATE '2001-12-01'"


def sql_days_since(col: str) -> str:
    return (f"CAST(floor(date_diff('microsecond', CAST({col} AS TIMESTAMP), {ASOF_TS}) "
            f"/ 86400000000.0) AS INTEGER)")


def sql_days_until(col: str) -> str:
    return (f"CAST(floor(date_diff('microsecond', {ASOF_TS}, CAST({col} AS TIMESTAMP)) "
            f"/ 86400000000.0) AS INTEGER)")


def sql_due(days: int) -> str:
    return f"next_maintenance_due <= {ASOF_D} + {days} AND status <> 'maintenance'"


def sql_alert_label(d: str) -> str:
    return (f"CASE WHEN {d} < 0 THEN 'OVERDUE by ' || CAST(abs({d}) AS VARCHAR) || ' days' "
            f"ELSE 'Due in ' || CAST({d} AS VARCHAR) || ' days' END")


def sql_r2(x: str) -> str:
    return f"(round_even(({x}) * 100.0, 0) / 100.0)"


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def register(key: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[key] = (fn, with_adapters(sql) if sql is not None else None)
        return fn
    return deco


TOOL_OUT = ["tool_code", "tool_name", "category", "location", "purchase_date",
            "last_maintenance_date", "next_maintenance_due", "status", "condition_score",
            "usage_hours", "maintenance_cost", "created_at", "updated_at"]
TOOL_OUT_SQL = ", ".join(c if c != "maintenance_cost" else "CAST(maintenance_cost AS DOUBLE) AS maintenance_cost"
                         for c in TOOL_OUT)


def tool_out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c == "maintenance_cost" else F.col(c)
                       for c in TOOL_OUT])


USAGE_OUT = "seq, tool_code, user_id, checkout_time, checkin_time, usage_duration, usage_type, notes, created_at"
MAINT_OUT_SQL = ("seq, tool_code, maintenance_date, maintenance_type, description, CAST(cost AS DOUBLE) AS cost, "
                 "technician, condition_before, condition_after, created_at")


def maint_out(df: DataFrame) -> DataFrame:
    return df.select("seq", "tool_code", "maintenance_date", "maintenance_type", "description",
                     F.col("cost").cast("double").alias("cost"), "technician", "condition_before",
                     "condition_after", "created_at")


# ============================================================== 2.1 sources
@register("tools_scan", f"SELECT {TOOL_OUT_SQL} FROM tools")
def q_tools_scan(spark, sf):
    return tool_out(A.tools_scan(load(spark, sf).tools))


@register("tool_lookup", f"SELECT {TOOL_OUT_SQL} FROM tools WHERE tool_code = '{LOOKUP_CODE}'")
def q_tool_lookup(spark, sf):
    return tool_out(A.tool_lookup(load(spark, sf).tools, LOOKUP_CODE))


@register("usage_scan", f"SELECT {USAGE_OUT} FROM usage_history ORDER BY checkout_time DESC NULLS LAST, seq")
def q_usage_scan(spark, sf):
    return A.usage_scan(load(spark, sf).usage)


@register("usage_by_tool", f"SELECT {USAGE_OUT} FROM usage_history WHERE tool_code = '{USAGE_CODE}' "
                           f"ORDER BY checkout_time DESC NULLS LAST, seq")
def q_usage_by_tool(spark, sf):
    return A.usage_scan(load(spark, sf).usage, USAGE_CODE)


PRED_SQL = f"""
predictions AS (
  SELECT tool_code, {ASOF_D} AS prediction_date,
         CAST({ASOF_D} + days AS DATE) AS predicted_failure_date,
         confidence_score,
         CASE WHEN confidence_score > 0.8 THEN 'Critical' WHEN confidence_score > 0.6 THEN 'High'
              WHEN confidence_score > 0.4 THEN 'Medium' ELSE 'Low' END AS maintenance_priority,
         '1.0' AS model_version, {ASOF_TS} AS created_at,
         days AS days_until_maintenance, condition_risk, anomaly_risk
  FROM (SELECT *, greatest(1, CAST(trunc(30.0 * (1.0 - confidence_score)) AS INTEGER)) AS days
        FROM (SELECT tool_code, cr AS condition_risk, ar AS anomaly_risk,
                     cr * CAST(0.7 AS DOUBLE) + ar * CAST(0.3 AS DOUBLE) AS confidence_score
              FROM (SELECT tool_code, least(condition_pred / 10.0, 1.0) AS cr,
                           1.0 / (1.0 + exp(anomaly_score)) AS ar FROM prediction_inputs))))
"""
PRED_OUT_SQL = ("tool_code, prediction_date, predicted_failure_date, round(confidence_score, 6) AS confidence_score, "
                "maintenance_priority, model_version, created_at, days_until_maintenance, "
                "round(condition_risk, 6) AS condition_risk, round(anomaly_risk, 6) AS anomaly_risk")


def predictions(spark, sf) -> DataFrame:
    return risk.fuse(load(spark, sf).prediction_inputs, AS_OF)


def pred_out(df: DataFrame) -> DataFrame:
    return df.select("tool_code", "prediction_date", "predicted_failure_date", r6("confidence_score").alias("confidence_score"),
                     "maintenance_priority", "model_version", "created_at", "days_until_maintenance",
                     r6("condition_risk").alias("condition_risk"), r6("anomaly_risk").alias("anomaly_risk"))


@register("predictions_scan", f"{PRED_SQL} SELECT {PRED_OUT_SQL} FROM predictions "
                              f"ORDER BY confidence_score DESC, prediction_date DESC, tool_code")
def q_predictions_scan(spark, sf):
    return pred_out(A.predictions_scan(predictions(spark, sf)))


@register("predictions_by_tool", f"{PRED_SQL} SELECT {PRED_OUT_SQL} FROM predictions WHERE tool_code = '{USAGE_CODE}' "
                                 f"ORDER BY prediction_date DESC, created_at DESC, confidence_score DESC")
def q_predictions_by_tool(spark, sf):
    """A4, one tool."""
    return pred_out(A.predictions_scan(predictions(spark, sf), USAGE_CODE))


@register("due_7d", f"SELECT {TOOL_OUT_SQL} FROM tools WHERE {sql_due(7)} ORDER BY next_maintenance_due, tool_code")
def q_due_7d(spark, sf):
    return tool_out(A.due_scan(load(spark, sf).tools, AS_OF, 7))


@register("due_30d", f"SELECT {TOOL_OUT_SQL} FROM tools WHERE {sql_due(30)} ORDER BY next_maintenance_due, tool_code")
def q_due_30d(spark, sf):
    return tool_out(A.due_scan(load(spark, sf).tools, AS_OF, 30))


@register("tools_json", "SELECT tool_code, tool_name, category, location, status, condition_score, usage_hours FROM tools")
def q_tools_json(spark, sf):
    return filters.api_projection(load(spark, sf).tools)


@register("tools_json_text", """
SELECT CAST(to_json({'tool_code': tool_code, 'tool_name': tool_name, 'category': category, 'location': location,
                     'status': status, 'condition_score': condition_score, 'usage_hours': usage_hours}) AS VARCHAR) AS json
FROM tools""")
def q_tools_json_text(spark, sf):
    """A9 + S17: one JSON object per tool."""
    return files.tools_json(load(spark, sf).tools)


@register("maintenance_log", f"SELECT {MAINT_OUT_SQL} FROM maintenance_history ORDER BY maintenance_date DESC, seq DESC")
def q_maintenance_log(spark, sf):
    return maint_out(A.maintenance_log(load(spark, sf).maintenance))


# ============================================================== 2.2 ledger
INTAKE_CLS = """
cls AS (
  SELECT i.seq, i.tool_code, i.tool_name, i.category, i.location, i.purchase_date, i.condition_score,
         CASE WHEN i.tool_code IS NULL OR i.tool_name IS NULL OR i.category IS NULL OR i.location IS NULL
                THEN 'missing_required'
              WHEN t.tool_code IS NOT NULL THEN 'already_exists'
              WHEN i.seq > f.first_seq THEN 'duplicate_in_batch' END AS reject_reason
  FROM intake i
  LEFT JOIN (SELECT DISTINCT tool_code FROM tools) t ON i.tool_code = t.tool_code
  LEFT JOIN (SELECT tool_code, min(seq) AS first_seq FROM intake
             WHERE tool_code IS NOT NULL AND tool_name IS NOT NULL AND category IS NOT NULL AND location IS NOT NULL
             GROUP BY tool_code) f ON i.tool_code = f.tool_code)
"""


@register("intake_accepted", f"""{INTAKE_CLS}
SELECT tool_code, tool_name, category, location, purchase_date, CAST(NULL AS DATE) AS last_maintenance_date,
       CAST(NULL AS DATE) AS next_maintenance_due, 'available' AS status,
       coalesce(condition_score, 10.0) AS condition_score, CAST(0.0 AS DOUBLE) AS usage_hours,
       CAST(0.0 AS DOUBLE) AS maintenance_cost, {ASOF_TS} AS created_at, {ASOF_TS} AS updated_at
FROM cls WHERE reject_reason IS NULL""")
def q_intake_accepted(spark, sf):
    f = load(spark, sf)
    return tool_out(ledger.accepted_tools(f.intake, f.tools, AS_OF))


@register("intake_rejects", f"{INTAKE_CLS} SELECT seq, tool_code, reject_reason FROM cls WHERE reject_reason IS NOT NULL")
def q_intake_rejects(spark, sf):
    f = load(spark, sf)
    return (ledger.classify_intake(f.intake, f.tools).where(F.col("reject_reason").isNotNull())
            .select("seq", "tool_code", "reject_reason"))


@register("intake_summary", f"""{INTAKE_CLS}
SELECT count(*) FILTER (WHERE reject_reason IS NULL) AS added,
       count(*) FILTER (WHERE reject_reason IS NOT NULL) AS errors,
       count(*) FILTER (WHERE reject_reason = 'missing_required') AS missing_required,
       count(*) FILTER (WHERE reject_reason = 'already_exists') AS already_exists,
       count(*) FILTER (WHERE reject_reason = 'duplicate_in_batch') AS duplicate_in_batch,
       count(*) AS total
FROM cls""")
def q_intake_summary(spark, sf):
    f = load(spark, sf)
    return ledger.intake_summary(ledger.classify_intake(f.intake, f.tools))


@register("intake_preview", """
SELECT seq, tool_code, tool_name, category, location, purchase_date, condition_score FROM intake ORDER BY seq LIMIT 5""")
def q_intake_preview(spark, sf):
    """The first rows of a batch in arrival order."""
    return files.preview(load(spark, sf).intake, "seq").select(
        "seq", "tool_code", "tool_name", "category", "location", "purchase_date", "condition_score")


@register("intake_form_valid", """
SELECT seq, tool_code,
       (tool_code IS NOT NULL AND tool_code <> '' AND tool_name IS NOT NULL AND tool_name <> ''
        AND category IS NOT NULL AND category <> '' AND location IS NOT NULL AND location <> '') AS form_valid
FROM intake""")
def q_intake_form_valid(spark, sf):
    return ledger.form_valid(load(spark, sf).intake).select("seq", "tool_code", "form_valid")


@register("status_apply", f"""
u AS (SELECT tool_code, arg_max(status, seq) AS new_status FROM status_updates GROUP BY tool_code)
SELECT t.tool_code, CASE WHEN u.tool_code IS NOT NULL THEN u.new_status ELSE t.status END AS status,
       CASE WHEN u.tool_code IS NOT NULL THEN {ASOF_TS} ELSE t.updated_at END AS updated_at
FROM tools t LEFT JOIN u ON t.tool_code = u.tool_code""")
def q_status_apply(spark, sf):
    f = load(spark, sf)
    return ledger.apply_status(f.tools, f.status_updates, AS_OF).select("tool_code", "status", "updated_at")


@register("status_unmatched", """
SELECT tool_code, count(*) AS n_updates FROM status_updates
WHERE tool_code NOT IN (SELECT tool_code FROM tools) GROUP BY tool_code""")
def q_status_unmatched(spark, sf):
    f = load(spark, sf)
    return ledger.unmatched_updates(f.tools, f.status_updates)


USAGE_APPLY_SQL = f"""
u AS (SELECT tool_code, sum(usage_duration) AS added FROM usage_history
      WHERE usage_duration IS NOT NULL AND usage_duration <> 0 GROUP BY tool_code)
SELECT t.tool_code, round(t.usage_hours + coalesce(u.added, 0.0), 6) AS usage_hours,
       CASE WHEN u.tool_code IS NOT NULL THEN {ASOF_TS} ELSE t.updated_at END AS updated_at
FROM tools t LEFT JOIN u ON t.tool_code = u.tool_code"""


@register("usage_apply", USAGE_APPLY_SQL)
def q_usage_apply(spark, sf):
    f = load(spark, sf)
    return (ledger.apply_usage(f.tools, f.usage, AS_OF)
            .select("tool_code", r6("usage_hours").alias("usage_hours"), "updated_at"))


@register("maintenance_apply", f"""
m AS (SELECT tool_code, arg_max(maintenance_date, seq) AS d, arg_max(coalesce(condition_after, 10.0), seq) AS c,
             sum(coalesce(cost, 0)) AS cost
      FROM maintenance_facts GROUP BY tool_code)
SELECT t.tool_code,
       CASE WHEN m.tool_code IS NOT NULL THEN m.d ELSE t.last_maintenance_date END AS last_maintenance_date,
       CASE WHEN m.tool_code IS NOT NULL THEN m.c ELSE t.condition_score END AS condition_score,
       CAST(t.maintenance_cost + coalesce(m.cost, 0) AS DOUBLE) AS maintenance_cost,
       CASE WHEN m.tool_code IS NOT NULL THEN {ASOF_TS} ELSE t.updated_at END AS updated_at
FROM tools t LEFT JOIN m ON t.tool_code = m.tool_code""")
def q_maintenance_apply(spark, sf):
    f = load(spark, sf)
    return (ledger.apply_maintenance(f.tools, f.maintenance_facts, AS_OF)
            .select("tool_code", "last_maintenance_date", "condition_score",
                    F.col("maintenance_cost").cast("double").alias("maintenance_cost"), "updated_at"))


@register("orphan_rows", f"""{PRED_SQL}
SELECT 'usage_history' AS source_table, tool_code FROM usage_history
WHERE tool_code NOT IN (SELECT tool_code FROM listed_tools)
UNION ALL
SELECT 'maintenance_history', tool_code FROM maintenance_facts
WHERE tool_code NOT IN (SELECT tool_code FROM listed_tools)
UNION ALL
SELECT 'predictions', tool_code FROM predictions WHERE tool_code NOT IN (SELECT tool_code FROM listed_tools)""")
def q_orphan_rows(spark, sf):
    """B7 against a catalogue that has lost some tools."""
    f = load(spark, sf)
    return ledger.orphan_rows(f.listed_tools, f.usage, f.maintenance_facts, predictions(spark, sf))


ACCEPTED_SQL = """
history AS (SELECT * FROM usage_history UNION ALL SELECT * FROM recent_usage),
ev AS (SELECT e.*, lag(event_kind) OVER (PARTITION BY tool_code ORDER BY ts, seq) AS prev_kind FROM tool_events e),
acc AS (
  SELECT ev.seq, ev.ts, ev.tool_code, ev.user_id, ev.event_kind
  FROM ev LEFT JOIN tools t ON ev.tool_code = t.tool_code
  LEFT JOIN (SELECT DISTINCT tool_code FROM history) h ON ev.tool_code = h.tool_code
  WHERE (t.status = 'available' OR (t.status = 'in_use' AND h.tool_code IS NOT NULL))
    AND CASE WHEN ev.prev_kind IS NULL
             THEN ev.event_kind = CASE WHEN t.status = 'available' THEN 'checkout' ELSE 'checkin' END
             ELSE ev.event_kind <> ev.prev_kind END)
"""


def history(f) -> DataFrame:
    """Stored usage rows, some of them later than the replayed tool events."""
    return f.usage.unionByName(f.recent_usage)


def accepted(f) -> DataFrame:
    return ledger.accepted_events(f.tools, history(f), f.tool_events)


@register("checkout_apply", f"""{ACCEPTED_SQL}
SELECT seq, tool_code, user_id, ts AS checkout_time, CAST(NULL AS TIMESTAMP) AS checkin_time,
       CAST(NULL AS DOUBLE) AS usage_duration, 'checkout' AS usage_type
FROM acc WHERE event_kind = 'checkout'""")
def q_checkout_apply(spark, sf):
    return ledger.checkout_rows(accepted(load(spark, sf)))


@register("events_status", f"""{ACCEPTED_SQL},
l AS (SELECT tool_code, arg_max(event_kind, (ts, seq)) AS kind FROM acc GROUP BY tool_code)
SELECT t.tool_code, CASE l.kind WHEN 'checkout' THEN 'in_use' WHEN 'checkin' THEN 'available' ELSE t.status END AS status,
       CASE WHEN l.kind IS NULL THEN t.updated_at ELSE {ASOF_TS} END AS updated_at
FROM tools t LEFT JOIN l ON t.tool_code = l.tool_code""")
def q_events_status(spark, sf):
    """The tools snapshot after the accepted check-outs and check-ins."""
    f = load(spark, sf)
    return ledger.status_after_events(f.tools, accepted(f), AS_OF).select("tool_code", "status", "updated_at")


CHECKIN_SQL = f"""{ACCEPTED_SQL},
accp AS (SELECT a.*, lag(ts) OVER w AS prev_ts, lag(user_id) OVER w AS prev_user, lag(event_kind) OVER w AS prev_kind
         FROM acc a WINDOW w AS (PARTITION BY tool_code ORDER BY ts, seq)),
ci AS (SELECT p.seq, p.tool_code,
              CASE WHEN p.prev_kind IS NOT NULL THEN p.prev_user ELSE l.h_user END AS user_id,
              CASE WHEN p.prev_kind IS NOT NULL THEN p.prev_ts ELSE l.h_time END AS checkout_time,
              p.ts AS checkin_time
       FROM accp p LEFT JOIN (
         SELECT q.seq, arg_max(h.user_id, k) AS h_user, arg_max(struct_pack(t := h.checkout_time), k).t AS h_time
         FROM (SELECT seq, tool_code, ts FROM accp WHERE prev_kind IS NULL AND event_kind = 'checkin') q
         JOIN (SELECT *, (checkout_time IS NOT NULL, checkout_time, -seq) AS k FROM history) h
           ON h.tool_code = q.tool_code AND (h.checkout_time IS NULL OR h.checkout_time <= q.ts)
         GROUP BY q.seq) l ON p.seq = l.seq
       WHERE p.event_kind = 'checkin')
"""


@register("checkin_apply", f"""{CHECKIN_SQL}
SELECT seq, tool_code, user_id, checkout_time, checkin_time,
       round(date_diff('microsecond', checkout_time, checkin_time) / 3600000000.0, 6) AS usage_duration,
       'checkin' AS usage_type
FROM ci""")
def q_checkin_apply(spark, sf):
    f = load(spark, sf)
    return ledger.checkin_rows(accepted(f)).withColumn("usage_duration", r6("usage_duration"))


@register("usage_retained", f"""SELECT {USAGE_OUT} FROM usage_history
WHERE coalesce(checkout_time, checkin_time) >= {ASOF_TS} - INTERVAL {RETENTION_DAYS} DAY""")
def q_usage_retained(spark, sf):
    return ledger.retained_usage(load(spark, sf).usage, AS_OF, RETENTION_DAYS)


@register("usage_union", f"""{CHECKIN_SQL}
SELECT seq, tool_code, user_id, checkout_time, checkin_time, usage_duration, usage_type FROM history
UNION ALL
SELECT seq, tool_code, user_id, ts, CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE), 'checkout' FROM acc
WHERE event_kind = 'checkout'
UNION ALL
SELECT seq, tool_code, user_id, checkout_time, checkin_time,
       date_diff('microsecond', checkout_time, checkin_time) / 3600000000.0, 'checkin' FROM ci""")
def q_usage_union(spark, sf):
    f = load(spark, sf)
    out = ledger.usage_union(history(f), ledger.event_usage_rows(accepted(f)))
    return out.select("seq", "tool_code", "user_id", "checkout_time", "checkin_time", "usage_duration", "usage_type")


# ============================================================== 2.3 predicates
def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@register("facet_filter", f"""SELECT {TOOL_OUT_SQL} FROM tools
WHERE status IN ({_in(FACET_STATUSES)}) AND category IN ({_in(FACET_CATEGORIES)})
  AND location IN ({_in(FACET_LOCATIONS)})""")
def q_facet_filter(spark, sf):
    return tool_out(filters.facet_filter(load(spark, sf).tools, FACET_STATUSES, FACET_CATEGORIES, FACET_LOCATIONS))


@register("facet_values", """
SELECT DISTINCT facet, value FROM (
  SELECT 'status' AS facet, status AS value FROM tools
  UNION ALL SELECT 'category', category FROM tools
  UNION ALL SELECT 'location', location FROM tools)""")
def q_facet_values(spark, sf):
    return filters.facet_values(load(spark, sf).tools)


@register("risk_over_threshold", f"{PRED_SQL} SELECT tool_code, round(confidence_score, 6) AS confidence_score, "
                                 f"maintenance_priority FROM predictions WHERE confidence_score > 0.7")
def q_risk_over_threshold(spark, sf):
    return (filters.risk_over(predictions(spark, sf), K.RISK_CHART)
            .select("tool_code", r6("confidence_score").alias("confidence_score"), "maintenance_priority"))


@register("urgent_items", f"""
SELECT tool_code, tool_name, next_maintenance_due, d AS days_until, {sql_alert_label('d')} AS urgency_text
FROM (SELECT *, {sql_days_until('next_maintenance_due')} AS d FROM tools WHERE {sql_due(30)}) WHERE d <= 3""")
def q_urgent_items(spark, sf):
    due = A.due_scan(load(spark, sf).tools, AS_OF, K.DUE_HORIZON_PAGE)
    return (filters.urgent_items(due, AS_OF)
            .select("tool_code", "tool_name", "next_maintenance_due", "days_until", "urgency_text"))


@register("maintenance_flag", f"""
SELECT tool_code, d AS days_until,
       CASE WHEN d < 0 THEN 'overdue' WHEN d <= 7 THEN 'warn' END AS flag
FROM (SELECT tool_code, {sql_days_until('next_maintenance_due')} AS d FROM tools
      WHERE next_maintenance_due IS NOT NULL)""")
def q_maintenance_flag(spark, sf):
    return filters.maintenance_flags(load(spark, sf).tools, AS_OF)


# ============================================================== 2.4 joins
@register("scan_enrich", """
SELECT s.seq, s.ts, s.code, t.tool_name, t.status, t.category, t.location, t.tool_code IS NOT NULL AS found
FROM scans s LEFT JOIN tools t ON s.code = t.tool_code""")
def q_scan_enrich(spark, sf):
    f = load(spark, sf)
    return joins.scan_enrich(f.scans, f.tools).select("seq", "ts", "code", "tool_name", "status", "category",
                                                      "location", "found")


@register("risk_digest", f"""{PRED_SQL}
SELECT p.tool_code, t.tool_name, t.location,
       printf('%.1f', round(p.confidence_score * 100.0, 1)) || '%' AS risk_text,
       p.maintenance_priority, p.predicted_failure_date, p.days_until_maintenance,
       '{K.RISK_ALERT_ACTION}' AS recommended_action
FROM predictions p JOIN tools t ON p.tool_code = t.tool_code WHERE p.confidence_score > 0.8""")
def q_risk_digest(spark, sf):
    f = load(spark, sf)
    return joins.risk_digest(predictions(spark, sf), f.tools)


# ============================================================== 2.5 aggregations
@register("inventory_kpis", f"""
SELECT total_tools, available_tools, in_use_tools,
       round(CASE WHEN total_tools > 0 THEN available_tools * 100.0 / total_tools ELSE 0.0 END, 6) AS available_pct,
       round(CASE WHEN total_tools > 0 THEN in_use_tools * 100.0 / total_tools ELSE 0.0 END, 6) AS in_use_pct,
       maintenance_due, CASE WHEN maintenance_due > 5 THEN 'Urgent' ELSE 'Normal' END AS maintenance_flag
FROM (SELECT count(*) AS total_tools, count(*) FILTER (WHERE status = 'available') AS available_tools,
             count(*) FILTER (WHERE status = 'in_use') AS in_use_tools,
             count(*) FILTER (WHERE {sql_due(7)}) AS maintenance_due FROM tools)""")
def q_inventory_kpis(spark, sf):
    df = kpis.inventory_kpis(load(spark, sf).tools, AS_OF)
    return df.withColumn("available_pct", r6("available_pct")).withColumn("in_use_pct", r6("in_use_pct"))


@register("api_kpis", """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'available') AS available,
       count(*) FILTER (WHERE status = 'in_use') AS in_use,
       count(*) FILTER (WHERE status = 'maintenance') AS maintenance_due FROM tools""")
def q_api_kpis(spark, sf):
    return kpis.api_kpis(load(spark, sf).tools)


@register("status_counts", "SELECT status, count(*) AS n_tools FROM tools WHERE status IS NOT NULL GROUP BY status "
                           "ORDER BY n_tools DESC, status")
def q_status_counts(spark, sf):
    return kpis.status_counts(load(spark, sf).tools)


@register("category_counts", "SELECT category, count(*) AS n_tools FROM tools WHERE category IS NOT NULL "
                             "GROUP BY category ORDER BY n_tools DESC, category")
def q_category_counts(spark, sf):
    return kpis.category_counts(load(spark, sf).tools)


MAINT_TOOLS_SQL = """
mt AS (
  SELECT t.tool_code, t.condition_score,
         CAST(t.maintenance_cost + coalesce(m.cost, 0) AS DECIMAL(18,2)) AS maintenance_cost
  FROM tools t LEFT JOIN (SELECT tool_code, arg_max(coalesce(condition_after, 10.0), seq) AS c,
                                 sum(coalesce(cost, 0)) AS cost FROM maintenance_facts GROUP BY tool_code) m
       ON t.tool_code = m.tool_code)
"""


@register("analytics_kpis", f"""{MAINT_TOOLS_SQL}
SELECT (SELECT round(avg(usage_duration), 6) FROM usage_history) AS avg_usage_hours,
       (SELECT round(CAST(sum(maintenance_cost) AS DOUBLE), 6) FROM mt) AS total_maintenance_cost,
       (SELECT round(avg(condition_score), 6) FROM tools) AS avg_condition_score""")
def q_analytics_kpis(spark, sf):
    f = load(spark, sf)
    costed = ledger.apply_maintenance(f.tools, f.maintenance_facts, AS_OF).select("tool_code", "maintenance_cost")
    base = f.tools.drop("maintenance_cost").join(costed, "tool_code", "left")
    df = kpis.analytics_kpis(f.usage, base)
    return df.select(*[r6(c).alias(c) for c in df.columns])


DAILY_USAGE_SQL = """
SELECT CAST(checkout_time AS DATE) AS usage_date, round(coalesce(sum(usage_duration), 0.0), 6) AS total_hours
FROM usage_history WHERE checkout_time IS NOT NULL GROUP BY 1"""


@register("daily_usage", DAILY_USAGE_SQL)
def q_daily_usage(spark, sf):
    return kpis.daily_usage(load(spark, sf).usage).withColumn("total_hours", r6("total_hours"))


RANGE = (_dt.date(2000, 1, 1), _dt.date(2000, 12, 31))


@register("daily_usage_range", f"""
SELECT CAST(checkout_time AS DATE) AS usage_date, round(coalesce(sum(usage_duration), 0.0), 6) AS total_hours
FROM usage_history WHERE CAST(checkout_time AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY 1""")
def q_daily_usage_range(spark, sf):
    """C5 on E6: one year."""
    return kpis.daily_usage(load(spark, sf).usage, *RANGE).withColumn("total_hours", r6("total_hours"))


TODAY_SQL = f"""
today AS (
  SELECT coalesce(sum(usage_duration), 0.0) AS total_hours, count(DISTINCT tool_code) AS active_tools,
         CASE WHEN count(*) = 0 THEN 0.0 ELSE avg(usage_duration) END AS avg_usage
  FROM usage_history WHERE CAST(checkout_time AS DATE) = DATE '{TODAY.isoformat()}')
"""


@register("today_usage", f"{TODAY_SQL} SELECT round(total_hours, 6) AS total_hours, active_tools, "
                         f"round(avg_usage, 6) AS avg_usage FROM today")
def q_today_usage(spark, sf):
    df = kpis.today_usage(load(spark, sf).usage, TODAY)
    return df.select(r6("total_hours").alias("total_hours"), "active_tools", r6("avg_usage").alias("avg_usage"))


@register("condition_histogram", """
SELECT bin, CASE WHEN bin >= 0 THEN CAST(bin AS DOUBLE) END AS bin_low,
       CASE WHEN bin < 10 THEN CAST(bin + 1 AS DOUBLE) END AS bin_high, count(*) AS n_tools
FROM (SELECT CAST(CASE WHEN condition_score < 0.0 THEN -1 WHEN condition_score > 10.0 THEN 10
                       ELSE least(floor(condition_score / 1.0), 9) END AS INTEGER) AS bin FROM tools
      WHERE condition_score IS NOT NULL) GROUP BY bin""")
def q_condition_histogram(spark, sf):
    return kpis.condition_histogram(load(spark, sf).tools)


USAGE_STATS_SQL = f"""
us AS (SELECT tool_code,
              {sql_r2('coalesce(sum(usage_duration), 0.0)')} AS total_usage_hours,
              {sql_r2('avg(usage_duration)')} AS avg_usage_hours,
              count(usage_duration) AS usage_count, count(checkout_time) AS checkout_count
       FROM usage_history GROUP BY tool_code)
"""
MAINT_STATS_SQL = f"""
ms AS (SELECT tool_code,
              {sql_r2('coalesce(CAST(sum(cost) AS DOUBLE), 0.0)')} AS total_maintenance_cost,
              {sql_r2('CASE WHEN count(cost) = 0 THEN NULL ELSE CAST(sum(cost) AS DOUBLE) / count(cost) END')}
                AS avg_maintenance_cost,
              count(cost) AS maintenance_count, max(maintenance_date) AS last_maintenance
       FROM maintenance_facts GROUP BY tool_code)
"""


@register("usage_stats", f"{USAGE_STATS_SQL} SELECT * FROM us")
def q_usage_stats(spark, sf):
    return kpis.usage_stats(load(spark, sf).usage)


@register("maintenance_stats", f"{MAINT_STATS_SQL} SELECT * FROM ms")
def q_maintenance_stats(spark, sf):
    return kpis.maintenance_stats(load(spark, sf).maintenance_facts)


@register("daily_summary", f"""{TODAY_SQL}
SELECT a.*, round(today.total_hours, 6) AS total_hours, today.active_tools, round(today.avg_usage, 6) AS avg_usage
FROM (SELECT count(*) AS total_tools, count(*) FILTER (WHERE status = 'available') AS available_tools,
             count(*) FILTER (WHERE status = 'in_use') AS in_use_tools,
             count(*) FILTER (WHERE {sql_due(30)}) AS need_maintenance,
             count(*) FILTER (WHERE {sql_due(30)} AND {sql_days_until('next_maintenance_due')} <= 3) AS urgent_items
      FROM tools) a, today""")
def q_daily_summary(spark, sf):
    f = load(spark, sf)
    df = kpis.daily_summary(f.tools, f.usage, AS_OF, TODAY)
    return df.withColumn("total_hours", r6("total_hours")).withColumn("avg_usage", r6("avg_usage"))


@register("maintenance_trend", """
SELECT t.category, CAST(date_trunc('month', m.maintenance_date) AS DATE) AS month,
       round(CAST(sum(m.cost) AS DOUBLE), 6) AS total_cost,
       round(avg(m.condition_after - m.condition_before), 6) AS avg_condition_change,
       count(*) AS n_records
FROM maintenance_facts m JOIN tools t ON m.tool_code = t.tool_code
GROUP BY ROLLUP (t.category, CAST(date_trunc('month', m.maintenance_date) AS DATE))""")
def q_maintenance_trend(spark, sf):
    f = load(spark, sf)
    df = kpis.maintenance_trend(f.maintenance_facts, f.tools)
    return df.withColumn("total_cost", r6("total_cost")).withColumn("avg_condition_change", r6("avg_condition_change"))


# ============================================================== 2.6 windows
@register("latest_usage", """
SELECT tool_code, r.seq, r.user_id, r.checkout_time, r.usage_duration, r.usage_type
FROM (SELECT tool_code, arg_max({'seq': seq, 'user_id': user_id, 'checkout_time': checkout_time,
                                 'usage_duration': usage_duration, 'usage_type': usage_type}, k) AS r
      FROM (SELECT *, (checkout_time IS NOT NULL, checkout_time, -seq) AS k FROM usage_history)
      GROUP BY tool_code)""")
def q_latest_usage(spark, sf):
    return windows.latest_usage(load(spark, sf).usage)


SESSIONS_SQL = """
SELECT tool_code, user_id, seq AS checkout_seq, ts AS checkout_time, next_ts AS checkin_time,
       round(date_diff('microsecond', ts, next_ts) / 3600000000.0, 6) AS duration_hours
FROM (SELECT *, lead(ts) OVER w AS next_ts, lead(event_kind) OVER w AS next_kind
      FROM tool_events WINDOW w AS (PARTITION BY tool_code ORDER BY ts, seq))
WHERE event_kind = 'checkout' AND next_kind = 'checkin'"""


@register("paired_sessions", SESSIONS_SQL)
def q_paired_sessions(spark, sf):
    return windows.paired_sessions(load(spark, sf).tool_events).withColumn("duration_hours", r6("duration_hours"))


@register("condition_trend", """
SELECT tool_code, seq, maintenance_date, condition_after, prev_condition,
       condition_after - prev_condition AS condition_change, round(rolling_condition_3, 6) AS rolling_condition_3
FROM (SELECT *, lag(condition_after) OVER w AS prev_condition,
             avg(condition_after) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_condition_3
      FROM maintenance_facts WINDOW w AS (PARTITION BY tool_code ORDER BY maintenance_date, seq))""")
def q_condition_trend(spark, sf):
    return windows.condition_trend(load(spark, sf).maintenance_facts).withColumn(
        "rolling_condition_3", r6("rolling_condition_3"))


@register("top_risk", f"""{PRED_SQL} SELECT {PRED_OUT_SQL} FROM predictions WHERE confidence_score > 0.8
ORDER BY confidence_score DESC, tool_code LIMIT 5""")
def q_top_risk(spark, sf):
    return pred_out(windows.top_risk(predictions(spark, sf)))


# ============================================================== 2.8 scalar rules
@register("date_rules", f"""
SELECT tool_code, {sql_days_since('purchase_date')} AS days_since_purchase,
       {sql_days_until('next_maintenance_due')} AS days_until_due,
       {sql_days_since('next_maintenance_due')} AS days_overdue,
       round(date_diff('microsecond', CAST(purchase_date AS TIMESTAMP), {ASOF_TS}) / 3600000000.0, 6) AS hours_owned
FROM tools""")
def q_date_rules(spark, sf):
    from fleetkit.functions.dates import hours_between, ts_lit
    t = load(spark, sf).tools
    return t.select("tool_code", days_since("purchase_date", AS_OF).alias("days_since_purchase"),
                    days_until("next_maintenance_due", AS_OF).alias("days_until_due"),
                    days_since("next_maintenance_due", AS_OF).alias("days_overdue"),
                    r6(hours_between(F.col("purchase_date"), ts_lit(AS_OF))).alias("hours_owned"))


@register("alert_rows", f"""
SELECT tool_code, tool_name, category, location, next_maintenance_due, condition_score, usage_hours,
       d AS days_until, {sql_alert_label('d')} AS urgency_text,
       CASE WHEN d < 0 OR d <= 3 THEN 'urgent' ELSE 'warning' END AS urgency_class
FROM (SELECT *, {sql_days_until('next_maintenance_due')} AS d FROM tools WHERE {sql_due(7)})""")
def q_alert_rows(spark, sf):
    return digests.alert_rows(load(spark, sf).tools, AS_OF)


@register("dashboard_urgent", f"""
SELECT tool_code, tool_name, category, next_maintenance_due, d AS days_overdue,
       CASE WHEN d > 0 THEN 'OVERDUE' ELSE 'Due in ' || CAST(abs(d) AS VARCHAR) || ' days' END AS urgency_text
FROM (SELECT *, {sql_days_since('next_maintenance_due')} AS d FROM tools WHERE {sql_due(7)})""")
def q_dashboard_urgent(spark, sf):
    return digests.dashboard_urgent(load(spark, sf).tools, AS_OF)


@register("due_labels", f"""
SELECT tool_code, tool_name, next_maintenance_due, condition_score, usage_hours, d AS days_until,
       CASE WHEN d < 0 THEN 'OVERDUE' ELSE CAST(d AS VARCHAR) || ' days' END AS urgency_text
FROM (SELECT *, {sql_days_until('next_maintenance_due')} AS d FROM tools WHERE {sql_due(30)})""")
def q_due_labels(spark, sf):
    return digests.due_labels(load(spark, sf).tools, AS_OF)


@register("parse_rules", """
SELECT seq, raw, try_cast(trim(raw) AS TIMESTAMP) AS parsed_ts, CAST(try_cast(trim(raw) AS TIMESTAMP) AS DATE) AS parsed_date
FROM raw_timestamps""")
def q_parse_rules(spark, sf):
    r = load(spark, sf).raw_timestamps
    return r.select("seq", "raw", tolerant_timestamp("raw").alias("parsed_ts"), tolerant_date("raw").alias("parsed_date"))


@register("display_rules", f"""{MAINT_TOOLS_SQL}
SELECT t.tool_code, upper(t.status) AS status_upper, replace(t.status, ' ', '-') AS status_css,
       printf('%.1f', round(t.condition_score, 1)) AS condition_text,
       printf('%.1f', round(t.usage_hours, 1)) || 'h' AS usage_text,
       printf('%.1f', round(t.condition_score / 10.0 * 100.0, 1)) || '%' AS condition_pct,
       '€' || format('{{:,.2f}}', round(CAST(mt.maintenance_cost AS DOUBLE), 2)) AS cost_text
FROM tools t JOIN mt ON t.tool_code = mt.tool_code""")
def q_display_rules(spark, sf):
    f = load(spark, sf)
    costed = ledger.apply_maintenance(f.tools, f.maintenance_facts, AS_OF).select("tool_code", "maintenance_cost")
    t = f.tools.drop("maintenance_cost").join(costed, "tool_code", "inner")
    return t.select("tool_code", F.upper("status").alias("status_upper"), R.status_css("status").alias("status_css"),
                    R.fmt1("condition_score").alias("condition_text"),
                    F.concat(R.fmt1("usage_hours"), F.lit("h")).alias("usage_text"),
                    R.percent1(F.col("condition_score") / F.lit(10.0)).alias("condition_pct"),
                    R.money(F.col("maintenance_cost").cast("double")).alias("cost_text"))


@register("code_valid", """
SELECT seq, code,
       coalesce(length(code) BETWEEN 3 AND 20 AND length(trim(code, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) > 0
                AND regexp_full_match(upper(code), '[A-Z0-9_-]+\\n?'), false) AS valid
FROM raw_codes""")
def q_code_valid(spark, sf):
    return load(spark, sf).raw_codes.select("seq", "code", R.code_valid("code").alias("valid"))


@register("alert_fanout", f"""
SELECT r.recipient, a.tool_code, {sql_alert_label('a.d')} AS urgency_text,
       CASE WHEN a.d < 0 OR a.d <= 3 THEN 'urgent' ELSE 'warning' END AS urgency_class
FROM (SELECT *, {sql_days_until('next_maintenance_due')} AS d FROM tools WHERE {sql_due(7)}) a,
     (SELECT trim(x) AS recipient FROM (SELECT unnest(string_split('{RECIPIENTS}', ',')) AS x) WHERE trim(x) <> '') r""")
def q_alert_fanout(spark, sf):
    return digests.alert_fanout(digests.alert_rows(load(spark, sf).tools, AS_OF), RECIPIENTS)


# ============================================================== 2.9 features & risk
FEATURES_SQL = f"""{USAGE_STATS_SQL}, {MAINT_STATS_SQL},
fj AS (SELECT t.*, us.total_usage_hours, us.avg_usage_hours, us.usage_count, us.checkout_count,
              ms.total_maintenance_cost, ms.avg_maintenance_cost, ms.maintenance_count, ms.last_maintenance,
              {sql_days_since('t.purchase_date')} AS dsp, {sql_days_since('ms.last_maintenance')} AS dslm
       FROM tools t LEFT JOIN us ON t.tool_code = us.tool_code LEFT JOIN ms ON t.tool_code = ms.tool_code),
feat AS (
  SELECT tool_code, tool_name, category, location, status,
         coalesce(condition_score, 0.0) AS condition_score, coalesce(usage_hours, 0.0) AS usage_hours,
         CAST(coalesce(maintenance_cost, 0) AS DOUBLE) AS maintenance_cost,
         coalesce(total_usage_hours, 0.0) AS total_usage_hours, coalesce(avg_usage_hours, 0.0) AS avg_usage_hours,
         coalesce(usage_count, 0) AS usage_count, coalesce(checkout_count, 0) AS checkout_count,
         coalesce(total_maintenance_cost, 0.0) AS total_maintenance_cost,
         coalesce(avg_maintenance_cost, 0.0) AS avg_maintenance_cost,
         coalesce(maintenance_count, 0) AS maintenance_count, last_maintenance,
         coalesce(dsp, 0) AS days_since_purchase, coalesce(dslm, 0) AS days_since_last_maintenance,
         coalesce(CASE WHEN dsp + 1 = 0 THEN NULL ELSE total_usage_hours / (dsp + 1) END, 0.0) AS usage_intensity,
         coalesce(CASE WHEN dsp + 1 = 0 THEN NULL ELSE CAST(maintenance_count AS DOUBLE) / (dsp + 1) END * 365.0, 0.0)
           AS maintenance_frequency,
         coalesce(CASE WHEN total_usage_hours + 1 = 0 THEN NULL
                       ELSE total_maintenance_cost / (total_usage_hours + 1) END, 0.0) AS cost_per_hour
  FROM fj)
"""
FEATURE_OUT = ["tool_code", "category", "location", "status", "condition_score", "usage_hours", "maintenance_cost",
               "total_usage_hours", "avg_usage_hours", "usage_count", "checkout_count", "total_maintenance_cost",
               "avg_maintenance_cost", "maintenance_count", "last_maintenance", "days_since_purchase",
               "days_since_last_maintenance", "usage_intensity", "maintenance_frequency", "cost_per_hour"]
ROUNDED = {"usage_intensity", "maintenance_frequency", "cost_per_hour"}


def features(spark, sf) -> DataFrame:
    f = load(spark, sf)
    return prepare_features(f.tools, f.usage, f.maintenance_facts, AS_OF)


@register("features", FEATURES_SQL + " SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in ROUNDED else c for c in FEATURE_OUT) + " FROM feat")
def q_features(spark, sf):
    df = features(spark, sf)
    return df.select(*[r6(c).alias(c) if c in ROUNDED else
                       (F.col(c).cast("double").alias(c) if c == "maintenance_cost" else F.col(c))
                       for c in FEATURE_OUT])


@register("urgency_scores", FEATURES_SQL + """
SELECT tool_code, round((10.0 - condition_score) / 2.5
   + CASE WHEN usage_intensity > 0 THEN least(usage_intensity * 3.0, 3.0) ELSE 0.0 END
   + CASE WHEN days_since_last_maintenance > 0 THEN least(days_since_last_maintenance / 30.0, 3.0) ELSE 0.0 END, 6)
   AS urgency_score FROM feat""")
def q_urgency_scores(spark, sf):
    return risk.urgency_scores(features(spark, sf)).select("tool_code", r6("urgency_score").alias("urgency_score"))


DICT_SQL = """
dict AS (SELECT col, value, CAST(dense_rank() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT col, value FROM (
               SELECT 'category' AS col, coalesce(category, 'None') AS value FROM feat
               UNION ALL SELECT 'location', coalesce(location, 'None') FROM feat
               UNION ALL SELECT 'status', coalesce(status, 'None') FROM feat))),
enc AS (SELECT f.*, coalesce(c.code, -1) AS category_encoded, coalesce(l.code, -1) AS location_encoded,
               coalesce(s.code, -1) AS status_encoded
        FROM feat f
        LEFT JOIN dict c ON c.col = 'category' AND c.value = coalesce(f.category, 'None')
        LEFT JOIN dict l ON l.col = 'location' AND l.value = coalesce(f.location, 'None')
        LEFT JOIN dict s ON s.col = 'status' AND s.value = coalesce(f.status, 'None'))
"""


def encoded_features(spark, sf) -> DataFrame:
    # one feature row per tool, so the tools alone hold every label
    return encode.encode(features(spark, sf), encode.fit_label_dictionary(load(spark, sf).tools))


@register("label_codes", FEATURES_SQL + "," + DICT_SQL +
          " SELECT tool_code, category_encoded, location_encoded, status_encoded FROM enc")
def q_label_codes(spark, sf):
    return encoded_features(spark, sf).select("tool_code", "category_encoded", "location_encoded", "status_encoded")


@register("label_codes_kept", """
dict AS (SELECT col, value, CAST(dense_rank() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT col, value FROM (
               SELECT 'category' AS col, coalesce(category, 'None') AS value FROM tools WHERE status = 'available'
               UNION ALL SELECT 'location', coalesce(location, 'None') FROM tools WHERE status = 'available'
               UNION ALL SELECT 'status', coalesce(status, 'None') FROM tools WHERE status = 'available')))
SELECT t.tool_code, coalesce(c.code, -1) AS category_encoded, coalesce(l.code, -1) AS location_encoded,
       coalesce(s.code, -1) AS status_encoded
FROM tools t
LEFT JOIN dict c ON c.col = 'category' AND c.value = coalesce(t.category, 'None')
LEFT JOIN dict l ON l.col = 'location' AND l.value = coalesce(t.location, 'None')
LEFT JOIN dict s ON s.col = 'status' AND s.value = coalesce(t.status, 'None')""")
def q_label_codes_kept(spark, sf):
    """J2 after a retrain: the dictionary fitted on the available tools is kept
    and meets the whole fleet; labels new to it are -1."""
    t = load(spark, sf).tools
    kept = encode.fit_label_dictionary(t.where(F.col("status") == "available"))
    return encode.encode(t, kept).select("tool_code", "category_encoded", "location_encoded", "status_encoded")


def _scaled_sql() -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{i}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{i}"
                      for i, c in enumerate(K.FEATURE_COLUMNS))
    cols = ", ".join(
        f"round((CAST({c} AS DOUBLE) - st.m_{i}) / CASE WHEN st.s_{i} IS NULL OR st.s_{i} = 0 THEN 1.0 "
        f"ELSE st.s_{i} END, 6) AS {c}"
        for i, c in enumerate(K.FEATURE_COLUMNS))
    return (FEATURES_SQL + "," + DICT_SQL + f", st AS (SELECT {stats} FROM enc) "
            f"SELECT enc.tool_code, {cols} FROM enc, st")


@register("scaled_features", _scaled_sql())
def q_scaled_features(spark, sf):
    from fleetkit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # fitted once, applied once: checkpoint so the feature joins run once
    enc = encoded_features(spark, sf).checkpoint(eager=True)
    params = encode.fit_scaler(enc, K.FEATURE_COLUMNS)      # one aggregate pass -> 2 x 17 numbers
    out = encode.scale(enc, params)
    return out.select("tool_code", *[r6(c).alias(c) for c in K.FEATURE_COLUMNS])


@register("risk_fusion", f"{PRED_SQL} SELECT {PRED_OUT_SQL} FROM predictions")
def q_risk_fusion(spark, sf):
    return pred_out(predictions(spark, sf))


@register("recommendations", f"""{PRED_SQL}
SELECT tool_code, maintenance_priority AS priority,
       CASE WHEN confidence_score > 0.9 THEN '{K.ACTION_BANDS[0][1]}'
            WHEN confidence_score > 0.8 THEN '{K.ACTION_BANDS[1][1]}'
            WHEN confidence_score > 0.7 THEN '{K.ACTION_BANDS[2][1]}'
            WHEN confidence_score > 0.6 THEN '{K.ACTION_BANDS[3][1]}'
            ELSE '{K.ACTION_DEFAULT}' END AS recommended_action,
       round({sql_r2('100.0 * (1.0 + confidence_score * 2.0)')}, 6) AS estimated_cost,
       predicted_failure_date AS suggested_date,
       CASE WHEN r = '' THEN '{K.REASON_DEFAULT}' ELSE r END AS reasoning
FROM (SELECT *, concat_ws('; ',
        CASE WHEN condition_risk > 0.7 THEN '{K.REASON_CONDITION}' END,
        CASE WHEN anomaly_risk > 0.7 THEN '{K.REASON_ANOMALY}' END,
        CASE WHEN confidence_score > 0.8 THEN '{K.REASON_HIGH}' END) AS r FROM predictions)
WHERE confidence_score > 0.6""")
def q_recommendations(spark, sf):
    return risk.recommendations(predictions(spark, sf)).withColumn("estimated_cost", r6("estimated_cost"))


# ============================================================== 2.10 digests, labels
def sql_block(template: str, *values: str) -> str:
    """SQL text of a template whose ``%s`` are the given text expressions."""
    parts = [f"'{p}'" for p in template.split("%s")]
    return " || ".join(x for pair in zip(parts, [*values, None]) for x in pair if x is not None)


STAMP = AS_OF.strftime(K.STAMP_FORMAT)


def _alert_text_sql() -> str:
    header = K.MAINTENANCE_HEADER.format(company="Engineering")
    footer = K.MAINTENANCE_FOOTER.format(stamp=STAMP)
    body = sql_block(K.MAINTENANCE_BLOCK, "tool_name", "tool_code", "category", "location",
                     "CAST(next_maintenance_due AS VARCHAR)", "urgency_text", "CAST(condition_score AS VARCHAR)",
                     "CAST(usage_hours AS VARCHAR)")
    return f"""
a AS (SELECT *, {sql_alert_label('d')} AS urgency_text
      FROM (SELECT *, {sql_days_until('next_maintenance_due')} AS d FROM tools WHERE {sql_due(7)}))
SELECT location, 0 AS block, CAST(NULL AS DATE) AS next_maintenance_due, CAST(NULL AS VARCHAR) AS tool_code,
       '{header}' AS text FROM (SELECT DISTINCT location FROM a)
UNION ALL
SELECT location, 1, next_maintenance_due, tool_code, {body} FROM a
UNION ALL
SELECT location, 2, CAST(NULL AS DATE), CAST(NULL AS VARCHAR), '{footer}' FROM (SELECT DISTINCT location FROM a)"""


def _risk_text_sql() -> str:
    header = K.RISK_HEADER.format(company="Engineering")
    footer = K.RISK_FOOTER.format(stamp=STAMP)
    body = sql_block(K.RISK_BLOCK, "tool_code", "printf('%.1f', round(confidence_score * 100.0, 1)) || '%'",
                     "maintenance_priority", "CAST(predicted_failure_date AS VARCHAR)",
                     "CAST(days_until_maintenance AS VARCHAR)")
    return f"""{PRED_SQL}, high AS (SELECT * FROM predictions WHERE confidence_score > {K.RISK_HIGH})
SELECT 0 AS block, CAST(NULL AS DOUBLE) AS confidence_score, CAST(NULL AS VARCHAR) AS tool_code, '{header}' AS text
WHERE EXISTS (SELECT 1 FROM high)
UNION ALL
SELECT 1, round(confidence_score, 6), tool_code, {body} FROM high
UNION ALL
SELECT 2, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), '{footer}' WHERE EXISTS (SELECT 1 FROM high)"""


def _summary_text_sql() -> str:
    one = lambda c: f"printf('%.1f', round(coalesce({c}, 0.0), 1))"
    head = sql_block(K.SUMMARY_HEADER.format(company="Engineering", day=AS_OF.strftime("%Y-%m-%d")),
                     *[f"CAST({c} AS VARCHAR)" for c in ("total_tools", "available_tools", "in_use_tools", "need")],
                     one("total_hours"), "CAST(active_tools AS VARCHAR)", one("avg_usage"))
    line = sql_block(K.SUMMARY_URGENT_LINE, "tool_name", "tool_code", sql_alert_label("d"))
    footer = K.SUMMARY_FOOTER.format(stamp=STAMP)
    return f"""{TODAY_SQL},
u AS (SELECT * FROM (SELECT *, {sql_days_until('next_maintenance_due')} AS d FROM tools WHERE {sql_due(30)})
      WHERE d <= 3),
a AS (SELECT count(*) AS total_tools, count(*) FILTER (WHERE status = 'available') AS available_tools,
             count(*) FILTER (WHERE status = 'in_use') AS in_use_tools, count(*) FILTER (WHERE {sql_due(30)}) AS need
      FROM tools)
SELECT 0 AS block, CAST(NULL AS DATE) AS next_maintenance_due, CAST(NULL AS VARCHAR) AS tool_code, {head} AS text
FROM a, today
UNION ALL
SELECT 1, CAST(NULL AS DATE), CAST(NULL AS VARCHAR), '{K.SUMMARY_URGENT_TITLE}' WHERE EXISTS (SELECT 1 FROM u)
UNION ALL
SELECT 2, next_maintenance_due, tool_code, {line} FROM u
UNION ALL
SELECT 3, CAST(NULL AS DATE), CAST(NULL AS VARCHAR), '{footer}'"""


@register("risk_text", _risk_text_sql())
def q_risk_text(spark, sf):
    """K4, high-risk alert."""
    return digests.risk_text(predictions(spark, sf), AS_OF).withColumn("confidence_score", r6("confidence_score"))


@register("summary_text", _summary_text_sql())
def q_summary_text(spark, sf):
    """K4, daily summary with its urgent list."""
    f = load(spark, sf)
    urgent = filters.urgent_items(A.due_scan(f.tools, AS_OF, K.DUE_HORIZON_PAGE), AS_OF)
    return digests.summary_text(kpis.daily_summary(f.tools, f.usage, AS_OF, TODAY), urgent, AS_OF)


@register("alert_text", _alert_text_sql())
def q_alert_text(spark, sf):
    return digests.alert_text(digests.alert_rows(load(spark, sf).tools, AS_OF), AS_OF)


MANIFEST_SQL = f"""
man AS (SELECT seq, tool_code, tool_name,
               CASE WHEN tool_code IS NULL OR tool_code = '' THEN 'failed' ELSE 'success' END AS outcome,
               CASE WHEN tool_code IS NULL OR tool_code = '' THEN '{K.MISSING_CODE_ERROR}' END AS error,
               CASE WHEN tool_code IS NULL OR tool_code = '' THEN NULL ELSE tool_code END AS qr_data,
               CASE WHEN tool_code IS NULL OR tool_code = '' THEN NULL
                    ELSE '{K.LABEL_DIR}' || translate(tool_code, '/ ', '__') || '{K.LABEL_SUFFIX}' END AS filepath
        FROM label_batch)
"""


@register("label_manifest", f"{MANIFEST_SQL} SELECT * FROM man")
def q_label_manifest(spark, sf):
    return labels.label_manifest(load(spark, sf).label_batch)


@register("label_collisions", f"""{MANIFEST_SQL}
SELECT filepath, count(*) AS n_rows, count(DISTINCT tool_code) AS n_codes, min(tool_code) AS first_code,
       max(tool_code) AS last_code
FROM man WHERE outcome = 'success' GROUP BY filepath HAVING count(DISTINCT tool_code) > 1""")
def q_label_collisions(spark, sf):
    return labels.label_collisions(labels.label_manifest(load(spark, sf).label_batch))


@register("label_summary", f"""{MANIFEST_SQL}
SELECT count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'failed') AS failed,
       count(*) AS total FROM man""")
def q_label_summary(spark, sf):
    return labels.label_summary(labels.label_manifest(load(spark, sf).label_batch))


# ============================================================== 2.11 streams (oracle on the batch SQL)
@register("stream_daily", DAILY_USAGE_SQL)
def q_stream_daily(spark, sf):
    """M3: daily totals of the usage stream, the days still open included."""
    from fleetkit.session import shared_path
    from fleetkit.sources.testdata import shape_usage
    from fleetkit.streaming import streams
    root = shared_path(spark, "stream-daily")
    u = shape_usage(streams.table_stream(spark, sf, "lineitem"))
    streams.daily_upserts(u, f"{root}/days", f"{root}/_checkpoint")
    return streams.daily_latest(spark, f"{root}/days").withColumn("total_hours", r6("total_hours"))


@register("stream_scans", """
SELECT s.seq, s.ts, s.code, t.tool_name, t.status, t.category, t.location, t.tool_code IS NOT NULL AS found
FROM scans s LEFT JOIN tools t ON s.code = t.tool_code""")
def q_stream_scans(spark, sf):
    """M4: scan stream left-joined with the static tools table."""
    from fleetkit.session import shared_path
    from fleetkit.sources.testdata import part_count, shape_scans
    from fleetkit.streaming import streams
    root = shared_path(spark, "stream-scans")
    f = load(spark, sf)
    s = shape_scans(streams.table_stream(spark, sf, "events"), part_count(spark, sf))
    streams.run_to_end(streams.scan_stream(s, f.tools), f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out").select("seq", "ts", "code", "tool_name", "status", "category",
                                                   "location", "found")
