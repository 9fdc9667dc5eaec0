"""Alert digests as tables (K1-K5) and their day-count labels.

A digest is never one string holding the whole fleet: ``alert_text`` yields
one text block per tool plus a header and a footer row per location, with
sort columns, so a location with a third of all tools is still spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions import rules as R
from fleetkit.functions.dates import days_since, days_until
from fleetkit.sources.tables import due_scan

ALERT_COLUMNS = ["tool_code", "tool_name", "category", "location", "next_maintenance_due",
                 "condition_score", "usage_hours"]


def alert_rows(tools: DataFrame, as_of, days_ahead: int = K.DUE_HORIZON_ALERT) -> DataFrame:
    """K1: due tools with alert wording and urgency class."""
    d = days_until("next_maintenance_due", as_of)
    return (due_scan(tools, as_of, days_ahead).select(*ALERT_COLUMNS, d.alias("days_until"))
            .withColumn("urgency_text", R.alert_label("days_until"))
            .withColumn("urgency_class", R.alert_class("days_until")))


def dashboard_urgent(tools: DataFrame, as_of, days_ahead: int = K.DUE_HORIZON_ALERT) -> DataFrame:
    """S5 on the dashboard list: days overdue = floor((as_of - due)/1 day)."""
    d = days_since("next_maintenance_due", as_of)
    return (due_scan(tools, as_of, days_ahead)
            .select("tool_code", "tool_name", "category", "next_maintenance_due", d.alias("days_overdue"))
            .withColumn("urgency_text", R.dashboard_label("days_overdue")))


def due_labels(tools: DataFrame, as_of, days_ahead: int = K.DUE_HORIZON_PAGE) -> DataFrame:
    """S6 on the maintenance page (30-day list)."""
    d = days_until("next_maintenance_due", as_of)
    return (due_scan(tools, as_of, days_ahead)
            .select("tool_code", "tool_name", "next_maintenance_due", "condition_score", "usage_hours",
                    d.alias("days_until"))
            .withColumn("urgency_text", R.page_label("days_until")))


def _block(alerts: DataFrame) -> DataFrame:
    body = F.format_string(
        K.MAINTENANCE_BLOCK, "tool_name", "tool_code", "category", "location",
        F.col("next_maintenance_due").cast("string"), "urgency_text",
        F.col("condition_score").cast("string"), F.col("usage_hours").cast("string"))
    return alerts.select("location", F.lit(1).alias("block"), "next_maintenance_due", "tool_code",
                         body.alias("text"))


def alert_text(alerts: DataFrame, as_of, company: str = "Engineering") -> DataFrame:
    """K4: plain-text maintenance digest per location as ordered text rows
    (order by location, block, next_maintenance_due, tool_code)."""
    header = K.MAINTENANCE_HEADER.format(company=company)
    footer = K.MAINTENANCE_FOOTER.format(stamp=as_of.strftime(K.STAMP_FORMAT))
    locations = alerts.groupBy("location").agg(F.count(F.lit(1)).alias("_n"))
    edge = lambda blk, text: locations.select(
        "location", F.lit(blk).alias("block"), F.lit(None).cast("date").alias("next_maintenance_due"),
        F.lit(None).cast("string").alias("tool_code"), F.lit(text).alias("text"))
    return edge(0, header).unionByName(_block(alerts)).unionByName(edge(2, footer))


def risk_text(predictions: DataFrame, as_of, threshold: float = K.RISK_HIGH,
              company: str = "Engineering") -> DataFrame:
    """K4: plain-text high-risk alert as ordered text rows (order by block,
    confidence_score desc, tool_code).  Without a prediction above the
    threshold there is no alert, hence no row."""
    high = predictions.where(F.col("confidence_score") > F.lit(float(threshold)))
    body = F.format_string(
        K.RISK_BLOCK, "tool_code", R.percent1(F.col("confidence_score")), "maintenance_priority",
        F.col("predicted_failure_date").cast("string"), F.col("days_until_maintenance").cast("string"))
    items = high.select(F.lit(1).alias("block"), "confidence_score", "tool_code", body.alias("text"))
    texts = {0: K.RISK_HEADER.format(company=company),
             2: K.RISK_FOOTER.format(stamp=as_of.strftime(K.STAMP_FORMAT))}
    some = high.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0)
    edges = [some.select(F.lit(b).alias("block"), F.lit(None).cast("double").alias("confidence_score"),
                         F.lit(None).cast("string").alias("tool_code"), F.lit(t).alias("text"))
             for b, t in texts.items()]
    return edges[0].unionByName(items).unionByName(edges[1])


def summary_text(summary: DataFrame, urgent: DataFrame, as_of, company: str = "Engineering") -> DataFrame:
    """K4: plain-text daily summary as ordered text rows (order by block,
    next_maintenance_due, tool_code): the numbers of ``kpis.daily_summary``,
    a title and one line per urgent item (both only if there is one), a
    footer.  Lines within the list are joined by a line feed."""
    one = lambda c: R.fmt1(F.coalesce(F.col(c), F.lit(0.0)))
    head = F.format_string(
        K.SUMMARY_HEADER.format(company=company, day=as_of.strftime("%Y-%m-%d")),
        *[F.col(c).cast("string") for c in ("total_tools", "available_tools", "in_use_tools", "need_maintenance")],
        one("total_hours"), F.col("active_tools").cast("string"), one("avg_usage"))
    row = lambda df, blk, text: df.select(
        F.lit(blk).alias("block"), F.lit(None).cast("date").alias("next_maintenance_due"),
        F.lit(None).cast("string").alias("tool_code"), text.alias("text"))
    some = urgent.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0)
    line = F.format_string(K.SUMMARY_URGENT_LINE, "tool_name", "tool_code", "urgency_text")
    footer = K.SUMMARY_FOOTER.format(stamp=as_of.strftime(K.STAMP_FORMAT))
    return (row(summary, 0, head).unionByName(row(some, 1, F.lit(K.SUMMARY_URGENT_TITLE)))
            .unionByName(urgent.select(F.lit(2).alias("block"), "next_maintenance_due", "tool_code",
                                       line.alias("text")))
            .unionByName(row(summary, 3, F.lit(footer))))


def alert_fanout(alerts: DataFrame, recipients_csv: str) -> DataFrame:
    """K5 + S18: one row per (recipient, alert).  The recipient list is a
    parameter (bounded), expanded by a generator — no join."""
    return (alerts.select(F.explode(R.recipient_list(F.lit(recipients_csv))).alias("recipient"),
                          "tool_code", "urgency_text", "urgency_class"))
