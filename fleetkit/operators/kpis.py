"""Aggregations.

All are hash aggregations with map-side partial aggregation (count, sum,
avg, max, max_by are decomposable), so a dominant key only adds one partial
row per task to the shuffle.  One-row KPI results are combined without any
join (``combine_rows``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions.dates import date_lit, days_until
from fleetkit.functions.rules import round2, safe_div
from fleetkit.sources.tables import due_filter


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Put several one-row aggregates side by side without a join: union the
    rows (other columns null) and take the only non-null value per column."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])


def inventory_kpis(tools: DataFrame, as_of, days_ahead: int = K.DUE_HORIZON_ALERT) -> DataFrame:
    """Dashboard tiles in one pass over the tools."""
    s = F.col("status")
    agg = tools.agg(
        F.count(F.lit(1)).alias("total_tools"),
        F.count_if(s == "available").alias("available_tools"),
        F.count_if(s == "in_use").alias("in_use_tools"),
        F.count_if(due_filter(as_of, days_ahead)).alias("maintenance_due"),
    )
    total = F.col("total_tools")
    return agg.select(
        "total_tools", "available_tools", "in_use_tools",
        F.when(total > 0, F.col("available_tools") * F.lit(100.0) / total).otherwise(F.lit(0.0)).alias("available_pct"),
        F.when(total > 0, F.col("in_use_tools") * F.lit(100.0) / total).otherwise(F.lit(0.0)).alias("in_use_pct"),
        "maintenance_due",
        F.when(F.col("maintenance_due") > K.DUE_COUNT_URGENT_OVER, F.lit(K.KPI_URGENT))
         .otherwise(F.lit(K.KPI_NORMAL)).alias("maintenance_flag"),
    )


def api_kpis(tools: DataFrame) -> DataFrame:
    """Counts of the JSON API; 'maintenance_due' counts status = maintenance."""
    s = F.col("status")
    return tools.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "available").alias("available"),
        F.count_if(s == "in_use").alias("in_use"),
        F.count_if(s == "maintenance").alias("maintenance_due"),
    )


def facet_counts(tools: DataFrame) -> DataFrame:
    """E3 + E4 in one shuffle: GROUPING SETS ((status), (category))."""
    g = (tools.groupingSets([["status"], ["category"]], "status", "category")
         .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")))
    facet = F.when(F.col("_gid") == 1, F.lit("status")).otherwise(F.lit("category"))
    value = F.when(F.col("_gid") == 1, F.col("status")).otherwise(F.col("category"))
    return g.select(facet.alias("facet"), value.alias("value"), "n")


def _counts(tools: DataFrame, column: str) -> DataFrame:
    return (tools.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_tools"))
            .orderBy(F.col("n_tools").desc(), column))


def status_counts(tools: DataFrame) -> DataFrame:
    """Tools per status, most frequent first, nulls dropped."""
    return _counts(tools, "status")


def category_counts(tools: DataFrame) -> DataFrame:
    """Tools per category, most frequent first."""
    return _counts(tools, "category")


def _date_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Optional inclusive date range, pushed to the scan as a filter; on
    a month-partitioned usage table (``files.write_usage``) the month bounds
    also prune partitions."""
    if start is not None:
        df = df.where(F.to_date(F.col(col)) >= date_lit(start))
        if "usage_month" in df.columns:
            df = df.where(F.col("usage_month") >= F.lit(str(start)[:7]))
    if end is not None:
        df = df.where(F.to_date(F.col(col)) <= date_lit(end))
        if "usage_month" in df.columns:
            df = df.where(F.col("usage_month") <= F.lit(str(end)[:7]))
    return df


def analytics_kpis(usage: DataFrame, tools: DataFrame, start=None, end=None) -> DataFrame:
    """E5: mean usage duration, total maintenance cost, mean condition."""
    u = _date_range(usage, "checkout_time", start, end) if (start or end) else usage
    a = u.agg(F.avg("usage_duration").alias("avg_usage_hours"))
    b = tools.agg(F.sum("maintenance_cost").cast("double").alias("total_maintenance_cost"),
                  F.avg("condition_score").alias("avg_condition_score"))
    return combine_rows(a, b)


def daily_usage(usage: DataFrame, start=None, end=None) -> DataFrame:
    """Hours per check-out day; rows without a check-out time drop out and
    an all-null day sums to 0."""
    u = usage.where(F.col("checkout_time").isNotNull())
    u = _date_range(u, "checkout_time", start, end)
    return (u.groupBy(F.to_date("checkout_time").alias("usage_date"))
            .agg(F.coalesce(F.sum("usage_duration"), F.lit(0.0)).alias("total_hours")))


def today_usage(usage: DataFrame, day: _dt.date | str, approx: bool = False) -> DataFrame:
    """Total hours, distinct tools and mean hours for check-outs on
    ``day``; an empty day gives 0 / 0 / 0.  ``approx`` counts distinct tools
    with HyperLogLog++ (``approx_count_distinct``: bounded memory, ~2 % error)
    instead of an exact distinct count."""
    u = usage.where(F.to_date("checkout_time") == date_lit(day))
    tools = F.approx_count_distinct("tool_code", 0.02) if approx else F.count_distinct("tool_code")
    agg = u.agg(F.count(F.lit(1)).alias("_n"),
                F.sum("usage_duration").alias("_sum"),
                tools.alias("active_tools"),
                F.avg("usage_duration").alias("_avg"))
    return agg.select(
        F.coalesce(F.col("_sum"), F.lit(0.0)).alias("total_hours"),
        F.col("active_tools"),
        F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("_avg")).alias("avg_usage"),
    )


def condition_histogram(tools: DataFrame, bins: int = K.HIST_BINS,
                        low: float = K.HIST_LOW, high: float = K.HIST_HIGH) -> DataFrame:
    """Equal-width bins on [low, high], the last bin closed.  Scores below
    and above fall into the open bins -1 (bin_low null) and ``bins`` (bin_high
    null); null scores are not counted."""
    x = F.col("condition_score")
    width = (high - low) / bins
    inside = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    b = F.when(x < low, -1).when(x > high, bins).otherwise(inside).cast("int")
    edge = lambda k: F.lit(low) + (F.col("bin") + k) * F.lit(width)
    return (tools.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_tools"))
            .select("bin", F.when(F.col("bin") >= 0, edge(0)).alias("bin_low"),
                    F.when(F.col("bin") < bins, edge(1)).alias("bin_high"), "n_tools"))


def usage_stats(usage: DataFrame) -> DataFrame:
    """Per-tool usage statistics rounded to 2 decimals."""
    d = F.col("usage_duration")
    return usage.groupBy("tool_code").agg(
        round2(F.coalesce(F.sum(d), F.lit(0.0))).alias("total_usage_hours"),
        round2(F.avg(d)).alias("avg_usage_hours"),
        F.count(d).alias("usage_count"),
        F.count("checkout_time").alias("checkout_count"),
    )


def maintenance_stats(maintenance: DataFrame) -> DataFrame:
    """Per-tool maintenance statistics rounded to 2 decimals (exact
    decimal sums, so the result does not depend on summation order)."""
    total = F.sum("cost").cast("double")
    return maintenance.groupBy("tool_code").agg(
        round2(F.coalesce(total, F.lit(0.0))).alias("total_maintenance_cost"),
        round2(safe_div(total, F.count("cost"))).alias("avg_maintenance_cost"),
        F.count("cost").alias("maintenance_count"),
        F.max("maintenance_date").alias("last_maintenance"),
    )


def daily_summary(tools: DataFrame, usage: DataFrame, as_of, day,
                  days_ahead: int = K.DUE_HORIZON_PAGE, urgent_days: int = K.URGENT_DAYS) -> DataFrame:
    """Overview counts, today's usage and the number of urgent items
    (due within ``days_ahead`` and at most ``urgent_days`` away) in one row.
    The urgent list itself is ``urgent_items`` — a table, not an array in
    one row."""
    s = F.col("status")
    due = due_filter(as_of, days_ahead)
    a = tools.agg(
        F.count(F.lit(1)).alias("total_tools"),
        F.count_if(s == "available").alias("available_tools"),
        F.count_if(s == "in_use").alias("in_use_tools"),
        F.count_if(due).alias("need_maintenance"),
        F.count_if(due & (days_until("next_maintenance_due", as_of) <= urgent_days)).alias("urgent_items"),
    )
    return combine_rows(a, today_usage(usage, day))


def maintenance_trend(maintenance: DataFrame, tools: DataFrame) -> DataFrame:
    """Maintenance cost and condition change per category and month,
    with ROLLUP subtotals (category total and grand total)."""
    m = maintenance.join(tools.select("tool_code", "category"), "tool_code", "inner")
    month = F.trunc(F.col("maintenance_date"), "month").alias("month")
    return (m.rollup("category", month)
            .agg(F.sum("cost").cast("double").alias("total_cost"),
                 F.avg(F.col("condition_after") - F.col("condition_before")).alias("avg_condition_change"),
                 F.count(F.lit(1)).alias("n_records")))
