"""Row-order idioms as windows (F1-F4) and sort/limit operators.

Per-tool sequences use the bucketed windows of ``operators.sequence``: a hot
tool is cut into buckets of a bounded row count instead of being sorted in one
task; every other tool is one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetkit import constants as K
from fleetkit.functions.dates import hours_between
from fleetkit.operators.ledger import latest_usage_row
from fleetkit.operators.sequence import GHOST, following, hot_key_plan, seq_window, with_neighbours


def latest_usage(usage: DataFrame) -> DataFrame:
    """newest usage row per tool (an aggregate, see ledger)."""
    return latest_usage_row(usage)


def paired_sessions(events: DataFrame, rows_per_task: int = 2_000_000) -> DataFrame:
    """a check-out immediately followed (per tool, by time then arrival)
    by a check-in forms a session; duration in hours."""
    ev, hot = hot_key_plan(events, "tool_code", ["ts", "seq"], "_bucket", rows_per_task)
    nxt = following(ev, "tool_code", "_bucket", ["ts", "seq"], ["ts", "event_kind"], ghosts=hot)
    s = nxt.where((F.col("event_kind") == K.CHECKOUT) & (F.col("next_event_kind") == K.CHECKIN))
    return s.select("tool_code", "user_id", F.col("seq").alias("checkout_seq"),
                    F.col("ts").alias("checkout_time"), F.col("next_ts").alias("checkin_time"),
                    hours_between(F.col("ts"), F.col("next_ts")).alias("duration_hours"))


def condition_trend(maintenance: DataFrame, rows_per_task: int = 2_000_000) -> DataFrame:
    """per tool, by maintenance date then arrival: previous condition,
    change, and mean of the last three conditions (nulls ignored).  Hot tools
    are cut by row count (two ghost rows carried per bucket)."""
    m, hot = hot_key_plan(maintenance, "tool_code", ["maintenance_date", "seq"], "_bucket", rows_per_task)
    nb = with_neighbours(m, "tool_code", "_bucket", ["maintenance_date", "seq"],
                         ["condition_after"], lookback=2, ghosts=hot)
    w = seq_window("tool_code", "_bucket", ["maintenance_date", "seq"])
    out = (nb.withColumn("prev_condition", F.lag("condition_after").over(w))
             .withColumn("rolling_condition_3", F.avg("condition_after").over(w.rowsBetween(-2, 0)))
             .where(~F.col(GHOST)))
    return out.select("tool_code", "seq", "maintenance_date", "condition_after", "prev_condition",
                      (F.col("condition_after") - F.col("prev_condition")).alias("condition_change"),
                      "rolling_condition_3")


def top_risk(predictions: DataFrame, threshold: float = K.RISK_HIGH, k: int = 5) -> DataFrame:
    """The k riskiest predictions above the threshold (a top-k report;
    Spark plans it as TakeOrderedAndProject, no global sort)."""
    return (predictions.where(F.col("confidence_score") > F.lit(float(threshold)))
            .orderBy(F.col("confidence_score").desc(), F.col("tool_code").asc())
            .limit(k))
