"""Fixed values.

Everything in this module is a value that must equal the behaviour being
re-expressed (labels, thresholds, messages, formats); they are stated plainly
and in natural order.  Operators take them as default arguments.
"""

from __future__ import annotations

import datetime as _dt

# Reference instant used by tests and registered queries instead of a wall
# clock.  Noon, so the two day-count rules (floor of +/- differences) differ.
AS_OF = _dt.datetime(2001, 12, 1, 12, 0, 0)

# ---- fixed values: tool table defaults -------------------------------------
DEFAULT_STATUS = "available"
DEFAULT_CONDITION = 10.0

# ---- fixed values: usage event kinds ----------------------------------------
CHECKOUT = "checkout"
CHECKIN = "checkin"

# ---- fixed values: maintenance horizons (days) ------------------------------
DUE_HORIZON_ALERT = 7
DUE_HORIZON_PAGE = 30
URGENT_DAYS = 3
DUE_COUNT_URGENT_OVER = 5          # inventory KPI: 'Urgent' if due count > 5

# ---- fixed values: risk thresholds (all strict '>') -------------------------
RISK_HIGH = 0.8                    # dashboard, runner, alert
RISK_CHART = 0.7                   # analytics chart
RISK_RECOMMEND = 0.6               # recommendations
PRIORITY_BANDS = ((0.8, "Critical"), (0.6, "High"), (0.4, "Medium"))
PRIORITY_DEFAULT = "Low"
ACTION_BANDS = (
    (0.9, "Immediate inspection and preventive maintenance required"),
    (0.8, "Schedule comprehensive maintenance within 3 days"),
    (0.7, "Plan preventive maintenance within 1 week"),
    (0.6, "Monitor closely and schedule routine maintenance"),
)
ACTION_DEFAULT = "Continue normal usage and monitoring"
REASON_CONDITION = "Poor tool condition"
REASON_ANOMALY = "Unusual usage pattern detected"
REASON_HIGH = "High probability of failure"
REASON_DEFAULT = "Based on usage patterns and condition"
REASON_SEP = "; "
RISK_ALERT_ACTION = "Immediate inspection and preventive maintenance"
BASE_MAINTENANCE_COST = 100.0
CONDITION_WEIGHT = 0.7
ANOMALY_WEIGHT = 0.3
FAILURE_HORIZON_DAYS = 30
MODEL_VERSION = "1.0"

# ---- fixed values: model training -------------------------------------------
FEATURE_COLUMNS = (
    "condition_score", "usage_hours", "days_since_purchase",
    "days_since_last_maintenance", "total_usage_hours", "avg_usage_hours",
    "usage_count", "checkout_count", "total_maintenance_cost",
    "avg_maintenance_cost", "maintenance_count", "usage_intensity",
    "maintenance_frequency", "cost_per_hour", "category_encoded",
    "location_encoded", "status_encoded",
)
CATEGORICAL_COLUMNS = ("category", "location", "status")
NULL_LABEL = "None"                # str(None) used for missing categories
TEST_FRACTION_TENTHS = 2           # 20 % hold-out
SPLIT_SEED = 42
MIN_TRAIN_ROWS = 10                # train only if rows > 10
MIN_FEATURES = 5
RF_TREES = 100
RF_DEPTH = 10
IF_TREES = 100
IF_MAX_SAMPLES = 256
IF_CONTAMINATION = 0.1
RETRAIN_AFTER_HOURS = 24

# ---- fixed values: labels and codes -------------------------------------------
CODE_MIN_LEN = 3
CODE_MAX_LEN = 20
CODE_PATTERN = r"^[A-Z0-9\-_]+$"   # a valid tool code, upper-cased
LABEL_SUFFIX = "_qr.png"
LABEL_DIR = "qr_codes/"
MISSING_CODE_ERROR = "Missing tool_code"

# ---- fixed values: text formats ----------------------------------------------
DASH_OVERDUE = "OVERDUE"
URGENCY_URGENT = "urgent"
URGENCY_WARNING = "warning"
MAINT_FLAG_OVERDUE = "overdue"
MAINT_FLAG_WARN = "warn"
MAINT_FLAG_WARN_DAYS = 7
KPI_URGENT = "Urgent"
KPI_NORMAL = "Normal"
CURRENCY = "€"

# ---- fixed values: plain-text digests (header, one block per item, footer) -------
MAINTENANCE_HEADER = """
TOOL MAINTENANCE ALERT
{company} - Tool Inventory System

The following tools require maintenance attention:

"""
MAINTENANCE_BLOCK = """
Tool: %s (%s)
Category: %s
Location: %s
Maintenance Due: %s
Status: %s
Condition: %s/10
Usage Hours: %s
---
"""
MAINTENANCE_FOOTER = """

This is an automated message from the Tool Inventory System.
Generated on: {stamp}
"""
RISK_HEADER = """
HIGH RISK TOOL ALERT
{company} - AI Prediction System

Our AI system has identified the following tools at high risk of failure:

"""
RISK_BLOCK = """
Tool Code: %s
Risk Score: %s
Priority: %s
Estimated Failure Date: %s
Days Until Maintenance: %s
Recommended Action: Immediate inspection and preventive maintenance
---
"""
RISK_FOOTER = """

This alert was generated by the AI predictive maintenance system.
Please take immediate action to prevent tool failures and potential safety issues.

Generated on: {stamp}
"""
SUMMARY_HEADER = """
DAILY TOOL INVENTORY SUMMARY
{company} - {day}

OVERVIEW:
Total Tools: %s
Available: %s
In Use: %s
Need Maintenance: %s

USAGE STATISTICS:
Total Usage Today: %s hours
Active Tools: %s
Average Usage per Tool: %s hours
"""
SUMMARY_URGENT_TITLE = """

URGENT MAINTENANCE REQUIRED:
"""
SUMMARY_URGENT_LINE = "• %s (%s) - %s"
SUMMARY_FOOTER = """

Daily summary generated automatically by the Tool Inventory System.
Generated on: {stamp}
"""
STAMP_FORMAT = "%Y-%m-%d %H:%M:%S"

# ---- fixed values: histogram ---------------------------------------------------
HIST_BINS = 10
HIST_LOW = 0.0
HIST_HIGH = 10.0

# ---- fixed values: retention ---------------------------------------------------
RETENTION_DAYS_DEFAULT = 90
