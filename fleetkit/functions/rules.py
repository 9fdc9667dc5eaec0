"""Scalar rules as reusable Column functions (labels, clamps, formats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetkit import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round2(x) -> Column:
    """numpy-style rounding to 2 decimals (half-to-even on the scaled value)."""
    return F.rint(_c(x) * F.lit(100.0)) / F.lit(100.0)


def safe_div(num, den) -> Column:
    """Division that yields null (not an ANSI error) on a zero divisor."""
    return F.try_divide(_c(num), _c(den))


def alert_label(days_until_col) -> Column:
    """S3: 'OVERDUE by n days' when negative, else 'Due in n days'."""
    d = _c(days_until_col)
    return (F.when(d < 0, F.format_string("OVERDUE by %d days", F.abs(d)))
            .otherwise(F.format_string("Due in %d days", d)))


def alert_class(days_until_col, urgent_days: int = K.URGENT_DAYS) -> Column:
    """S4: 'urgent' when overdue or within ``urgent_days``, else 'warning'."""
    d = _c(days_until_col)
    return F.when((d < 0) | (d <= urgent_days), F.lit(K.URGENCY_URGENT)).otherwise(F.lit(K.URGENCY_WARNING))


def dashboard_label(days_overdue_col) -> Column:
    """S5: 'OVERDUE' when days overdue > 0, else 'Due in |d| days'."""
    d = _c(days_overdue_col)
    return (F.when(d > 0, F.lit(K.DASH_OVERDUE))
            .otherwise(F.format_string("Due in %d days", F.abs(d))))


def page_label(days_until_col) -> Column:
    """Maintenance-page label: 'OVERDUE' when negative else 'n days'."""
    d = _c(days_until_col)
    return F.when(d < 0, F.lit(K.DASH_OVERDUE)).otherwise(F.format_string("%d days", d))


def maintenance_flag(days_until_col, warn_days: int = K.MAINT_FLAG_WARN_DAYS) -> Column:
    """C8 in the intended order: overdue first, then 'warn' within the window."""
    d = _c(days_until_col)
    return (F.when(d < 0, F.lit(K.MAINT_FLAG_OVERDUE))
            .when(d <= warn_days, F.lit(K.MAINT_FLAG_WARN)))


def clamp(x, lo=None, hi=None) -> Column:
    """S9."""
    x = _c(x)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def sigmoid_neg(score) -> Column:
    """1 / (1 + e^score) — negative (anomalous) scores map above 0.5."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(score)))


def priority(risk) -> Column:
    """Critical / High / Medium / Low by strict thresholds."""
    r = _c(risk)
    expr = None
    for threshold, label in K.PRIORITY_BANDS:
        expr = (F.when(r > threshold, F.lit(label)) if expr is None
                else expr.when(r > threshold, F.lit(label)))
    return expr.otherwise(F.lit(K.PRIORITY_DEFAULT))


def recommended_action(risk) -> Column:
    r = _c(risk)
    expr = None
    for threshold, label in K.ACTION_BANDS:
        expr = (F.when(r > threshold, F.lit(label)) if expr is None
                else expr.when(r > threshold, F.lit(label)))
    return expr.otherwise(F.lit(K.ACTION_DEFAULT))


def reasons(condition_risk, anomaly_risk, risk) -> Column:
    """S16: '; '-joined reasons, or the default sentence when none applies."""
    joined = F.concat_ws(
        K.REASON_SEP,
        F.when(_c(condition_risk) > 0.7, F.lit(K.REASON_CONDITION)),
        F.when(_c(anomaly_risk) > 0.7, F.lit(K.REASON_ANOMALY)),
        F.when(_c(risk) > 0.8, F.lit(K.REASON_HIGH)),
    )
    return F.when(joined == "", F.lit(K.REASON_DEFAULT)).otherwise(joined)


def status_css(status) -> Column:
    """Status with spaces replaced by '-' (used as a style class)."""
    return F.replace(_c(status), F.lit(" "), F.lit("-"))


def fmt1(x) -> Column:
    """Python '{:.1f}' (round half away from zero on the decimal value)."""
    return F.format_string("%.1f", F.round(_c(x), 1))


def percent1(fraction) -> Column:
    """S13: '{:.1%}' — fraction shown as percent with one decimal."""
    return F.concat(fmt1(_c(fraction) * F.lit(100.0)), F.lit("%"))


def money(x, symbol: str = K.CURRENCY) -> Column:
    """S13: '€{:,.2f}'."""
    return F.concat(F.lit(symbol), F.format_number(F.round(_c(x), 2), 2))


def code_valid(code) -> Column:
    """Non-blank, 3..20 chars (untrimmed), upper-cased text matches
    ``^[A-Z0-9-_]+$`` where ``$`` also accepts one final newline (the
    semantics of a Python ``re.match`` with ``$``).  Null -> False."""
    c = _c(code)
    pattern = K.CODE_PATTERN.removesuffix("$") + r"\n?\z"
    ok = (F.length(c).between(K.CODE_MIN_LEN, K.CODE_MAX_LEN)
          & (F.length(F.trim(c, F.lit(" \t\n\r\f\u000b"))) > 0)
          & F.upper(c).rlike(pattern))
    return F.coalesce(ok, F.lit(False))


def label_file_name(code, suffix: str = K.LABEL_SUFFIX) -> Column:
    """S15: '/' and ' ' become '_' and the label suffix is appended."""
    return F.concat(F.translate(_c(code), "/ ", "__"), F.lit(suffix))


def recipient_list(csv_text) -> Column:
    """Split a comma list, trim each entry, drop empty ones."""
    parts = F.transform(F.split(_c(csv_text), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")
