"""Adapters: the driver's TPC-H-style parquet tables playing the domain tables.

These views only *shape* rows into the domain schemas (tools, usage,
maintenance, events, ...); they do none of the operators' work.  Each
adapter has a DuckDB twin in ``fleetkit.plans.adapters_sql`` that yields the
identical rows, so oracle queries see the same input.

``seq`` is the arrival order used for tie-breaks.  For lineitem-derived rows
it is (l_orderkey, l_linenumber) in one BIGINT, exact up to l_orderkey 2^40,
with a remainder of (l_partkey, l_suppkey) below it that orders rows which
repeat the same order line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.functions.dates import date_lit, ts_lit

CREATED = "2001-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def padded(key: Column) -> Column:
    """A numeric key as text, zero-padded to six digits; longer keys stay whole."""
    text = key.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def code_of(key: Column) -> Column:
    """Tool code of a numeric key: 'TL-' + padded key."""
    return F.concat(F.lit("TL-"), padded(key))


def _condition_of_size(p_size: Column) -> Column:
    return (F.lit(10.0) - p_size.cast("double") * F.lit(0.171875)).cast("double")


def _seq(alias: str = "") -> Column:
    p = alias
    line = F.col(f"{p}l_orderkey").cast("long") * F.lit(8) + F.col(f"{p}l_linenumber").cast("long")
    rest = (F.col(f"{p}l_partkey").cast("long") * F.lit(7919) + F.col(f"{p}l_suppkey")) % F.lit(1_048_573)
    return (line * F.lit(1_048_576) + rest).cast("long")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        code_of(k).alias("tool_code"),
        F.col("p_name").alias("tool_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("location"),
        F.date_add(date_lit("1995-01-01"), ((k * 37) % 1500).cast("int")).alias("purchase_date"),
        F.lit(None).cast("date").alias("last_maintenance_date"),
        F.when(k % 17 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(date_lit("2001-11-11"), ((k * 13) % 120).cast("int")))
         .alias("next_maintenance_due"),
        F.when(k % 10 < 3, F.lit("in_use")).when(k % 10 == 3, F.lit("maintenance"))
         .otherwise(F.lit("available")).alias("status"),
        _condition_of_size(F.col("p_size")).alias("condition_score"),
        F.lit(0.0).alias("usage_hours"),
        F.lit(0).cast("decimal(18,2)").alias("maintenance_cost"),
        ts_lit(CREATED).alias("created_at"),
        ts_lit(CREATED).alias("updated_at"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_usage(read(spark, sf_dir, "lineitem"))


def shape_usage(li: DataFrame) -> DataFrame:
    """lineitem rows (batch or stream) as usage_history rows."""
    ln = F.col("l_linenumber")
    start = F.timestamp_add("HOUR", (ln + 7).cast("int"), F.col("l_shipdate"))
    return li.select(
        _seq().alias("seq"),
        code_of(F.col("l_partkey")).alias("tool_code"),
        F.concat(F.lit("U"), F.col("l_suppkey").cast("string")).alias("user_id"),
        F.when(ln == 7, F.lit(None).cast("timestamp_ntz")).otherwise(start).alias("checkout_time"),
        F.when(F.col("l_linestatus") == "F",
               F.timestamp_add("HOUR", (ln + 8).cast("int"), F.col("l_shipdate")))
         .otherwise(F.lit(None).cast("timestamp_ntz")).alias("checkin_time"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") / F.lit(4.0)).alias("usage_duration"),
        F.when(F.col("l_linestatus") == "O", F.lit("checkout")).otherwise(F.lit("checkin")).alias("usage_type"),
        F.lit(None).cast("string").alias("notes"),
        F.col("l_shipdate").alias("created_at"),
    )


def _condition_after() -> Column:
    return (F.when(F.col("l_linenumber") == 1, F.lit(None).cast("double"))
            .otherwise(F.lit(10.0) - F.col("l_quantity") / F.lit(16.0)))


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
           .join(s, li.l_suppkey == s.s_suppkey, "inner"))
    after = _condition_after()
    return j.select(
        _seq().alias("seq"),
        code_of(F.col("l_partkey")).alias("tool_code"),
        F.to_date(F.col("l_shipdate")).alias("maintenance_date"),
        F.col("o_orderpriority").alias("maintenance_type"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("description"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"),
        F.col("s_name").alias("technician"),
        (after - F.lit(1.0)).alias("condition_before"),
        after.alias("condition_after"),
        F.col("l_shipdate").alias("created_at"),
    )


def maintenance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintenance rows without the texts (type, description, technician):
    the measures alone need no join."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    after = _condition_after()
    return li.select(
        _seq().alias("seq"), code_of(F.col("l_partkey")).alias("tool_code"),
        F.to_date(F.col("l_shipdate")).alias("maintenance_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"),
        (after - F.lit(1.0)).alias("condition_before"), after.alias("condition_after"),
        F.col("l_shipdate").alias("created_at"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check-out (view) / check-in (click) events."""
    return shape_tool_events(read(spark, sf_dir, "events"))


def recent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows from the time of the tool events (purchases), negative
    arrival numbers apart from the stored ones."""
    e = read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return e.select(
        (-F.col("event_id")).alias("seq"), code_of(F.col("user_id")).alias("tool_code"),
        F.concat(F.lit("U"), (F.col("event_id") % 97).cast("string")).alias("user_id"),
        F.col("ts").alias("checkout_time"), F.lit(None).cast("timestamp_ntz").alias("checkin_time"),
        F.lit(None).cast("double").alias("usage_duration"), F.lit("checkout").alias("usage_type"),
        F.lit(None).cast("string").alias("notes"), F.col("ts").alias("created_at"))


def listed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the tools still in the catalogue (large parts have left it)."""
    return read(spark, sf_dir, "part").where(F.col("p_size") < 45).select(code_of(F.col("p_partkey")).alias("tool_code"))


def shape_tool_events(e: DataFrame) -> DataFrame:
    """events rows (batch or stream) as tool events."""
    return e.where(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        code_of(F.col("user_id")).alias("tool_code"),
        F.concat(F.lit("U"), (F.col("event_id") % 97).cast("string")).alias("user_id"),
        F.when(F.col("event_type") == "view", F.lit("checkout")).otherwise(F.lit("checkin")).alias("event_kind"),
    )


def part_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of parts (a Parquet row count, answered from file metadata)."""
    return read(spark, sf_dir, "part").count()


def _scan_code(n_part: int):
    return code_of((F.col("user_id") * 7 + F.col("event_id")) % F.lit(2 * n_part))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned codes: error/signup events; about half point at unknown codes."""
    return shape_scans(read(spark, sf_dir, "events"), part_count(spark, sf_dir))


def shape_scans(e: DataFrame, n_part: int) -> DataFrame:
    return (e.where(F.col("event_type").isin("error", "signup"))
             .select(F.col("event_id").alias("seq"), F.col("ts"), _scan_code(n_part).alias("code")))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return e.select(F.col("event_id").alias("seq"), _scan_code(part_count(spark, sf_dir)).alias("tool_code"),
                    F.when(F.col("event_type") == "error", F.lit("maintenance"))
                     .otherwise(F.lit("available")).alias("status"))


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk-import batch: every part as a new code (some with null / empty
    names, some sent twice) plus existing codes sent twice.  One scan of
    part; each part row emits its 1-4 batch rows through ``explode``."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    new_code = F.concat(F.lit("TN-"), padded(k))      # codes of their own, whatever the number of parts
    new_name = (F.when(k % 11 == 0, F.lit(None).cast("string"))
                 .when(k % 13 == 0, F.lit("")).otherwise(F.col("p_name")))

    def row(seq_off, code, name):
        return F.struct((k * 4 + seq_off).alias("seq"), code.alias("tool_code"), name.alias("tool_name"))

    none = F.lit(None).cast("struct<seq:bigint,tool_code:string,tool_name:string>")
    rows = F.array(row(0, new_code, new_name),
                   F.when(k % 7 == 0, row(3, new_code, F.col("p_name"))).otherwise(none),
                   F.when(k % 5 == 0, row(1, code_of(k), F.col("p_name"))).otherwise(none),
                   F.when(k % 5 == 0, row(2, code_of(k), F.col("p_name"))).otherwise(none))
    return (p.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"), "p_type", "p_brand",
                     F.date_add(date_lit("1995-01-01"), ((k * 37) % 1500).cast("int")).alias("purchase_date"),
                     _condition_of_size(F.col("p_size")).alias("condition_score"))
             .select("r.seq", "r.tool_code", "r.tool_name", F.col("p_type").alias("category"),
                     F.col("p_brand").alias("location"), "purchase_date", "condition_score"))


def prediction_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic model outputs per tool (condition prediction, anomaly
    decision score) so the fusion rules can be checked exactly."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        code_of(k).alias("tool_code"),
        (F.col("p_size") / F.lit(5.0)).alias("condition_pred"),
        ((((k * 7) % 101) - 50) / F.lit(25.0)).alias("anomaly_score"),
    )


def label_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-printing batch: tool codes (some missing) plus '/' and ' '
    variants of some codes, which collide on file name (one scan of part)."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pad = padded(k)

    def row(seq_off, code):
        return F.struct((k * 3 + seq_off).alias("seq"), code.alias("tool_code"))

    none = F.lit(None).cast("struct<seq:bigint,tool_code:string>")
    rows = F.array(row(0, F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(code_of(k))),
                   F.when(k % 50 == 0, row(1, F.concat(F.lit("TL/"), pad))).otherwise(none),
                   F.when(k % 50 == 0, row(2, F.concat(F.lit("TL "), pad))).otherwise(none))
    return (p.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"), "p_name")
             .select("r.seq", "r.tool_code", F.col("p_name").alias("tool_name")))


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate scanned payloads (ASCII) for the code-validity rule."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    code = code_of(k)
    variant = (F.when(k % 9 == 0, F.lower(code))
                .when(k % 9 == 1, F.col("p_name"))
                .when(k % 9 == 2, F.col("p_brand"))
                .when(k % 9 == 3, F.concat(code, F.lit("\n")))
                .when(k % 9 == 4, F.concat(code, F.lit("\r\n")))
                .when(k % 9 == 5, F.substring(code, 1, 2))
                .when(k % 9 == 6, F.concat(code, code, code))
                .when(k % 9 == 7, F.when(k % 2 == 0, F.lit("")).otherwise(F.lit(None).cast("string")))
                .otherwise(code))
    return p.select(k.alias("seq"), variant.alias("code"))


def raw_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamp text in mixed ISO forms (space / 'T', fractional seconds,
    bare dates, junk) built from the order dates."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    text = (F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
             .when(k % 5 == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T09:00:00.5")))
             .when(k % 5 == 2, F.date_format(d, "yyyy-MM-dd"))
             .when(k % 5 == 3, F.lit("bad"))
             .otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 23:59:59"))))
    return o.select(k.alias("seq"), text.alias("raw"))


class Fleet:
    """All adapter views for one scale directory, built on first access
    (lazy DataFrames; ``scans`` / ``status_updates`` need a part count)."""

    _BUILDERS = {
        "tools": tools, "usage": usage, "maintenance": maintenance, "maintenance_facts": maintenance_facts, "tool_events": tool_events,
        "recent_usage": recent_usage, "listed_tools": listed_tools,
        "scans": scans, "status_updates": status_updates, "intake": intake,
        "prediction_inputs": prediction_inputs, "label_batch": label_batch,
        "raw_codes": raw_codes, "raw_timestamps": raw_timestamps,
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._BUILDERS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._BUILDERS[name](self._spark, self._sf)
        return self._cache[name]


def load(spark: SparkSession, sf_dir: str) -> Fleet:
    return Fleet(spark, sf_dir)
