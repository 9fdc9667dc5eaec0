"""Registered queries against the DuckDB oracle on the smallest scale, the
entry point, and stream = batch."""

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fleet_rows import SF_SMALL

TABLES = ["part", "lineitem", "orders", "supplier", "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _oracle_keys():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("key", _oracle_keys())
def test_query_matches_oracle(spark, duck, key):
    from __spark_entry__ import oracle_sql, queries
    sdf = queries()[key](spark, SF_SMALL)
    rel = duck.execute(oracle_sql()[key])
    dcols = [c[0] for c in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = [dcols.index(c) for c in sdf.columns]
    drows = Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    srows = Counter(tuple(_norm(x) for x in r) for r in sdf.collect())
    assert srows == drows


def test_every_oracle_key_is_a_query():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())


def test_entry_flagship(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert df.columns[0] == "tool_code" and "urgency_score" in df.columns
    scores = [r.urgency_score for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_stream_sessions_equal_batch(spark):
    from __spark_entry__ import queries
    q = queries()
    a = Counter(tuple(_norm(x) for x in r) for r in q["stream_sessions"](spark, SF_SMALL).collect())
    b = Counter(tuple(_norm(x) for x in r) for r in q["paired_sessions"](spark, SF_SMALL).collect())
    assert a == b and len(a) > 0


def test_stream_ledger_equals_batch(spark):
    from __spark_entry__ import queries
    q = queries()
    s = {r.tool_code: round(r.usage_hours, 6) for r in q["stream_ledger"](spark, SF_SMALL).collect()}
    b = {r.tool_code: r.usage_hours for r in q["usage_apply"](spark, SF_SMALL).collect()}
    assert s == b


def test_intake_csv_roundtrip_matches_batch(spark):
    """An empty cell reads back as null (as a pandas CSV reader does): the CSV
    path equals batch classification of the intake with '' as null."""
    from __spark_entry__ import queries
    from fleetkit.operators import ledger
    from fleetkit.sources.testdata import load
    f = load(spark, SF_SMALL)
    nulled = f.intake.withColumn("tool_name", F.when(F.col("tool_name") == "", None).otherwise(F.col("tool_name")))
    expect = Counter((r.seq, r.reject_reason) for r in ledger.classify_intake(nulled, f.tools).collect())
    got = Counter((r.seq, r.reject_reason) for r in queries()["intake_csv"](spark, SF_SMALL).collect())
    assert got == expect and f.intake.where("tool_name = ''").count() > 0


@pytest.mark.parametrize("key", ["latest_usage", "checkin_apply", "paired_sessions", "condition_trend",
                                 "intake_rejects", "features", "label_codes", "status_apply", "maintenance_apply"])
def test_results_do_not_depend_on_partitioning(spark, key):
    from __spark_entry__ import queries
    fn = queries()[key]
    results = []
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(Counter(tuple(_norm(x) for x in r) for r in fn(spark, SF_SMALL).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert results[0] == results[1] and sum(results[0].values()) > 0


def test_cli_list_and_unknown_key(capsys):
    from fleetkit.__main__ import main
    from fleetkit.plans.registry import spark_queries
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert [x.split()[0] for x in out.strip().splitlines()] == sorted(spark_queries())
    assert "features" in out and "stream_sessions" in out
    assert main(["run", "no_such_key", "--tables", SF_SMALL]) == 2


def test_bench_prints_one_json_line():
    import json
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_RUNS="1")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py"), "usage_stats"], env=env,
                         capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec) and rec["unit"] == "sec"
    assert rec["queries"]["usage_stats"] > 0 and rec["sf"] == "sf0.001"
