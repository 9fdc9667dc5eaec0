"""Physical-plan properties on Parquet-backed domain tables: filters reach
the scan, columns are pruned, aggregates are partial+final, and no operator
plans a cartesian product."""

from fleet_rows import AS_OF, SF_SMALL
from fleetkit.operators import kpis, ledger
from fleetkit.session import shared_path
from fleetkit.sources import tables as A
from fleetkit.sources.testdata import load


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")   # no "..." in scan metadata
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(spark, name, df):
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_due_scan_pushes_filters_and_prunes(spark):
    tools = _stored(spark, "plan-tools", load(spark, SF_SMALL).tools)
    plan = _plan(A.due_scan(tools, AS_OF, 7).select("tool_code", "next_maintenance_due"))
    assert "PushedFilters: [IsNotNull(next_maintenance_due), IsNotNull(status), " \
           "LessThanOrEqual(next_maintenance_due" in plan
    assert "Not(EqualTo(status,maintenance))" in plan
    assert "ReadSchema: struct<tool_code:string,next_maintenance_due:date,status:string>" in plan


def test_usage_stats_partial_aggregation_and_pruning(spark):
    usage = _stored(spark, "plan-usage", load(spark, SF_SMALL).usage)
    plan = _plan(kpis.usage_stats(usage))
    assert plan.count("HashAggregate") == 2          # partial (map side) + final
    assert "ReadSchema: struct<tool_code:string,checkout_time:timestamp_ntz,usage_duration:double>" in plan


def test_ledger_apply_has_no_cartesian_product(spark):
    f = load(spark, SF_SMALL)
    for df in (ledger.apply_usage(f.tools, f.usage, AS_OF), ledger.apply_maintenance(f.tools, f.maintenance, AS_OF),
               kpis.analytics_kpis(f.usage, f.tools), kpis.daily_summary(f.tools, f.usage, AS_OF, AS_OF.date())):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_maintenance_apply_is_hash_aggregated(spark):
    m = _stored(spark, "plan-maint", load(spark, SF_SMALL).maintenance)
    t = _stored(spark, "plan-tools2", load(spark, SF_SMALL).tools)
    plan = _plan(ledger.apply_maintenance(t, m, AS_OF))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_month_partitioned_usage_prunes(spark):
    import datetime as dt
    from fleetkit.sources import files
    path = shared_path(spark, "plan-usage-months")
    files.write_usage(load(spark, SF_SMALL).usage, path)
    usage = files.read_usage(spark, path)
    q = kpis.daily_usage(usage, start=dt.date(2000, 6, 1), end=dt.date(2000, 6, 30))
    plan = _plan(q)
    assert "PartitionFilters: [isnotnull(usage_month" in plan and "(usage_month" in plan
    full = {r.usage_date: r.total_hours for r in kpis.daily_usage(load(spark, SF_SMALL).usage).collect()
            if dt.date(2000, 6, 1) <= r.usage_date <= dt.date(2000, 6, 30)}
    assert {r.usage_date: r.total_hours for r in q.collect()} == full and full


def test_bucketed_tables_make_features_shuffle_free(spark):
    """Tools, usage and maintenance bucketed by tool_code (same bucket count):
    the per-tool statistics and both feature joins need no Exchange."""
    from fleetkit.operators.features import prepare_features
    from fleetkit.sources import files
    f = load(spark, SF_SMALL)
    t = files.write_bucketed(f.tools, "fk_tools_b", shared_path(spark, "b-tools"), buckets=8)
    u = files.write_bucketed(f.usage, "fk_usage_b", shared_path(spark, "b-usage"), buckets=8)
    m = files.write_bucketed(f.maintenance, "fk_maint_b", shared_path(spark, "b-maint"), buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # force the shuffle-join path
    try:
        df = prepare_features(t, u, m, AS_OF, usage_empty=False, maintenance_empty=False)
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        expect = sorted(tuple(r) for r in prepare_features(f.tools, f.usage, f.maintenance, AS_OF).collect())
        assert sorted(tuple(r) for r in df.collect()) == expect
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
