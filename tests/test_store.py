"""The reference's store tests, re-expressed on batch operators with a fixed as-of."""

import datetime as dt
import decimal

from pyspark.sql import functions as F

from fleet_rows import AS_OF, d, tool_row
from fleetkit import schemas
from fleetkit.operators import ledger
from fleetkit.operators.risk import fuse
from fleetkit.session import shared_path
from fleetkit.sources import files
from fleetkit.sources import tables as A


def _intake(spark, rows):
    return spark.createDataFrame(rows, schemas.INTAKE)


def test_initialisation_typed_empty_frames(spark):
    for s in (schemas.TOOLS, schemas.USAGE, schemas.MAINTENANCE, schemas.PREDICTIONS):
        df = schemas.empty(spark, s)
        assert df.count() == 0 and df.schema == s


def test_add_tool_applies_defaults(spark, make_tools):
    empty = make_tools([])
    batch = _intake(spark, [(1, "TEST-001", "Test Pneumatic Drill", "Power Tools", "Test Workshop",
                             dt.date(2023, 1, 15), None)])
    got = ledger.accepted_tools(batch, empty, AS_OF).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.tool_name, r.category, r.status, r.condition_score, r.usage_hours) == \
           ("Test Pneumatic Drill", "Power Tools", "available", 10.0, 0.0)


def test_duplicate_rejected_in_table_and_batch(spark, make_tools, sample_tool):
    stored = make_tools([sample_tool])
    batch = _intake(spark, [
        (1, "TEST-001", "again", "Power Tools", "W", None, 9.0),      # already stored
        (2, "NEW-1", "n", "Hand Tools", "W", None, 9.0),              # accepted
        (3, "NEW-1", "n2", "Hand Tools", "W", None, 9.0),             # duplicate in batch
        (4, "NEW-2", None, "Hand Tools", "W", None, 9.0),             # missing required
        (5, "NEW-2", "ok", "Hand Tools", "W", None, 9.0),             # first complete row wins
        (6, "NEW-3", "", "Hand Tools", "W", None, 9.0),               # '' accepted by the store
    ])
    got = {r.seq: r.reject_reason for r in ledger.classify_intake(batch, stored).collect()}
    assert got == {1: "already_exists", 2: None, 3: "duplicate_in_batch", 4: "missing_required",
                   5: None, 6: None}
    summary = ledger.intake_summary(ledger.classify_intake(batch, stored)).first()
    assert (summary.added, summary.errors, summary.total) == (3, 3, 6)
    form = {r.seq: r.form_valid for r in ledger.form_valid(batch).collect()}
    assert form[6] is False and form[2] is True and form[4] is False


def test_get_tool_and_missing(spark, make_tools, sample_tool):
    t = make_tools([sample_tool])
    assert A.tool_lookup(t, "TEST-001").count() == 1
    assert A.tool_lookup(t, "NON-EXISTENT").count() == 0


def test_get_all_tools(spark, make_tools, sample_tool):
    assert A.tools_scan(make_tools([])).count() == 0
    rows = A.tools_scan(make_tools([sample_tool])).collect()
    assert len(rows) == 1 and rows[0].tool_code == "TEST-001"


def test_update_status_and_unknown_code(spark, make_tools, sample_tool):
    t = make_tools([sample_tool])
    upd = spark.createDataFrame([(1, "TEST-001", "maintenance"), (2, "TEST-001", "in_use"),
                                 (3, "NON-EXISTENT", "in_use")], schemas.STATUS_UPDATES)
    new = ledger.apply_status(t, upd, AS_OF).first()
    assert new.status == "in_use"                     # last arrival wins
    assert new.updated_at == AS_OF
    miss = ledger.unmatched_updates(t, upd).collect()
    assert [(r.tool_code, r.n_updates) for r in miss] == [("NON-EXISTENT", 1)]


def test_record_usage_adds_hours(spark, make_tools, sample_tool):
    t = make_tools([sample_tool])
    u = spark.createDataFrame([
        (1, "TEST-001", "test_user", AS_OF, None, 2.5, "checkout", "Test usage", AS_OF),
        (2, "TEST-001", "u2", AS_OF, None, None, "checkout", None, AS_OF),
        (3, "TEST-001", "u3", AS_OF, None, 0.0, "checkout", None, AS_OF),
        (4, "ORPHAN", "u4", AS_OF, None, 5.0, "checkout", None, AS_OF),
    ], schemas.USAGE)
    new = ledger.apply_usage(t, u, AS_OF).first()
    assert new.usage_hours == 2.5 and new.updated_at == AS_OF
    only_zero = u.where(F.col("seq").isin(2, 3))
    untouched = ledger.apply_usage(t, only_zero, AS_OF).first()
    assert untouched.usage_hours == 0.0 and untouched.updated_at == dt.datetime(2001, 1, 1)
    rows = A.usage_scan(u, "TEST-001").collect()
    assert len(rows) == 3 and rows[0].user_id == "test_user"


def test_record_maintenance_sets_condition_and_cost(spark, make_tools, sample_tool):
    t = make_tools([sample_tool])
    m = spark.createDataFrame([
        (2, "TEST-001", AS_OF.date(), "Preventive", "Routine maintenance", decimal.Decimal("150.00"),
         "John Doe", 8.5, 9.5, AS_OF),
        # arrived earlier, later business date: must NOT win
        (1, "TEST-001", AS_OF.date() + dt.timedelta(days=5), "Preventive", None, decimal.Decimal("10.00"),
         None, None, None, AS_OF),
    ], schemas.MAINTENANCE)
    new = ledger.apply_maintenance(t, m, AS_OF).first()
    assert new.condition_score == 9.5
    assert float(new.maintenance_cost) == 160.0
    assert new.last_maintenance_date == AS_OF.date()
    only_absent = ledger.apply_maintenance(t, m.where("seq = 1"), AS_OF).first()
    assert only_absent.condition_score == 10.0       # absent condition_after -> 10.0


def test_due_for_maintenance_horizon_inclusive(spark, make_tools):
    t = make_tools([tool_row("SOON-001", due=d(3), condition=7.0), tool_row("LATER-001", due=d(30), condition=9.0),
                    tool_row("EDGE-007", due=d(7)), tool_row("EDGE-008", due=d(8)),
                    tool_row("NULL-DUE", due=None), tool_row("NULL-STATUS", due=d(1), status=None),
                    tool_row("IN-MAINT", due=d(1), status="maintenance")])
    seven = [r.tool_code for r in A.due_scan(t, AS_OF, 7).collect()]
    assert seven == ["SOON-001", "EDGE-007"]
    assert A.due_scan(t, AS_OF, 45).count() == 4


def test_store_and_get_predictions(spark):
    inp = spark.createDataFrame([("TEST-001", 9.0, -1.0), ("T2", 1.0, 1.0)],
                                "tool_code string, condition_pred double, anomaly_score double")
    pred = fuse(inp, AS_OF)
    path = shared_path(spark, "test-predictions")
    files.append_predictions(pred, path)
    files.append_predictions(pred, path)          # append-only, no de-dup
    back = files.read_predictions(spark, path)
    assert back.count() == 4
    one = A.predictions_scan(back, "TEST-001").collect()
    assert len(one) == 2 and one[0].maintenance_priority == "Critical"
    ordered = [r.tool_code for r in A.predictions_scan(back).collect()]
    assert ordered[:2] == ["TEST-001", "TEST-001"]


def test_json_export_and_csv_preview(spark, make_tools, sample_tool):
    import json
    t = make_tools([sample_tool, tool_row("TW-002", "Torque Wrench", "Hand Tools", "Workshop B", condition=8.0)])
    rows = [json.loads(r.json) for r in files.tools_json(t).collect()]
    assert rows[0] == {"tool_code": "TEST-001", "tool_name": "Test Pneumatic Drill", "category": "Power Tools",
                       "location": "Test Workshop", "status": "available", "condition_score": 8.5, "usage_hours": 0.0}
    path = shared_path(spark, "test-json")
    files.write_json(t.select("tool_code", "condition_score"), path)
    assert spark.read.json(path).count() == 2
    assert [r.tool_code for r in files.preview(t, n=1).collect()] == ["TEST-001"]
    csv = shared_path(spark, "test-csv")
    files.export_csv(t.select("tool_code", "tool_name"), csv)
    back = files.read_export_csv(spark, csv, t.select("tool_code", "tool_name").schema)
    assert sorted(r.tool_code for r in back.collect()) == ["TEST-001", "TW-002"]


def test_seed_only_when_empty(spark, make_tools, seed_tools, sample_tool):
    def seeded(tools):
        return tools if not tools.isEmpty() else make_tools(seed_tools)     # guard: LIMIT-1 probe
    t = seeded(make_tools([]))
    assert t.count() == 5 and t.select("category").distinct().count() == 4
    assert [r.tool_code for r in A.due_scan(t, AS_OF, 30).collect()] == ["SEED-PWR-2", "SEED-PWR-1"]
    assert seeded(make_tools([sample_tool])).count() == 1


def test_orphans_facets_and_alert_text(spark, make_tools, sample_tool):
    from fleetkit.operators import digests, filters
    t = make_tools([sample_tool, tool_row("NULL-STATUS", status=None, category="Hand Tools", due=d(1))])
    u = spark.createDataFrame([(1, "GHOST", "u", AS_OF, None, 1.0, "checkout", None, AS_OF),
                               (2, "TEST-001", "u", AS_OF, None, 1.0, "checkout", None, AS_OF)], schemas.USAGE)
    m = spark.createDataFrame([(1, "GHOST2", AS_OF.date(), "P", None, decimal.Decimal("1.00"), None, None, None, None)],
                              schemas.MAINTENANCE)
    p = fuse(spark.createDataFrame([("GHOST3", 1.0, 0.0)], "tool_code string, condition_pred double, anomaly_score double"),
             AS_OF)
    got = sorted(tuple(r) for r in ledger.orphan_rows(t, u, m, p).collect())
    assert got == [("maintenance_history", "GHOST2"), ("predictions", "GHOST3"), ("usage_history", "GHOST")]
    # pandas-style membership: a None in the selection keeps null statuses
    assert {r.tool_code for r in filters.facet_filter(t, ["available"]).collect()} == {"TEST-001"}
    assert {r.tool_code for r in filters.facet_filter(t, ["available", None]).collect()} == {"TEST-001", "NULL-STATUS"}
    alerts = digests.alert_rows(make_tools([tool_row("A-1", "Drill", "Power Tools", "Bay 1", due=d(0), condition=8.5)]), AS_OF)
    rows = digests.alert_text(alerts, AS_OF).orderBy("block").collect()
    assert [r.block for r in rows] == [0, 1, 2]
    assert rows[1].text == ("\nTool: Drill (A-1)\nCategory: Power Tools\nLocation: Bay 1\n"
                            f"Maintenance Due: {d(0).isoformat()}\nStatus: OVERDUE by 1 days\n"
                            "Condition: 8.5/10\nUsage Hours: 0.0\n---\n")
    assert rows[2].text.endswith("Generated on: 2001-12-01 12:00:00\n")


def test_risk_and_summary_texts(spark, make_tools):
    from fleetkit.operators import digests, filters, kpis
    from fleetkit.sources.tables import due_scan
    inputs = "tool_code string, condition_pred double, anomaly_score double"
    p = fuse(spark.createDataFrame([("R-1", 10.0, -9.0), ("R-2", 0.0, 5.0)], inputs), AS_OF)
    rows = digests.risk_text(p, AS_OF).orderBy("block").collect()
    assert [r.block for r in rows] == [0, 1, 2] and rows[1].tool_code == "R-1"
    assert rows[0].text.startswith("\nHIGH RISK TOOL ALERT\nEngineering - AI Prediction System\n")
    assert rows[1].text.startswith("\nTool Code: R-1\nRisk Score: 100.0%\nPriority: Critical\n")
    assert digests.risk_text(p.where("tool_code = 'R-2'"), AS_OF).count() == 0
    u = spark.createDataFrame([], schemas.USAGE)
    for tools, blocks in ((make_tools([tool_row("A-1", "Drill", due=d(0))]), [0, 1, 2, 3]),
                          (make_tools([tool_row("A-1", "Drill")]), [0, 3])):
        urgent = filters.urgent_items(due_scan(tools, AS_OF, 30), AS_OF)
        text = digests.summary_text(kpis.daily_summary(tools, u, AS_OF, AS_OF.date()), urgent, AS_OF)
        rows = text.orderBy("block").collect()
        assert [r.block for r in rows] == blocks
        assert "Total Tools: 1\n" in rows[0].text and "Total Usage Today: 0.0 hours\n" in rows[0].text
        if len(blocks) == 4:
            assert rows[2].text == "• Drill (A-1) - OVERDUE by 1 days"


def test_malformed_lines_are_rejects(spark, make_tools):
    """Lines with too many, too few and unreadable cells are errors with their text; the other lines are not touched."""
    import datetime as dt

    from fleetkit.session import shared_path
    from fleetkit.sources import files
    lines = ["seq,tool_code,tool_name,category,location,purchase_date,condition_score",
             "1,A,Drill,Power,Shop,2024-01-05,9.5", "2,B,Saw,Power,Shop,2024-01-05,9.5,extra", "3,C,Saw",
             "4,D,Saw,Power,Shop,yesterday,9.5", "5,E,Saw,Power,Shop,2024-01-05,very good", '6,F,"Saw, big",Power,Shop,,',
             "x,G,Saw,Power,Shop,soon,", "8,B,Saw,Power,Shop,,7", "9,,Saw,Power,Shop,,7", "10,A,Drill,Power,Shop,,1", ",,,,,,"]
    path = shared_path(spark, "broken-csv")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    read = files.with_malformed(files.read_intake_csv(spark, path, schemas.INTAKE), schemas.INTAKE)
    got = {(r[files.CORRUPT] or r.seq): r for r in ledger.classify_intake(read, make_tools([])).collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {
        1: None, lines[2]: "malformed too_many_fields", lines[3]: "malformed too_few_fields",
        lines[4]: "malformed bad_value:purchase_date", lines[5]: "malformed bad_value:condition_score", 6: None,
        lines[7]: "malformed bad_value:seq,purchase_date", 8: None, 9: "missing_required", 10: "duplicate_in_batch",
        None: "missing_required"}
    assert got[6].tool_name == "Saw, big" and got[8].outcome == "added"     # B's broken line does not count as its first
    assert files.export_name("tools", dt.date(2024, 6, 1)) == "tools_export_20240601.csv"
