"""Stream-only behaviour: the event-time timeout of the session state."""

import datetime as dt
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fleetkit.session import shared_path
from fleetkit.operators.windows import paired_sessions
from fleetkit.sources.testdata import shape_tool_events
from fleetkit.streaming import streams

T0 = dt.datetime(2024, 1, 1, 10, 0)
SCHEMA = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
                    ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])


def _write(path, name, rows):
    cols = list(zip(*rows))
    t = pa.table({"event_id": list(cols[0]), "ts": [T0 + dt.timedelta(hours=h) for h in cols[1]],
                  "user_id": list(cols[2]), "event_type": list(cols[3]), "value": [0.0] * len(rows),
                  "props": ["{}"] * len(rows)}, schema=SCHEMA)
    pq.write_table(t, os.path.join(path, name))
    time.sleep(1.1)                       # file sources order by modification time


def test_stale_checkout_times_out(spark):
    root = shared_path(spark, "timeout-test")
    src = root + "/src"
    os.makedirs(src)
    # tool 1 and tool 2 check out on day 0 (view = check-out, click = check-in)
    _write(src, "part-0.parquet", [(1, 0, 1, "view"), (2, 0, 2, "view")])
    # day 5: tool 1 checks in, four days too late; tool 3 moves the watermark
    _write(src, "part-1.parquet", [(3, 120, 1, "click"), (4, 120, 3, "view")])
    # day 6: only tool 3: tool 2's open check-out (timeout day 1) is given up by its timer
    _write(src, "part-2.parquet", [(5, 144, 3, "click")])
    # day 6.5: tool 2 checks in, but its check-out is gone
    _write(src, "part-3.parquet", [(6, 156, 2, "click")])
    schema = spark.read.parquet(src).schema
    ev = shape_tool_events(streams.table_stream(spark, src, "events", 1, "part-*.parquet", schema))
    streams.run_to_end(streams.session_stream(ev, stale_after_ms=24 * 3600 * 1000), root + "/out", root + "/_ck")
    got = sorted((r.tool_code, r.checkout_seq) for r in spark.read.parquet(root + "/out").collect())
    assert got == [("TL-000001", 1), ("TL-000002", 2)]          # tool 3's check-in is in front of the watermark
    assert sorted(r.seq for r in streams.session_tail(spark, root + "/_ck").collect()) == [4, 5, 6]
    open_rows = [r.checkout_seq for r in spark.read.parquet(root + "/out").where("checkin_time is null").collect()]
    assert sorted(open_rows) == [1, 2]      # given up a day after their time, whatever arrives when
    # without the timeout nothing is given up, however many files a trigger takes
    for k, files in enumerate((1, None)):
        ev = shape_tool_events(streams.table_stream(spark, src, "events", files, "part-*.parquet", schema))
        streams.run_to_end(streams.session_stream(ev), f"{root}/out{k}", f"{root}/_ck{k}")
        rest = paired_sessions(streams.session_tail(spark, f"{root}/_ck{k}"))
        got = [(r.tool_code, r.checkout_seq) for part in (spark.read.parquet(f"{root}/out{k}"), rest) for r in part.collect()]
        assert sorted(got) == [("TL-000001", 1), ("TL-000002", 2), ("TL-000003", 4)]


def test_table_as_a_directory_of_files(spark):
    from fleet_rows import SF_SMALL
    root = shared_path(spark, "directory-test")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(5).write.parquet(f"{root}/events.parquet")
    for k, sf in enumerate((root, SF_SMALL)):
        streams.run_to_end(streams.table_stream(spark, sf, "events"), f"{root}/out{k}", f"{root}/_ck{k}")
    counts = [spark.read.parquet(f"{root}/out{k}").count() for k in (0, 1)]
    assert counts[0] == counts[1] == spark.read.parquet(f"{SF_SMALL}/events.parquet").count() > 0


def test_session_batches_equal_the_batch_pairing(spark):
    """Many files, one a trigger, a hot tool that is split, a restart, and a null tool."""
    from fleet_rows import SF_SMALL
    root = shared_path(spark, "session-batches")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 7).when(F.col("event_id") % 3 == 1, None)
                       .otherwise(F.col("user_id")))
    ev.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{root}/events.parquet")
    batch = [tuple(r) for r in paired_sessions(shape_tool_events(ev)).collect()]
    stored = [f"{root}/events.parquet/{n}" for n in sorted(os.listdir(f"{root}/events.parquet")) if n.startswith("part")]
    for k, rows_per_task in enumerate((50, 2_000_000)):
        src = f"{root}/src{k}"
        os.makedirs(src)
        for n, f in enumerate(stored):                       # files arrive one after the other, each in its own run
            os.link(f, f"{src}/part-{n}.parquet")
            s = streams.table_stream(spark, src, "events", None, "part-*.parquet", ev.schema)
            streams.session_batches(shape_tool_events(s), f"{root}/out{k}", f"{root}/_ck{k}", rows_per_task)
        got = streams.sessions_now(spark, f"{root}/out{k}")
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(batch, key=str) and batch


def test_ledger_stream_restart_does_not_double_count(spark):
    from fleet_rows import AS_OF, SF_SMALL
    from fleetkit.sources.testdata import shape_usage, tools
    root = shared_path(spark, "ledger-restart")
    run = lambda: streams.ledger_stream(
        spark, shape_usage(streams.table_stream(spark, SF_SMALL, "lineitem")), root + "/deltas", root + "/_ck")
    run()
    first = {r.tool_code: r.usage_hours for r in streams.ledger_snapshot(spark, tools(spark, SF_SMALL), root + "/deltas", AS_OF).collect()}
    run()                                   # restart from the same checkpoint: nothing is re-applied
    again = {r.tool_code: r.usage_hours for r in streams.ledger_snapshot(spark, tools(spark, SF_SMALL), root + "/deltas", AS_OF).collect()}
    assert first == again and sum(first.values()) > 0


def test_daily_window_drops_and_reports_late_rows(spark):
    """M3: a check-out more than the 1-day watermark behind the newest event
    time is dropped by Spark and reported from the query progress."""
    import pandas as pd
    root = shared_path(spark, "late-test")
    src = root + "/src"
    os.makedirs(src)
    li = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()),
                    ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_extendedprice", pa.float64()),
                    ("l_discount", pa.float64()), ("l_tax", pa.float64()), ("l_returnflag", pa.string()),
                    ("l_linestatus", pa.string()), ("l_shipdate", pa.timestamp("us"))])

    def write(name, days):
        n = len(days)
        t = pa.table({"l_orderkey": list(range(n)), "l_partkey": [1] * n, "l_suppkey": [1] * n,
                      "l_linenumber": pa.array([1] * n, pa.int32()), "l_quantity": [4.0] * n,
                      "l_extendedprice": [1.0] * n, "l_discount": [0.0] * n, "l_tax": [0.0] * n,
                      "l_returnflag": ["N"] * n, "l_linestatus": ["O"] * n,
                      "l_shipdate": [pd.Timestamp("2001-01-01") + pd.Timedelta(days=x) for x in days]}, schema=li)
        pq.write_table(t, os.path.join(src, name))
        time.sleep(1.1)

    from fleetkit.sources.testdata import shape_usage
    write("part-0.parquet", [10, 11, 12])
    write("part-1.parquet", [13])
    # late rows are judged against the previous batch's watermark, so the
    # late check-out (day 1 -> Jan 2) arrives in the third batch
    write("part-2.parquet", [1, 14])
    schema = spark.read.parquet(src).schema
    u = shape_usage(streams.table_stream(spark, src, "lineitem", 1, "part-*.parquet", schema))
    progress = streams.run_to_end(streams.daily_usage_stream(u), root + "/out", root + "/_ck")
    days = sorted(r.usage_date.day for r in spark.read.parquet(root + "/out").collect())
    assert 2 not in days and days[:3] == [11, 12, 13]      # the late day never appears
    assert streams.late_rows_dropped(progress) == 1


def test_recurring_trigger_equals_batch(spark):
    from collections import Counter

    from fleet_rows import SF_SMALL
    from fleetkit.operators.joins import scan_enrich
    from fleetkit.sources.testdata import load, part_count, shape_scans
    root = shared_path(spark, "recurring")
    f = load(spark, SF_SMALL)
    s = shape_scans(streams.table_stream(spark, SF_SMALL, "events"), part_count(spark, SF_SMALL))
    q = streams.start(streams.scan_stream(s, f.tools), root + "/out", root + "/_ck",
                      trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    cols = ["seq", "code", "found", "tool_name"]
    got = Counter(tuple(r) for r in spark.read.parquet(root + "/out").select(*cols).collect())
    want = Counter(tuple(r) for r in scan_enrich(f.scans, f.tools).select(*cols).collect())
    assert got == want and len(want) > 0


def _shuffled_events(n=240, seed=11):
    """Events of five tools over ten days, in files whose rows are up to 20 hours out of order, and two late rows."""
    import random
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(0, 240), rnd.randrange(1, 6), rnd.choice(["view", "click"])) for i in range(n)]
    rows = sorted(rows, key=lambda r: r[1] + rnd.randrange(0, 20))
    files = [rows[k:k + 40] for k in range(0, n, 40)]
    # behind the watermark whether that lags a batch or not
    late = [(900, 1, 2, "click"), (901, 2, 3, "view")]
    return rows, [*files[:-1], files[-1] + late]


def test_sessions_from_files_out_of_order(spark):
    rows, files = _shuffled_events()
    root = shared_path(spark, "out-of-order")
    src = root + "/src"
    os.makedirs(src)
    for k, f in enumerate(files):
        _write(src, f"part-{k}.parquet", f)
    schema = spark.read.parquet(src).schema
    want = sorted(tuple(r) for r in paired_sessions(shape_tool_events(
        spark.read.parquet(src).where("event_id < 900"))).collect())
    assert len(want) > 30

    def stream(files_a_trigger):
        return shape_tool_events(streams.table_stream(spark, src, "events", files_a_trigger, "part-*.parquet", schema))

    streams.session_batches(stream(1), root + "/b", root + "/_b")
    assert sorted(tuple(r) for r in streams.sessions_now(spark, root + "/b").collect()) == want
    assert sorted(r.seq for r in spark.read.parquet(root + "/b/late").collect()) == [900, 901]
    final = spark.read.parquet(root + "/b/out").count()
    assert 0 < final < len(want)                         # the last day is still in the tail

    progress = streams.run_to_end(streams.session_stream(stream(1)), root + "/s", root + "/_s")
    done = streams.sessions_as_wall_time(spark.read.parquet(root + "/s"))
    rest = paired_sessions(streams.session_tail(spark, root + "/_s"))
    assert sorted(tuple(r) for r in done.unionByName(rest).collect()) == want
    assert done.count() > 0 and streams.late_rows_dropped(progress) == 2


def test_session_batches_replay_and_restart(spark):
    """A run stopped between files, and a batch whose folders were already written, change nothing."""
    _, files = _shuffled_events(seed=12)
    root = shared_path(spark, "replay")
    one, two = root + "/one", root + "/two"
    for k, f in enumerate(files):
        for src in (one, two):
            os.makedirs(src, exist_ok=True)
        _write(one, f"part-{k}.parquet", f)
    schema = spark.read.parquet(one).schema
    ev = lambda src: shape_tool_events(streams.table_stream(spark, src, "events", 1, "part-*.parquet", schema))
    streams.session_batches(ev(one), root + "/a", root + "/_a")
    for k in range(len(files)):                          # each file in its own run
        os.link(f"{one}/part-{k}.parquet", f"{two}/part-{k}.parquet")
        if k == 2:                                       # what a killed batch 2 left behind
            for name in ("out", "tail", "late"):
                spark.read.parquet(f"{root}/b/{name}/batch=0").write.parquet(f"{root}/b/{name}/batch=2")
        streams.session_batches(ev(two), root + "/b", root + "/_b")
    got = [sorted((tuple(r) for r in streams.sessions_now(spark, f"{root}/{x}").collect()), key=str) for x in "ab"]
    assert got[0] == got[1] and got[0]


def test_compaction_bounds_reads_and_survives_a_kill(spark, monkeypatch):
    """Files arrive one a batch, three batches a snapshot; the run dies between snapshot and manifest, then in
    the middle of a snapshot.  Totals equal the batch results, and reads stay bounded."""
    from fleet_rows import AS_OF, SF_SMALL
    import pytest
    from fleetkit.operators import kpis, ledger
    from fleetkit.sources.testdata import shape_usage, tools
    from fleetkit.streaming import deltas
    root = shared_path(spark, "compaction")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    li.repartition(11).write.parquet(f"{root}/lineitem.parquet")
    stream = lambda: shape_usage(streams.table_stream(spark, root, "lineitem", 1))
    usage = shape_usage(li)

    # no manifest is published while the "machine" is down: every third batch dies after its snapshot
    real = deltas.file_system
    def dying(spark_, path):
        if "/_manifest/." in path:
            raise OSError("killed")
        return real(spark_, path)
    monkeypatch.setattr(deltas, "file_system", dying)
    with pytest.raises(Exception, match="killed"):
        streams.ledger_stream(spark, stream(), root + "/led", root + "/_l", compact_every=3)
    assert deltas.newest(spark, root + "/led") is None
    monkeypatch.setattr(deltas, "file_system", real)
    # and half a snapshot of other rows is left behind where the next one goes
    usage.limit(5).select("tool_code").write.mode("overwrite").parquet(root + "/led/_snapshot/upto=2")
    streams.ledger_stream(spark, stream(), root + "/led", root + "/_l", compact_every=3)

    hours = lambda df: {r.tool_code: round(r.usage_hours, 6) for r in df.collect()}
    want = hours(ledger.apply_usage(tools(spark, SF_SMALL), usage, AS_OF))
    read = lambda: hours(streams.ledger_snapshot(spark, tools(spark, SF_SMALL), root + "/led", AS_OF))
    assert read() == want and sum(want.values()) > 0
    assert deltas.newest(spark, root + "/led") == 8 and deltas.pending(spark, root + "/led") == [9, 10]
    folders = {os.path.dirname(f).rsplit("/led/", 1)[1] for f in deltas.read(spark, root + "/led", streams.LEDGER).inputFiles()}
    assert folders == {"_snapshot/upto=8", "batch=9", "batch=10"}
    assert deltas.vacuum(spark, root + "/led") and read() == want
    assert not os.path.exists(f"{root.removeprefix('file:')}/led/batch=0")

    streams.daily_upserts(stream(), root + "/day", root + "/_d", watermark="4000 days", compact_every=4)
    day = {r.usage_date: round(r.total_hours, 6) for r in streams.daily_latest(spark, root + "/day").collect()}
    assert day == {r.usage_date: round(r.total_hours, 6) for r in kpis.daily_usage(usage).collect()} and len(day) > 100
    assert deltas.newest(spark, root + "/day") is not None and len(deltas.pending(spark, root + "/day")) <= 5
