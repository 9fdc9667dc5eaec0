"""Tool events (B8/B9/F3), bucketed windows vs plain windows, invariance."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleet_rows import AS_OF, tool_row
from fleetkit import schemas
from fleetkit.operators import ledger, windows
from fleetkit.operators import sequence
from fleetkit.operators.sequence import GHOST, WHOLE, following, hot_key_plan, previous, seq_window, with_neighbours

T0 = dt.datetime(2024, 1, 1, 8, 0)


def _events(spark, rows):
    return spark.createDataFrame(
        [(seq, T0 + dt.timedelta(hours=h), code, user, kind) for seq, h, code, user, kind in rows],
        schemas.TOOL_EVENTS)


def _usage(spark, rows):
    return spark.createDataFrame(rows, schemas.USAGE)


def test_checkin_without_checkout_and_double_checkout(spark, make_tools):
    tools = make_tools([tool_row("A"), tool_row("B", status="in_use"), tool_row("C", status="in_use"),
                        tool_row("M", status="maintenance")])
    hist = _usage(spark, [(1, "B", "old_user", dt.datetime(2023, 12, 31, 9), None, None, "checkout", None, None)])
    ev = _events(spark, [
        (10, 0, "A", "u1", "checkin"),      # rejected: A is available
        (11, 1, "A", "u1", "checkout"),     # accepted
        (12, 2, "A", "u2", "checkout"),     # rejected: already in use
        (13, 30, "A", "u3", "checkin"),     # accepted (next day), pairs with u1's check-out
        (20, 0, "B", "u4", "checkin"),      # accepted: B in use, takes latest stored row
        (30, 0, "C", "u5", "checkin"),      # rejected: C has no usage row at all
        (31, 1, "C", "u5", "checkout"),     # rejected: still in use
        (40, 0, "M", "u6", "checkout"),     # rejected: in maintenance
        (50, 0, "X", "u7", "checkout"),     # unknown tool
    ])
    acc = ledger.accepted_events(tools, hist, ev)
    assert sorted(r.seq for r in acc.collect()) == [11, 13, 20]
    outs = {r.seq: r for r in ledger.checkout_rows(acc).collect()}
    assert list(outs) == [11]
    ins = {r.seq: r for r in ledger.checkin_rows(acc).collect()}
    assert ins[13].user_id == "u1" and ins[13].usage_duration == 29.0
    assert ins[20].user_id == "old_user" and ins[20].checkout_time == dt.datetime(2023, 12, 31, 9)
    snap = {r.tool_code: r.status for r in ledger.status_after_events(tools, acc, AS_OF).collect()}
    assert snap == {"A": "available", "B": "available", "C": "in_use", "M": "maintenance"}


def test_checkin_takes_the_history_as_of_its_time(spark, make_tools):
    tools = make_tools([tool_row("B", status="in_use"), tool_row("L", status="in_use"), tool_row("N", status="in_use")])
    before, later = dt.datetime(2023, 12, 31, 9), dt.datetime(2024, 2, 1, 9)
    hist = _usage(spark, [(1, "B", "first", before, None, None, "checkout", None, None),
                          (2, "B", "later", later, None, None, "checkout", None, None),
                          (3, "L", "later", later, None, None, "checkout", None, None),
                          (4, "N", "untimed", None, None, None, "checkout", None, None)])
    ev = _events(spark, [(20, 0, "B", "u", "checkin"), (21, 0, "L", "u", "checkin"), (22, 0, "N", "u", "checkin"),
                         (23, 0, None, "u", "checkin")])
    acc = ledger.accepted_events(tools, hist, ev)
    ins = {r.tool_code: r for r in ledger.checkin_rows(acc).collect()}
    assert (ins["B"].user_id, ins["B"].checkout_time, ins["B"].usage_duration) == ("first", before, 23.0)
    assert (ins["L"].user_id, ins["L"].checkout_time, ins["L"].usage_duration) == (None, None, None)
    assert (ins["N"].user_id, ins["N"].checkout_time, ins["N"].usage_duration) == ("untimed", None, None)
    assert sorted(ins) == ["B", "L", "N"]


def test_paired_sessions_across_days(spark):
    ev = _events(spark, [(1, 0, "A", "u1", "checkout"), (2, 40, "A", "u2", "checkin"),   # across 2 days
                         (3, 50, "A", "u3", "checkout"), (4, 51, "A", "u4", "checkout"),
                         (5, 52, "A", "u5", "checkin"), (6, 53, "A", "u6", "checkin")])
    got = [(r.checkout_seq, r.duration_hours) for r in windows.paired_sessions(ev).orderBy("checkout_seq").collect()]
    assert got == [(1, 40.0), (4, 1.0)]


def _random_events(spark, n=600, keys=4, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = "HOT" if rnd.random() < 0.5 else f"K{rnd.randrange(keys)}"
        rows.append((i, T0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20)), k, f"u{i % 5}",
                     rnd.choice(["checkout", "checkin"])))
    return spark.createDataFrame(rows, schemas.TOOL_EVENTS).withColumn("_day", F.to_date("ts"))


def test_bucketed_lag_lead_equal_plain_windows(spark):
    ev = _random_events(spark)
    w = Window.partitionBy("tool_code").orderBy("ts", "seq")
    plain = ev.select("seq", F.lag("event_kind").over(w).alias("p"), F.lead("ts").over(w).alias("n"))
    got_p = previous(ev, "tool_code", "_day", ["ts", "seq"], ["event_kind"]).select("seq", "prev_event_kind")
    got_n = following(ev, "tool_code", "_day", ["ts", "seq"], ["ts"]).select("seq", "next_ts")
    expect = {r.seq: (r.p, r.n) for r in plain.collect()}
    p = {r.seq: r.prev_event_kind for r in got_p.collect()}
    n = {r.seq: r.next_ts for r in got_n.collect()}
    assert {s: (p[s], n[s]) for s in expect} == expect


def test_bucketed_lookback_two(spark):
    ev = _random_events(spark, n=400).withColumn("v", (F.col("seq") % 13).cast("double"))
    w = Window.partitionBy("tool_code").orderBy("ts", "seq")
    expect = {r.seq: (r.l1, r.avg3) for r in ev.select(
        "seq", F.lag("v").over(w).alias("l1"), F.avg("v").over(w.rowsBetween(-2, 0)).alias("avg3")).collect()}
    nb = with_neighbours(ev, "tool_code", "_day", ["ts", "seq"], ["v"], lookback=2)
    ww = seq_window("tool_code", "_day", ["ts", "seq"])
    got = (nb.select("seq", GHOST, F.lag("v").over(ww).alias("l1"), F.avg("v").over(ww.rowsBetween(-2, 0)).alias("avg3"))
           .where(~F.col(GHOST)))
    assert {r.seq: (r.l1, r.avg3) for r in got.collect()} == expect


@pytest.mark.parametrize("parts", [1, 7])
def test_repartition_invariance(spark, parts, make_tools):
    tools = make_tools([tool_row("HOT"), tool_row("K0", status="in_use"), tool_row("K1"), tool_row("K2")])
    hist = _usage(spark, [(1, "K0", "h", dt.datetime(2023, 1, 1), None, None, "checkout", None, None)])
    ev = _random_events(spark).drop("_day")
    base = sorted(tuple(r) for r in ledger.checkin_rows(ledger.accepted_events(tools, hist, ev)).collect())
    rep = ev.repartition(parts)
    again = sorted(tuple(r) for r in ledger.checkin_rows(ledger.accepted_events(tools, hist, rep)).collect())
    assert base == again and len(base) > 0
    s1 = sorted(tuple(r) for r in windows.paired_sessions(ev).collect())
    s2 = sorted(tuple(r) for r in windows.paired_sessions(rep).collect())
    assert s1 == s2


def test_hot_key_path_equals_plain(spark, make_tools):
    """With a tiny rows-per-task the HOT key (half of all rows) is cut into
    buckets; results must not change."""
    ev = _random_events(spark).drop("_day")
    cut, hot = hot_key_plan(ev, "tool_code", ["ts", "seq"], "_b", rows_per_task=100)
    assert hot and {r.tool_code for r in cut.where(F.col("_b") != WHOLE).select("tool_code").distinct().collect()} == {"HOT"}
    tools = make_tools([tool_row("HOT"), tool_row("K0", status="in_use"), tool_row("K1"), tool_row("K2")])
    hist = _usage(spark, [(1, "K0", "h", dt.datetime(2023, 1, 1), None, None, "checkout", None, None)])
    plain = sorted(tuple(r) for r in ledger.checkin_rows(ledger.accepted_events(tools, hist, ev)).collect())
    acc = ledger.accepted_events(tools, hist, ev, rows_per_task=100)
    hot = sorted(tuple(r) for r in ledger.checkin_rows(acc).collect())
    assert plain == hot and len(plain) > 0
    s1 = sorted(tuple(r) for r in windows.paired_sessions(ev).collect())
    s2 = sorted(tuple(r) for r in windows.paired_sessions(ev, rows_per_task=100).collect())
    assert s1 == s2


def test_condition_trend_hot_path(spark):
    from fleet_rows import SF_SMALL
    from fleetkit.sources.testdata import load
    m = load(spark, SF_SMALL).maintenance
    a = sorted(tuple(r) for r in windows.condition_trend(m).collect())
    b = sorted(tuple(r) for r in windows.condition_trend(m, rows_per_task=1).collect())   # every tool hot
    assert a == b and len(a) > 0


def _burst(spark, n=2000, seed=5):
    """One tool's events within one second (one instant for half of them), and two quiet tools; one is null."""
    rnd = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(microseconds=0 if i % 2 else rnd.randrange(10 ** 6)), "HOT", f"u{i % 7}",
             rnd.choice(["checkout", "checkout", "checkin"])) for i in range(n)]
    rows += [(n + i, T0 + dt.timedelta(hours=i), c, "u", rnd.choice(["checkout", "checkin"]))
             for i in range(40) for c in ("K0", None)]
    return spark.createDataFrame(rows, schemas.TOOL_EVENTS)


@pytest.mark.parametrize("block", [sequence.BLOCK, 4])
def test_burst_is_cut_by_row_count(spark, make_tools, monkeypatch, block):
    """A burst of 20 x rows_per_task rows in one second: no window group is above rows_per_task."""
    monkeypatch.setattr(sequence, "BLOCK", block)            # 4: the two-level search has many blocks
    ev = _burst(spark)
    cut, hot = hot_key_plan(ev, "tool_code", ["ts", "seq"], "_b", rows_per_task=100)
    groups = {(r.tool_code, r._b): r["count"] for r in cut.groupBy("tool_code", "_b").count().collect()}
    assert hot and max(groups.values()) <= 100 and len(groups) >= 20 and groups["K0", WHOLE] == groups[None, WHOLE] == 40
    order = [r._b for r in cut.where("tool_code = 'HOT'").orderBy("ts", "seq").collect()]
    assert order == sorted(order)
    for status in ("available", "in_use"):
        tools = make_tools([tool_row("HOT", status=status), tool_row("K0", status="in_use")])
        hist = _usage(spark, [(1, "HOT", "old", dt.datetime(2023, 1, 1), None, None, "checkout", None, None)])
        one = sorted(tuple(r) for r in ledger.event_usage_rows(ledger.accepted_events(tools, hist, ev)).collect())
        two = sorted(tuple(r) for r in ledger.event_usage_rows(ledger.accepted_events(tools, hist, ev, rows_per_task=100)).collect())
        assert one == two and len(one) > 500
    one = sorted((tuple(r) for r in windows.paired_sessions(ev).collect()), key=str)
    assert one == sorted((tuple(r) for r in windows.paired_sessions(ev, rows_per_task=100).collect()), key=str)


def test_sampled_cuts_stay_below_the_bound(spark):
    """Above SAMPLES rows a cut only a hashed sample is sorted; groups still stay below rows_per_task."""
    ev = spark.range(60_000).select(F.col("id").alias("seq"), F.lit(T0).alias("ts"), F.lit("HOT").alias("tool_code"))
    cut, _ = hot_key_plan(ev, "tool_code", ["ts", "seq"], "_b", rows_per_task=4000)
    sizes = [r["count"] for r in cut.groupBy("_b").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 4000 and len(sizes) > 20


def _in_turn(tools, history, events):
    """Guards applied event by event, with the usage rows they write."""
    status = {t[0]: t[7] for t in tools}
    opened = {}
    out = []
    for seq, ts, code, user, kind in sorted((e for e in events if e[2] is not None), key=lambda e: (e[1], e[0])):
        if kind == "checkout" and status.get(code) == "available":
            status[code], opened[code] = "in_use", (user, ts)
            out.append((seq, code, user, ts, None, None, kind))
        elif kind == "checkin" and status.get(code) == "in_use":
            stored = [h for h in history if h[1] == code]
            if code not in opened and not stored:
                continue
            if code not in opened:
                fit = [h for h in stored if h[3] is None or h[3] <= ts]
                best = max(fit, key=lambda h: (h[3] is not None, h[3] or T0, -h[0]), default=None)
                opened[code] = (best[2], best[3]) if best else (None, None)
            who, when = opened[code]
            out.append((seq, code, who, when, ts, (ts - when).total_seconds() / 3600 if when else None, kind))
            status[code] = "available"
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_accepted_events_against_one_by_one(spark, make_tools, seed):
    rnd = random.Random(seed)
    codes = ["HOT", *(f"K{i}" for i in range(12))]
    tools = [tool_row(c, status=rnd.choice(["available", "in_use", "in_use", "maintenance"])) for c in codes]
    history = [(i, rnd.choice(codes), f"h{i}", rnd.choice([None, T0 + dt.timedelta(hours=rnd.randrange(-50, 200))]),
                None, None, "checkout", None, None) for i in range(12)]
    events = [(100 + i, T0 + dt.timedelta(minutes=rnd.randrange(600)), rnd.choice([*codes, "HOT", "HOT", "X", None]),
               f"u{i}", rnd.choice(["checkout", "checkin"])) for i in range(500)]
    df = spark.createDataFrame(events, schemas.TOOL_EVENTS)
    for rows_per_task in (2_000_000, 20):
        acc = ledger.accepted_events(make_tools(tools), _usage(spark, history), df, rows_per_task)
        got = sorted(tuple(r) for r in ledger.event_usage_rows(acc).collect())
        assert got == _in_turn(tools, history, events)
