"""Skew scenario: one tool receives a third of all tool events.

Builds a skewed copy of the tool events from $BENCH_SF_DIR (every event with
event_id % 3 == 0 is re-assigned to tool TL-000000), then runs the
check-out/check-in acceptance and session pairing twice — with the default
threshold (the hot tool is one window, like a plain per-key window) and with
a small ``rows_per_task`` (the hot tool is cut into buckets of about half as many rows) —
checks that both give the same rows and reports the largest window group
(rows that one task sorts together) and the wall time of each.

    BENCH_SF_DIR=/root/testdata/sf0.1 python scripts/skew_check.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from pyspark.sql import functions as F

    from fleetkit.operators import ledger, windows
    from fleetkit.operators.sequence import hot_key_plan
    from fleetkit.session import local_session
    from fleetkit.sources.testdata import load, read, shape_tool_events

    spark = local_session(cores=4)
    f = load(spark, sf)
    e = read(spark, sf, "events")
    skewed = shape_tool_events(e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0))
                                              .otherwise(F.col("user_id"))))
    skewed = skewed.checkpoint(eager=True) if spark.sparkContext.getCheckpointDir() else skewed
    n = skewed.count()
    hot_rows = skewed.where(F.col("tool_code") == "TL-000000").count()
    out = {"events": n, "hot_tool_events": hot_rows}
    results = {}
    for label, rpt in (("single_window", 10**12), ("hot_key_split", max(1000, n // 100))):
        bucketed, hot = hot_key_plan(skewed, "tool_code", ["ts", "seq"], "_b", rows_per_task=rpt)
        biggest = bucketed.groupBy("tool_code", "_b").count().agg(F.max("count")).first()[0]
        t0 = time.perf_counter()
        acc = ledger.accepted_events(f.tools, f.usage, skewed, rows_per_task=rpt)
        ses = windows.paired_sessions(skewed, rows_per_task=rpt)
        a = sorted(tuple(r) for r in acc.collect())
        s = sorted(tuple(r) for r in ses.collect())
        out[label] = {"rows_per_task": rpt, "hot_path": hot, "largest_window_group": biggest,
                      "seconds": round(time.perf_counter() - t0, 2), "accepted": len(a), "sessions": len(s)}
        results[label] = (a, s)
    out["identical"] = results["single_window"] == results["hot_key_split"]
    print(json.dumps(out))


if __name__ == "__main__":
    main()
