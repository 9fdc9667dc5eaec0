"""Command line: run a registered query on a directory of tables.

    python -m fleetkit list
    python -m fleetkit run due_7d --tables /root/testdata/sf0.01 [--show 20]
    python -m fleetkit run features --tables DIR --out PATH [--format parquet|csv|json]
    python -m fleetkit explain checkin_apply --tables DIR

On a cluster, submit it with ``spark-submit`` so the session's settings
(master, spark.checkpoint.dir, ...) come from the cluster; locally a
``local[*]`` session is started.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m fleetkit")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered query keys")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("key")
        p.add_argument("--tables", required=True, help="directory with <table>.parquet files")
        if name == "run":
            p.add_argument("--out", help="write the result here instead of showing it")
            p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
            p.add_argument("--show", type=int, default=20)
    a = ap.parse_args(argv)

    from fleetkit.plans.registry import oracle_queries, spark_queries
    queries = spark_queries()
    if a.cmd == "list":
        oracle = oracle_queries()
        for k in sorted(queries):
            print(f"{k:24s} {'oracle' if k in oracle else 'rows-only'}")
        return 0
    if a.key not in queries:
        print(f"unknown key {a.key!r}; see `python -m fleetkit list`", file=sys.stderr)
        return 2

    from pyspark.sql import SparkSession

    from fleetkit.session import SCALE_CONF, ensure_checkpoint_dir, local_session
    active = SparkSession.getActiveSession()
    if active is None and "spark.master" not in SparkSession.builder._options:
        spark = local_session()
    else:
        spark = SparkSession.builder.getOrCreate()
        for k, v in SCALE_CONF.items():
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        ensure_checkpoint_dir(spark)
    df = queries[a.key](spark, a.tables)
    if a.cmd == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").format(a.format).options(**({"header": "true"} if a.format == "csv" else {})) \
          .save(a.out)
        print(f"wrote {a.key} to {a.out}")
    else:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
