"""Structured Streaming operators (M1-M4).

The reference only polls; here the same operators run on streams:

* M1 ``ledger_stream``: usage events -> ``foreachBatch`` writing each batch's
  per-tool usage delta (idempotent per batch id, compacted every so many batches);
  ``ledger_snapshot`` adds them to the tools table when read.
* M2 ``session_batches``: check-out / check-in pairing in event-time order, what may
  still change kept in a table between micro-batches; ``session_stream`` does it with per-tool state
  and event-time timers (``transformWithStateInPandas``; an optional timer lets stale
  check-outs go as open rows).  Both take events in any order within the watermark and
  report later ones.
* M3 ``daily_usage_stream``: 1-day tumbling windows with a 1-day watermark;
  append mode emits a day once the watermark passes its end, ``daily_upserts``
  writes every change of a day, so the newest days are there as well.  Spark drops a
  row that is behind the watermark of the *previous* micro-batch (the
  late-event threshold lags one batch); ``late_rows_dropped`` reports how
  many were dropped, from the query progress.
* M4 ``scan_stream``: stream-static left join of scans with the tools table.

Event times are TIMESTAMP_NTZ in the tables; watermarks need TIMESTAMP, so
the wall time is turned into the instant with the same epoch micros (UTC) —
independent of the session time zone — and back again on output.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fleetkit import constants as K
from fleetkit.operators.joins import scan_enrich
from fleetkit.operators.ledger import apply_usage_deltas, usage_deltas
from fleetkit.operators.windows import paired_sessions
from fleetkit.streaming import deltas

EPOCH_NTZ = "1970-01-01 00:00:00"


def event_instant(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c))


def instant_wall(c: Column | str) -> Column:
    """Inverse of ``event_instant`` (TIMESTAMP -> TIMESTAMP_NTZ, UTC wall)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None,
                 pattern: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A file stream over one table: the files of ``<table>.parquet`` if that is
    a directory (the layout a cluster writes), else the one file.  ``pattern``
    streams the matching files of ``sf_dir`` itself.  The schema is fixed up
    front, never inferred per batch; ``max_files`` limits a micro-batch's files
    (default: whatever is there)."""
    base = sf_dir.rstrip("/")
    path = f"{base}/{table}.parquet"
    if schema is None:
        schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern is not None:
        return reader.option("pathGlobFilter", pattern).parquet(base)
    fs, p = deltas.file_system(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(base)


def start(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
          trigger: dict | None = None):
    """Start a streaming query into a Parquet sink.  ``trigger`` is passed to
    ``DataStreamWriter.trigger`` — e.g. ``{"processingTime": "2 hours"}`` for
    a recurring job (the reference's polling cadences); default: process
    everything available, then stop."""
    return (df.writeStream.outputMode(mode).format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def run_to_end(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Run a streaming query over everything available, then stop; returns
    the progress reports of its micro-batches."""
    q = start(df, out_path, checkpoint, mode)
    q.awaitTermination()
    return list(q.recentProgress)


def late_rows_dropped(progress: list[dict]) -> int:
    """Rows discarded for arriving behind the watermark (Spark has no side
    output for them, so this count is how lateness is reported)."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0))
               for p in progress for op in p.get("stateOperators", []))


# ----------------------------------------------------------------- M3
def daily_usage_stream(usage: DataFrame, watermark: str = "1 day") -> DataFrame:
    u = (usage.where(F.col("checkout_time").isNotNull())
         .withColumn("_et", event_instant("checkout_time")).withWatermark("_et", watermark))
    agg = u.groupBy(F.window("_et", "1 day")).agg(F.sum("usage_duration").alias("_s"))
    day = F.date_from_unix_date(F.floor(F.unix_micros(F.col("window.start")) / F.lit(86_400_000_000)).cast("int"))
    return agg.select(day.alias("usage_date"), F.coalesce(F.col("_s"), F.lit(0.0)).alias("total_hours"))


DAILY = "usage_date date, total_hours double"


def _last_totals(days: DataFrame) -> DataFrame:
    """The last written total of every day, with the batch that wrote it."""
    return days.groupBy("usage_date").agg(F.max_by("total_hours", "batch").alias("total_hours"), F.max("batch").alias("batch"))


def daily_upserts(usage: DataFrame, root: str, checkpoint: str, watermark: str = "1 day",
                  compact_every: int = deltas.EVERY) -> None:
    """Run M3 over what is available, writing the days each micro-batch changed
    to ``<root>/batch=<id>`` (a replayed batch overwrites its own); every ``compact_every`` batches are folded
    into one snapshot (``streaming.deltas``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        deltas.write(batch, root, batch_id)
        deltas.compact(batch.sparkSession, root, batch_id, DAILY, _last_totals, compact_every)

    (daily_usage_stream(usage, watermark).writeStream.outputMode("update").foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def daily_latest(spark: SparkSession, root: str) -> DataFrame:
    """The last written total of every day."""
    return _last_totals(deltas.read(spark, root, DAILY)).drop("batch")


# ----------------------------------------------------------------- M4
def scan_stream(scans: DataFrame, tools: DataFrame) -> DataFrame:
    return scan_enrich(scans, tools)


# ----------------------------------------------------------------- M2
EVENT_COLUMNS = ["seq", "ts", "tool_code", "user_id", "event_kind"]
SESSION_MICROS = ("tool_code string, user_id string, checkout_seq long, checkout_us long, checkin_us long")


class _Pairing(StatefulProcessor):
    """Pairs one tool's events in event-time order.

    List state ``pending`` holds the events in front of the watermark, value state ``open`` the check-out that
    is the newest event behind it.  An event-time timer wakes the tool when the watermark
    reaches its earliest pending event: all events up to there are final, as Spark drops whatever arrives
    behind the watermark.  With ``stale_after_ms`` a second timer gives an open check-out up."""

    def __init__(self, stale_after_ms: int | None):
        self.stale_us = None if stale_after_ms is None else stale_after_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, seq long, user_id string, event_kind string")
        self.open = handle.getValueState("open", "us long, seq long, user_id string")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))                # the first millisecond at or after it

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(us), int(seq), user, kind) for pdf in rows
               for us, seq, user, kind in zip(pdf["us"], pdf["seq"], pdf["user_id"], pdf["event_kind"])]
        if new:
            self.pending.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        final, rest = [e for e in events if e[0] <= mark], [e for e in events if e[0] > mark]
        out = []
        current = tuple(self.open.get()) if self.open.exists() else None

        def give_up(before: int) -> bool:
            return self.stale_us is not None and current is not None and current[0] + self.stale_us <= before

        for us, seq, user, kind in final:
            if give_up(us):
                out.append((key[0], current[2], current[1], current[0], None))
                current = None
            if kind == K.CHECKIN and current is not None:
                out.append((key[0], current[2], current[1], current[0], us))
            current = (us, seq, user) if kind == K.CHECKOUT else None
        if give_up(mark):
            out.append((key[0], current[2], current[1], current[0], None))
            current = None
        if rest:
            self.pending.put(rest)
            self._wake(rest[0][0])
        else:
            self.pending.clear()
        if current is None:
            self.open.clear()
        else:
            self.open.update(current)
            if self.stale_us is not None:
                self._wake(current[0] + self.stale_us)
        if out:
            yield pd.DataFrame(out, columns=["tool_code", "user_id", "checkout_seq", "checkout_us", "checkin_us"]).astype(
                {"checkin_us": "Int64"})

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, watermark: str = "1 day", stale_after_ms: int | None = None) -> DataFrame:
    """M2 over a tool-event stream (seq, ts, tool_code, user_id, event_kind) with per-tool state and timers
    (``transformWithStateInPandas``).

    A session leaves once the watermark has passed its check-in, so events may arrive in any order within
    the watermark; later ones are dropped by Spark (``late_rows_dropped``).  An open check-out waits as
    long as it takes; with ``stale_after_ms`` it is given up that long after its time (by the watermark) and
    leaves as a row without a check-in.  What is still pending is in the state: ``session_tail``."""
    from fleetkit.session import ship_package
    ship_package(events.sparkSession)
    ev = (events.select(*EVENT_COLUMNS).where(F.col("event_kind").isin(K.CHECKOUT, K.CHECKIN))
          .withColumn("ts", event_instant("ts")).withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts")))
    out = ev.groupBy("tool_code").transformWithStateInPandas(
        statefulProcessor=_Pairing(stale_after_ms), outputStructType=SESSION_MICROS, outputMode="Append", timeMode="EventTime")
    at = lambda c: F.timestamp_micros(F.col(c))
    return out.select("tool_code", "user_id", "checkout_seq", at("checkout_us").alias("checkout_time"),
                      at("checkin_us").alias("checkin_time"),
                      ((F.col("checkin_us") - F.col("checkout_us")) / F.lit(3_600_000_000.0)).alias("duration_hours"))


def session_tail(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The events that a stopped ``session_stream`` still holds (open check-outs and events in front of
    the watermark), read from its state: paired with ``windows.paired_sessions`` they complete the sessions written."""
    def state(name: str) -> DataFrame:
        return (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
                .option("flattenCollectionTypes", True).load())
    row = lambda c, kind: [F.col(f"{c}.seq").alias("seq"), F.timestamp_add(
        "MICROSECOND", F.col(f"{c}.us"), F.lit(EPOCH_NTZ).cast("timestamp_ntz")).alias("ts"),
        F.col("key.tool_code").alias("tool_code"), F.col(f"{c}.user_id").alias("user_id"), kind.alias("event_kind")]
    return state("pending").select(*row("list_element", F.col("list_element.event_kind"))).unionByName(
        state("open").select(*row("value", F.lit(K.CHECKOUT))))


def session_batches(events: DataFrame, root: str, checkpoint: str, rows_per_task: int = 2_000_000,
                    trigger: dict | None = None, delay: dt.timedelta = dt.timedelta(days=1)) -> None:
    """M2 with the batch pairing, in event-time order: each micro-batch is paired by
    ``windows.paired_sessions`` together with the events kept before it, so a hot tool is split like in a batch job.

    The mark is the newest event time seen, less ``delay``.  A session is final once its check-in is at or
    before the mark; it goes to ``<root>/out/batch=<id>``.  Kept (``<root>/tail/batch=<id>``) are the events
    behind which others may still arrive (after the mark) and each tool's newest event at or before it, if that is
    a check-out.  Rows that arrive at or before the mark of the batch before, or without a time, are late: they go to
    ``<root>/late/batch=<id>`` and are not paired.  A replayed batch reads the same tail and mark and
    overwrites its own folders.  ``sessions_now`` adds the pairs in the last tail."""
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        at = lambda name, k: f"{root}/{name}/batch={k}"
        fs, p = deltas.file_system(spark, at("mark", batch_id - 1))
        before = spark.read.parquet(at("mark", batch_id - 1)).first()["mark"] if fs.exists(p) else None
        rows = batch.select(*EVENT_COLUMNS)
        late = F.col("ts").isNull() if before is None else (
            F.col("ts").isNull() | (F.col("ts") <= F.lit(before).cast("timestamp_ntz")))
        rows.where(late).write.mode("overwrite").parquet(at("late", batch_id))
        newest = rows.agg(F.max("ts")).first()[0]
        marks = [m for m in (before, None if newest is None else newest - delay) if m is not None]
        mark = max(marks, default=None)
        spark.createDataFrame([(mark,)], "mark timestamp_ntz").write.mode("overwrite").parquet(at("mark", batch_id))
        rows = rows.where(~late)
        if fs.exists(deltas.file_system(spark, at("tail", batch_id - 1))[1]):
            rows = rows.unionByName(spark.read.parquet(at("tail", batch_id - 1)))
        rows = rows.persist()                            # a cache only: lost blocks are read again
        final = F.lit(mark).cast("timestamp_ntz")
        paired_sessions(rows, rows_per_task).where(F.col("checkin_time") <= final).write.mode("overwrite").parquet(
            at("out", batch_id))
        last = rows.where(F.col("ts") <= final).groupBy("tool_code").agg(
            F.max_by(F.struct("seq", "ts", "user_id", "event_kind"), F.struct("ts", "seq")).alias("r"))
        opened = last.where(F.col("r.event_kind") == K.CHECKOUT).select("r.seq", "r.ts", "tool_code", "r.user_id", "r.event_kind")
        (rows.where(F.coalesce(F.col("ts") > final, F.lit(True))).unionByName(opened)
         .write.mode("overwrite").parquet(at("tail", batch_id)))
        rows.unpersist()

    q = (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    if trigger is None:
        q.awaitTermination()


def sessions_now(spark: SparkSession, root: str, rows_per_task: int = 2_000_000) -> DataFrame:
    """All sessions of a ``session_batches`` run so far: the final ones and the pairs among the kept events."""
    done = spark.read.parquet(f"{root}/out").drop("batch")
    newest = spark.read.parquet(f"{root}/mark").agg(F.max("batch")).first()[0]
    return done.unionByName(paired_sessions(spark.read.parquet(f"{root}/tail/batch={newest}"), rows_per_task))


def sessions_as_wall_time(df: DataFrame) -> DataFrame:
    return df.select("tool_code", "user_id", "checkout_seq", instant_wall("checkout_time").alias("checkout_time"),
                     instant_wall("checkin_time").alias("checkin_time"), "duration_hours")


# ----------------------------------------------------------------- M1
LEDGER = "tool_code string, added_hours double"


def _sums(rows: DataFrame) -> DataFrame:
    """Per-tool sums of several batches' deltas."""
    return rows.groupBy("tool_code").agg(F.sum("added_hours").alias("added_hours"), F.max("batch").alias("batch"))


def ledger_stream(spark: SparkSession, usage: DataFrame, root: str, checkpoint: str,
                  trigger: dict | None = None, compact_every: int = deltas.EVERY) -> None:
    """M1: every micro-batch of usage rows becomes its per-tool delta (B4's
    per-tool sums), written to ``<root>/batch=<id>``.  A replayed batch
    overwrites its own partition with the same content, so restarts after a
    failure never double-count, and no micro-batch rewrites the tools.  Every
    ``compact_every`` batches are folded into one snapshot (``streaming.deltas``)."""

    def write_delta(batch: DataFrame, batch_id: int) -> None:
        deltas.write(usage_deltas(batch), root, batch_id)
        deltas.compact(spark, root, batch_id, LEDGER, _sums, compact_every)

    q = (usage.writeStream.foreachBatch(write_delta).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    if trigger is None:
        q.awaitTermination()


def ledger_snapshot(spark: SparkSession, tools: DataFrame, root: str, as_of) -> DataFrame:
    """The tools snapshot after all committed stream batches (reads one compacted snapshot and the batches since)."""
    return apply_usage_deltas(tools, deltas.read(spark, root, LEDGER).select("tool_code", "added_hours"), as_of)
