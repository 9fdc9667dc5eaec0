"""Skew-safe per-key sequence windows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to
one task; when one tool holds a third of all events that task holds a third
of the data.  Here the window is partitioned by ``(key, bucket)`` and the
few rows a frame needs from *neighbouring* buckets are added as "ghost" rows:

* lookback n: the last n rows before each bucket,
* lookahead n: the first n rows after each bucket.

The ghosts are found from a per-(key, bucket) summary (at most n rows per
bucket, computed with partial aggregation for n = 1), ordered by a window over
the summary partitioned by key only, whose size is the number of buckets of a
key.  Callers apply their window over ``(key, bucket)`` ordered by the same
order columns and then drop the ghosts with ``where(~F.col(GHOST))``.

The order columns must make rows unique within a key (add ``seq``).

Which bucket?  ``hot_key_plan`` cuts hot keys (more than
T = max(rows_per_task, N / max_hot) rows) at quantiles of their order columns,
so a bucket holds about T / 2 rows however they lie in time: a burst within one
second is split like a quiet year.  All other keys are one bucket; when there
is no hot key at all it tells the caller to skip the ghost machinery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetkit.session import ensure_checkpoint_dir

GHOST = "_ghost"


def _edge_rows(df: DataFrame, key: str, bucket: str, order_cols: Sequence[str],
               payload: Sequence[str], n: int, last: bool) -> DataFrame:
    """At most ``n`` rows per (key, bucket): the last (or first) ones."""
    cols = list(dict.fromkeys([*payload, *order_cols]))
    if n == 1:
        # Partial + final aggregation: no task ever holds a whole bucket.
        pick = F.max_by if last else F.min_by
        agg = pick(F.struct(*cols), F.struct(*order_cols)).alias("_r")
        return df.groupBy(key, bucket).agg(agg).select(key, bucket, "_r.*")
    ordering = [F.col(c).desc() if last else F.col(c).asc() for c in order_cols]
    w = Window.partitionBy(key, bucket).orderBy(*ordering)
    return (df.select(key, bucket, *cols).withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= n))


def with_neighbours(df: DataFrame, key: str, bucket: str, order_cols: Sequence[str],
                    payload: Sequence[str], lookback: int = 0, lookahead: int = 0,
                    ghosts: bool = True) -> DataFrame:
    """Rows of ``df`` (``GHOST`` = false) plus ghost rows (``GHOST`` = true)
    carrying ``payload`` + ``order_cols`` of neighbouring buckets, labelled
    with the bucket they serve.  ``ghosts=False`` (every key in one bucket,
    see ``hot_key_plan``) skips the ghost machinery."""
    cols = list(dict.fromkeys([*payload, *order_cols]))
    real = df.select(key, bucket, *cols).withColumn(GHOST, F.lit(False))
    out = real
    if not ghosts:
        return out
    for n, last in ((lookback, True), (lookahead, False)):
        if n <= 0:
            continue
        edges = _edge_rows(df, key, bucket, order_cols, cols, n, last)
        if n == 1:
            # one edge row per bucket: the ghost of a bucket is the edge of the
            # previous (next) non-empty bucket — a lag (lead) over the key's buckets
            bw = Window.partitionBy(key).orderBy(F.col(bucket).asc())
            nb = (F.lag if last else F.lead)(F.struct(*cols)).over(bw)
            ghost_rows = (edges.select(key, bucket, nb.alias("_g")).where(F.col("_g").isNotNull())
                          .select(key, bucket, *[F.col(f"_g.{c}").alias(c) for c in cols])
                          .withColumn(GHOST, F.lit(True)))
            out = out.unionByName(ghost_rows)
            continue
        # each bucket's first edge row also emits the bucket's marker (_m = 1)
        # through a generator, so the edge table is referenced once
        m = F.explode(F.when(F.col("_rn") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        combined = (edges.select("*", m.alias("_m"))
                    .select(key, bucket, "_m",
                            F.when(F.col("_m") == 0, F.struct(*cols)).alias("_row"),
                            *[F.when(F.col("_m") == 0, F.col(c)).alias(c) for c in order_cols]))
        if last:
            # marker first inside its bucket; look at the 2n rows before it
            w = (Window.partitionBy(key)
                 .orderBy(F.col(bucket).asc(), F.col("_m").desc(), *[F.col(c).asc() for c in order_cols])
                 .rowsBetween(-2 * n, -1))
            got = F.collect_list("_row").over(w)
            # the last n entries; an array shorter than n is kept whole
            carried = F.when(F.size(got) <= n, got).otherwise(F.slice(got, -n, n))
        else:
            # marker last inside its bucket; look at the 2n rows after it
            w = (Window.partitionBy(key)
                 .orderBy(F.col(bucket).asc(), F.col("_m").asc(), *[F.col(c).asc() for c in order_cols])
                 .rowsBetween(1, 2 * n))
            carried = F.slice(F.collect_list("_row").over(w), 1, n)
        ghost_rows = (combined.withColumn("_carry", carried).where(F.col("_m") == 1)
                  .select(key, bucket, F.explode("_carry").alias("_g"))
                  .select(key, bucket, *[F.col(f"_g.{c}").alias(c) for c in cols])
                  .withColumn(GHOST, F.lit(True)))
        out = out.unionByName(ghost_rows)
    return out


def seq_window(key: str, bucket: str, order_cols: Sequence[str]) -> Window:
    return Window.partitionBy(key, bucket).orderBy(*[F.col(c).asc() for c in order_cols])


def previous(df: DataFrame, key: str, bucket: str, order_cols: Sequence[str],
             cols: Sequence[str], prefix: str = "prev_", ghosts: bool = True) -> DataFrame:
    """Adds ``prefix + c`` = value of ``c`` in the previous row of the key
    (lag 1 across bucket borders): one full shuffle by (key, bucket); the
    ghost rows come from a partially aggregated per-bucket summary."""
    cols = list(cols)
    keep = [c for c in df.columns if c not in (key, bucket)]
    nb = with_neighbours(df, key, bucket, order_cols, keep, lookback=1, ghosts=ghosts)
    w = seq_window(key, bucket, order_cols)
    out = nb.withColumn("_p", F.lag(F.struct(*cols)).over(w)).where(~F.col(GHOST))
    return out.select(*df.columns, *[F.col(f"_p.{c}").alias(prefix + c) for c in cols])


def following(df: DataFrame, key: str, bucket: str, order_cols: Sequence[str],
              cols: Sequence[str], prefix: str = "next_", ghosts: bool = True) -> DataFrame:
    """Adds ``prefix + c`` = value of ``c`` in the next row of the key
    (lead 1 across bucket borders)."""
    cols = list(cols)
    keep = [c for c in df.columns if c not in (key, bucket)]
    nb = with_neighbours(df, key, bucket, order_cols, keep, lookahead=1, ghosts=ghosts)
    w = seq_window(key, bucket, order_cols)
    out = nb.withColumn("_n", F.lead(F.struct(*cols)).over(w)).where(~F.col(GHOST))
    return out.select(*df.columns, *[F.col(f"_n.{c}").alias(prefix + c) for c in cols])


#: Sampled rows per cut, and cuts per block of the two-level search.
SAMPLES, BLOCK = 200, 256
#: Bucket of a key that is not hot; the buckets of hot keys count from 0.
WHOLE = -1


def _cuts(df: DataFrame, hot: DataFrame, key: str, order_cols: Sequence[str], size: int) -> DataFrame:
    """Quantile cuts of the hot keys: (_key, _i, _o), the _i-th cut (from 1) at order value _o.

    Every m-th row (by a hash of key and order columns, so any task agrees) stands for m
    rows; a cut follows every ``size`` rows.  With few rows a cut m is 1 and the cuts are exact."""
    m = max(1, size // SAMPLES)
    o = F.struct(*order_cols).alias("_o")
    rows = (df.select(F.col(key).alias("_key"), o, F.pmod(F.xxhash64(key, *order_cols), F.lit(m)).alias("_m"))
            .join(F.broadcast(hot), F.col("_key").eqNullSafe(F.col("_hot_key"))).where(F.col("_m") == 0))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_o"))
    per = max(1, size // m)
    return (rows.select("_key", "_o", rank.alias("_r")).where(F.col("_r") % per == 0)
            .select("_key", F.floor(F.col("_r") / per).cast("int").alias("_i"), "_o"))


def _at_most(cuts: Column, value: Column, steps: int) -> Column:
    """How many of the sorted ``cuts`` are <= ``value`` (binary search; 0 without cuts)."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), lambda acc, step: F.when(
        F.get(cuts, acc + step - 1) <= value, acc + step).otherwise(acc))


def hot_key_plan(df: DataFrame, key: str, order_cols: Sequence[str], bucket: str = "_bucket",
                 rows_per_task: int = 2_000_000, max_hot: int = 100_000) -> tuple[DataFrame, bool]:
    """Adds ``bucket``: the number of the key's cuts at or before a row for hot keys, ``WHOLE`` for every other key;
    also returns whether any key is hot (when none is, callers skip the ghost rows entirely).

    A key is hot when it has more than ``T = max(rows_per_task, N / max_hot)``
    rows, so there are at most ``max_hot`` hot keys and, at T / 2 rows a cut, about
    2 x max_hot cuts: both tables have a proven size bound and are broadcast.  N and
    the number of large keys come from one aggregate (driver-side numbers).  A row
    looks its bucket up in two steps (block of cuts, cut), so it never
    meets more than a few hundred cuts.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    # one job: N and whether any key is above the floor of the threshold
    st = counts.agg(F.sum("_n").alias("n"), F.count_if(F.col("_n") > rows_per_task).alias("over")).first()
    if not st["over"]:
        return df.withColumn(bucket, F.lit(WHOLE)), False
    threshold = max(rows_per_task, -(-int(st["n"]) // max_hot))
    # <= max_hot keys by construction; null-safe, as a null key may be hot, too
    hot = counts.where(F.col("_n") > threshold).select(F.col(key).alias("_hot_key"))
    if hot.isEmpty():
        return df.withColumn(bucket, F.lit(WHOLE)), False
    ensure_checkpoint_dir(df.sparkSession)
    cuts = _cuts(df, hot, key, order_cols, max(1, threshold // 2)).withColumn(
        "_b", F.floor((F.col("_i") - 1) / BLOCK).cast("int")).checkpoint(eager=True)
    listed = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("_o"))))
    starts = cuts.groupBy("_key").agg(listed((F.col("_i") % BLOCK == 1) & (F.col("_i") > 1)).alias("_starts"))
    blocks = cuts.groupBy(F.col("_key").alias("_key_b"), "_b").agg(listed(F.lit(True)).alias("_in"))
    value = F.struct(*order_cols)
    block = (df.join(F.broadcast(starts), F.col(key).eqNullSafe(F.col("_key")), "left")
             .withColumn("_g", _at_most(F.col("_starts"), value, (2 * max_hot // BLOCK).bit_length())))
    found = block.join(F.broadcast(blocks), F.col(key).eqNullSafe(F.col("_key_b")) & (F.col("_g") == F.col("_b")), "left")
    # (within a block the search ends at BLOCK cuts)
    at = F.col("_g") * BLOCK + _at_most(F.col("_in"), value, BLOCK.bit_length())
    return found.select(*df.columns, F.when(F.col("_starts").isNull(), F.lit(WHOLE)).otherwise(at).alias(bucket)), True
