"""Label encoding (J2) and standardisation.

J2 is a dictionary table, not MLlib's ``StringIndexer`` (whose 'keep' mode
gives k, not -1, for unseen values): sorted distinct text values get codes
0..k-1 per column, missing values are the text 'None', unseen values -1.
The dictionary is as large as the number of distinct values; it is ranked
without ever sorting a whole column in one task.  Applying it is a join: a column
of up to ``BROADCAST_BYTES`` of values is broadcast, so the rows stay where they
are (dealt by label, three statuses would put all rows into three tasks, and AQE
does not broadcast a side whose partitions are mostly empty); a larger one is
an ordinary join.

J3 uses the *population* standard deviation with sigma = 0 treated as 1
(MLlib's StandardScaler uses the sample sigma).  Fitting is one aggregate
pass; the fitted means/sigmas are model parameters (2 numbers per feature)
applied as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetkit import constants as K


#: Size of a column's dictionary up to which its join broadcasts it (64 bytes a row besides the text).
BROADCAST_BYTES = 8 * 2**20


def _text(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(K.NULL_LABEL))


def fit_label_dictionary(df: DataFrame, cols: Sequence[str] = K.CATEGORICAL_COLUMNS,
                         partitions: int | None = None) -> DataFrame:
    """(column, value, code) with code = rank of value among the sorted
    distinct values of its column.

    The pairs are range-partitioned by (column, value), ranked inside each
    range partition, and shifted by the number of values of the same column in
    earlier partitions — taken from a per-partition count table (partitions x
    columns rows, broadcast).  The result is written once (``checkpoint``):
    every column's lookup reads it."""
    from fleetkit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    vals = (df.select(*[_text(c).alias(c) for c in cols])
            .unpivot([], list(cols), "column", "value").distinct())
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partition ids are materialised once (a dictionary-sized checkpoint),
    # so both branches below see the same range bounds
    ranged = (vals.repartitionByRange(n, "column", "value").withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    local = ranged.withColumn("_local", F.row_number().over(
        Window.partitionBy("_pid", "column").orderBy("value")) - 1)
    counts = ranged.groupBy("_pid", "column").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "column", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), ["_pid", "column"])     # bounded: partitions x columns
            .select("column", "value", (F.col("_local") + F.col("_off")).cast("int").alias("code"))
            .checkpoint(eager=True))


def encode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str] = K.CATEGORICAL_COLUMNS) -> DataFrame:
    """Adds ``<col>_encoded`` (unseen -> -1)."""
    sizes = dict(dictionary.groupBy("column").agg(F.sum(F.octet_length("value") + 64)).collect())    # a row per column
    out = df
    for c in cols:
        d = (dictionary.where(F.col("column") == c)
             .select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_code_{c}")))
        if sizes.get(c, 0) <= BROADCAST_BYTES:
            d = F.broadcast(d)
        out = (out.join(d, _text(c) == F.col(f"_v_{c}"), "left")
               .withColumn(f"{c}_encoded", F.coalesce(F.col(f"_code_{c}"), F.lit(-1)))
               .drop(f"_v_{c}", f"_code_{c}"))
    return out


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Means and population sigmas (sigma 0 -> 1) of ``cols`` in one pass."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m = row[f"m_{i}"] or 0.0
        s = row[f"s_{i}"]
        out[c] = (float(m), 1.0 if (s is None or s == 0.0) else float(s))
    return out


def scale(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """(x - mean) / sigma for every fitted column (null filled with 0 first)."""
    exprs = {c + suffix: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
             for c, (m, s) in params.items()}
    return df.withColumns(exprs)
