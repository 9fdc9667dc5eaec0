"""File sources and sinks: CSV intake (A6, A7), CSV export (A8), JSON
export (A9) and the prediction store (B6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetkit import schemas
from fleetkit.session import ensure_checkpoint_dir

CORRUPT = "_corrupt_record"


def read_intake_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.INTAKE_CSV,
                    header: bool = True) -> DataFrame:
    """CSV with an explicit schema (no inference pass over the
    data).  Malformed lines are kept with their text in ``_corrupt_record``
    instead of failing the job.  Empty cells read as null, as in a pandas
    CSV reader, so an empty required field is a missing one."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    # all columns are parsed whatever a query asks for: else a line would be malformed in one branch only
    return (spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnPruning", False)
            .option("columnNameOfCorruptRecord", CORRUPT).schema(full).csv(path))


def with_malformed(read: DataFrame, schema: T.StructType = schemas.INTAKE_CSV) -> DataFrame:
    """Adds ``malformed`` to rows of ``read_intake_csv``: null for a sound line, else what is wrong with it.

    ``too_few_fields`` or ``too_many_fields``, or ``bad_value:`` with the columns whose text does not parse.
    The file is parsed once, with all columns (a reader that is asked for some of them does not notice what is
    wrong in the others), and the rows are kept in the shared checkpoint folder.
    The line's text stays in ``_corrupt_record``, so a reject can be shown, mended and sent again;
    ``ledger.classify_intake`` counts it as an error and never lets it stand for its code."""
    names = schema.names
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_surplus"]])
    # a mark behind the line tells how many cells it has
    mark = "\u0001"
    cells = F.from_csv(F.concat(F.col(CORRUPT), F.lit("," + mark)), text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                       {"columnPruning": "false"})
    rows = read.withColumn("_cells", cells)
    cell = lambda n: F.col("_cells")[n]
    # a cell with text whose typed column is null
    bad = F.array_compact(F.array(*[F.when((cell(n) != "") & F.col(n).isNull(), F.lit(n)) for n in names]))
    reason = (F.when(cell("_surplus") == mark, F.concat(F.lit("bad_value:"), F.array_join(bad, ",")))
              .when(cell("_surplus").isNull(), "too_few_fields").otherwise("too_many_fields"))
    ensure_checkpoint_dir(read.sparkSession)
    return rows.withColumn("malformed", F.when(F.col(CORRUPT).isNotNull(), reason)).drop("_cells").checkpoint(eager=True)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text column as lines."""
    lines.write.mode("overwrite").text(path)


def preview(df: DataFrame, key: str = "tool_code", n: int = 5) -> DataFrame:
    """The first n rows in a stable order (a top-k, not a full sort)."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV, no index column; one directory of part files."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_name(kind: str, as_of: dt.date) -> str:
    """The dated name of an export, e.g. ``tools_export_20240601.csv``."""
    return f"{kind}_export_{as_of:%Y%m%d}.csv"


def export_dated(df: DataFrame, folder: str, kind: str, as_of: dt.date) -> str:
    """A8 under its dated name below ``folder``; the same day's export is replaced.  Returns the path."""
    path = f"{folder.rstrip('/')}/{export_name(kind, as_of)}"
    export_csv(df, path)
    return path


def read_export_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def tools_json(df: DataFrame) -> DataFrame:
    """A9 + S17: one JSON object per tool (7 columns)."""
    cols = ["tool_code", "tool_name", "category", "location", "status", "condition_score", "usage_hours"]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Append-only, partitioned by prediction_date (no de-duplication)."""
    predictions.write.mode("append").partitionBy("prediction_date").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_usage(usage: DataFrame, path: str) -> None:
    """Usage history partitioned by check-out month (rows without a check-out
    time go to their check-in month), so date-range queries prune whole
    directories; appends never rewrite older months."""
    month = F.date_format(F.coalesce(F.col("checkout_time"), F.col("checkin_time")), "yyyy-MM")
    usage.withColumn("usage_month", month).write.mode("append").partitionBy("usage_month").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "tool_code", buckets: int = 64) -> DataFrame:
    """Store ``df`` bucketed and sorted by ``key`` as an external table in
    the session catalog (files under ``path``, e.g. the shared folder).
    Tables bucketed on the same key with the same bucket count join and
    aggregate by that key without a shuffle (co-located).  Returns the table."""
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
       .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
