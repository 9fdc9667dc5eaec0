"""Delta tables of micro-batches with compaction.

``<root>/batch=<id>`` holds what one micro-batch changed.  Once ``every`` batches have
gathered, ``compact`` folds them into ``<root>/_snapshot/upto=<id>`` and then names that snapshot in
``<root>/_manifest/<id>``, a file that appears by one rename: a reader sees the old state or the new one,
and a snapshot whose manifest is missing (a job killed in the middle) does not exist for it and is
overwritten by the next compaction.  A reader takes the newest manifest's snapshot and the
batches after it, so it reads ``every`` batches and one snapshot at most, however long the stream has run.
Only batches before the one being written are folded: they are committed and never change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batches that gather before they are folded.
EVERY = 100


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers k of the entries ``<prefix><k>`` of a folder, ascending."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def write(batch: DataFrame, root: str, batch_id: int) -> None:
    """The changes of one micro-batch; a replayed batch overwrites its own folder with the same rows."""
    batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def newest(spark: SparkSession, root: str) -> int | None:
    """The last batch of the newest complete snapshot."""
    return max(_numbers(spark, f"{root}/_manifest", ""), default=None)


def pending(spark: SparkSession, root: str) -> list[int]:
    """Batches that no complete snapshot holds."""
    upto = newest(spark, root)
    return [k for k in _numbers(spark, root, "batch=") if upto is None or k > upto]


def read(spark: SparkSession, root: str, schema: str | T.StructType, before: int | None = None) -> DataFrame:
    """Snapshot and later batches (only those below ``before``): ``schema`` and batch, the batch
    a row comes from (for a snapshot's row the last one that changed it, or the snapshot's last)."""
    upto, later = newest(spark, root), pending(spark, root)
    full = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("batch", T.LongType())
    out = spark.read.schema(full).parquet(f"{root}/_snapshot/upto={upto}") if upto is not None else spark.createDataFrame([], full)
    paths = [f"{root}/batch={k}" for k in later if before is None or k < before]
    if paths:
        rows = spark.read.schema(full).option("basePath", root).parquet(*paths)
        out = out.unionByName(rows.select(*[F.col(f.name) for f in full[:-1]], F.col("batch").cast("long").alias("batch")))
    return out


def compact(spark: SparkSession, root: str, batch_id: int, schema: str, fold: Callable[[DataFrame], DataFrame],
            every: int = EVERY) -> bool:
    """Folds the batches before ``batch_id`` into a new snapshot if ``every`` of them have gathered.

    ``fold`` maps rows (``schema`` and batch) to the fewer rows that stand for them, batch included."""
    ready = [k for k in pending(spark, root) if k < batch_id]
    if len(ready) < every:
        return False
    upto = ready[-1]
    fold(read(spark, root, schema, batch_id)).write.mode("overwrite").parquet(f"{root}/_snapshot/upto={upto}")
    fs, path = file_system(spark, f"{root}/_manifest/{upto}")
    draft = file_system(spark, f"{root}/_manifest/.{upto}.draft")[1]
    fs.create(draft, True).close()
    if not fs.rename(draft, path) and not fs.exists(path):
        raise OSError(f"manifest {upto} of {root} could not be published")
    return True


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Removes what the two newest snapshots make needless: batches up to the older one, and snapshots
    and manifests before it.  Not called by the streams: a reader may still be busy with them."""
    marks = _numbers(spark, f"{root}/_manifest", "")
    if len(marks) < 2:
        return []
    keep = marks[-2]
    gone = ([f"{root}/batch={k}" for k in _numbers(spark, root, "batch=") if k <= keep]
            + [f"{root}/_manifest/{k}" for k in marks if k < keep]
            + [f"{root}/_snapshot/upto={k}" for k in _numbers(spark, f"{root}/_snapshot", "upto=") if k < keep])
    for path in gone:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    return gone
