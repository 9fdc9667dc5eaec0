"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.session import ensure_checkpoint_dir, shared_path, ship_package

# Fixed value: what separates words in every contract (Java / RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read through Spark (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and the shared folder known."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # whole texts travel in these batches: fewer rows bound a worker's memory
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    by files that every executor can read, so a lost executor costs only its
    own tasks."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that a Python worker has freed back to the machine: workers
    serve many tasks, and what one task needed must not add to the next."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):               # not glibc
        pass


def with_row_key(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` of ``docs`` with a key per row, rid, that stays the same
    whenever the frame is read again: file and row number of a table as it is
    read from files, else the frame is written with a number first."""
    try:
        return docs.select(F.struct("_metadata.file_path", "_metadata.row_index").alias("rid"), *columns)
    except AnalysisException:                       # not a table of files
        return keep(docs.select(F.monotonically_increasing_id().alias("rid"), *columns), name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long).

    Returns (node, root): every node that has an edge, with the smallest node
    it reaches.  Alternates large-star and small-star steps (Kiveris et al.,
    2014); each step is two min-aggregations with map-side combine and a join
    that AQE may split, so a hub with very many edges is never one group in
    one task.  Null ends and loops are ignored.  No edges: no rows."""
    a, b = F.col("a"), F.col("b")
    cur = keep(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
               .distinct(), "cc-edges")
    before = None
    while True:
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        # large star: every larger neighbour of a node is linked to the node's minimum
        both = cur.union(cur.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
                 .where(a != b).distinct())
        # small star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))))
        cur = keep(small.distinct(), "cc-edges")
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(cur.select("b", "b").distinct()))
