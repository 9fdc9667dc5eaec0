"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

1. quality classifier: documents scored below the cut go.
2. SimHash near-dedup: one document of each group (3-word shingles, 2 bits) stays.
3. secret scans: every span is replaced by a mark; the documents stay.
4. mixing: sources are brought to their target weights, block by block.
5. packing: what is left becomes sequences of 4,096 token ids.

Stages 1 to 4 return the columns of ``documents``; the last one returns the
packed pieces.  Rows with null or repeated ids pass like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm import mixing, packing, quality_knn, secrets, simhash
from fleetkit.llm.common import keep, prepare, table, with_row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learnt from the labels, rejects."""
    judged = quality_knn.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each SimHash group the row with the smallest doc_id (null last)."""
    prepare(spark)
    rows = with_row_key(docs, COLUMNS, "dedup-texts")
    marked = keep(simhash.with_fingerprint(rows.select("rid", "doc_id", "text"), 3), "dedup-marks")
    roots = simhash.rooted(marked.select("fp").distinct(), 2)
    stays = marked.join(roots, "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("rid"))
    return rows.join(stays, "rid", "left_semi").select(COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts."""
    return secrets.redacted(docs).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source as many words as its target says."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents; one row per piece of a sequence."""
    return packing.pack(docs.select("doc_id", "text")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", dedup_stage), ("secret scans", secret_stage),
          ("mixing sources to target weights", mixing_stage), ("packing", packing_stage)]
#: The stages train, hash, draw and pack in ways SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{k}")
    return docs
