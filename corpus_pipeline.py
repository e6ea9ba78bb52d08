"""A corpus in five stages: quality, near duplicates, benchmark passages, personal data, packing.

Each stage works on all that the one before kept, takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Rows with null texts go through every stage as empty ones; rows that repeat a doc_id stay
or go together; null doc_ids stay in the stages that drop by id. ORACLE_SQL is None: the classifier and the field of the
fourth stage have no SQL form; tests/llm compares each stage with a plain version on its own input, and run() with all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import decontaminate, jaccard_join, packing, pii, quality_model
from chainloom.llm.common import bounded, read, small_batches, written
from chainloom.ship import ship

SHINGLE, SIMILARITY = 5, 80
#: Of what encoders keep in the last stage; the executors' Java heap is at its limit after the stages before.
KEPT = 150_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ids; up to a counted bound ids are broadcast and texts stay where they are."""
    return docs.join(bounded(written(ids.distinct())), "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    with small_batches(spark):
        forest = quality_model.train(docs, read(spark, sf_dir, "labels"))
    return quality_model.accepted(docs, forest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word shingles, the one with the least doc_id."""
    with small_batches(spark):
        groups = jaccard_join.linked(docs, SHINGLE, SIMILARITY)
        return without(docs, groups.where("component_id <> doc_id").select("doc_id"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return without(docs, decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by kind; n_chars is that of the masked text."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(packing.cut_table(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, KEPT))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
