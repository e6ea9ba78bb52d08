"""Staged files: a row a block, with JSON texts of the block and its children, in chain_<id>/year=<yyyy>/ folders.

Spark writes and commits the files; what a file holds is known from its footer and from a manifest beside the data, so
no name carries a range. Files that do carry one (blocks_<start>_<end>.parquet) can be pruned by it before they are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom import schemas

CHILDREN = ("transactions", "logs", "traces")
RANGE = r"blocks_(\d+)_(\d+)\.parquet$"


class StagingError(ValueError):
    """A staged row that can't be read."""


def encoded(nested: DataFrame) -> DataFrame:
    """Assembled blocks as staged rows; a block without children of a kind has "[]"."""
    json = {f"{k}_json": F.to_json(F.coalesce(k, F.array().cast(nested.schema[k].dataType)), {"ignoreNullFields": "false"}) for k in CHILDREN if k in nested.columns}
    missing = {f"{k}_json": F.lit("[]") for k in CHILDREN if k not in nested.columns}
    columns = {"block_json": F.to_json("block", {"ignoreNullFields": "false"})} | json | missing
    return nested.select("chain_id", "block_number", F.col("block.hash").alias("block_hash"), F.unix_seconds(F.col("block.block_timestamp").cast("timestamp")).alias("block_timestamp"), *[columns[k].alias(k) for k in ("block_json", "transactions_json", "logs_json", "traces_json")])


def write(staged: DataFrame, path: str, rows_per_file: int = 50_000, mode: str = "append") -> DataFrame:
    """Write below path and return the manifest of this batch: files with their ranges, counts and sizes.

    Rows are range-partitioned by chain and number, so files hold stretches of blocks and their footers prune reads.
    """
    spread = staged.repartitionByRange("chain_id", "block_number").sortWithinPartitions("chain_id", "block_number")
    rows = spread.withColumn("year", F.year(F.timestamp_seconds("block_timestamp")))
    rows.write.partitionBy("chain_id", "year").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode(mode).parquet(path)
    return manifest(staged.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, chain_id, start_block, end_block, n_blocks, bytes of every staged file; only two narrow columns are read."""
    rows = spark.read.parquet(path).select("chain_id", "block_number", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "chain_id").agg(F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"), F.count("*").alias("n_blocks"), F.max("bytes").alias("bytes"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def ranges(paths: DataFrame, column: str = "path") -> DataFrame:
    """paths with start_block and end_block out of their names; names of another form are left out."""
    of = lambda k: F.nullif(F.regexp_extract(column, RANGE, k), F.lit("")).cast("bigint")
    return paths.where(F.col(column).rlike(RANGE)).withColumn("start_block", of(1)).withColumn("end_block", of(2))


def surviving(files: DataFrame, cursor: int) -> DataFrame:
    """Files from the first, by start, that ends after the cursor: all whose start isn't before that one's."""
    first = files.where(F.col("end_block") > cursor).agg(F.min("start_block").alias("__first"))
    return files.join(F.broadcast(first), F.col("start_block") >= F.col("__first"), "left_semi")


def resume(files: DataFrame, start: int, end: int | None) -> DataFrame:
    """One row, next_block: one after the greatest staged file end within start .. end, or start; an open end is any."""
    inside = (F.col("end_block") >= start) if end is None else F.col("end_block").between(start, end)
    return files.where(inside).agg(F.coalesce(F.max("end_block") + 1, F.lit(start)).cast("bigint").alias("next_block"))


def stored_schema(entity: str) -> T.StructType:
    return T.StructType([f for f in schemas.schema(entity) if f.name not in ("insert_timestamp", "sign")])


def scan(spark: SparkSession, paths: str | Iterable[str], cursor: int | None = None) -> DataFrame:
    """Staged rows of numbers from the cursor on. Files of other writers may hold unsigned numbers and binary texts.

    A file that can't be read fails the job.
    """
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    kinds = dict(x.strip().split(" ") for x in schemas.STAGED.split(","))
    rows = rows if cursor is None else rows.where(F.col("block_number") >= cursor)
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds])


def decoded(staged: DataFrame, block_schema: T.StructType | None = None, **child_schemas: T.StructType) -> DataFrame:
    """Staged rows as assembled blocks. A row whose JSON can't be read raises; an empty child text is no children."""
    block = F.from_json("block_json", block_schema or stored_schema("blocks"), {"mode": "FAILFAST"})
    children = []
    for k in CHILDREN:
        kind = T.ArrayType(child_schemas.get(k) or stored_schema(k))
        source = F.when(F.coalesce(F.col(f"{k}_json"), F.lit("")) == "", "[]").otherwise(F.col(f"{k}_json"))
        children.append(F.from_json(source, kind, {"mode": "FAILFAST"}).alias(k))
    return staged.select("chain_id", "block_number", block.alias("block"), *children)


def staged_bytes(staged: DataFrame) -> DataFrame:
    """staged with n_bytes, the length of its four texts."""
    return staged.withColumn("n_bytes", sum((F.coalesce(F.octet_length(f"{k}_json"), F.lit(0)) for k in CHILDREN), F.coalesce(F.octet_length("block_json"), F.lit(0))).cast("bigint"))


def batch_size(memory_bytes: int, mean_bytes: float, now: int, least: int = 10, most: int = 999, band: float = 0.2) -> int:
    """Blocks a batch for a memory target; the one in use stays while the new one is within the band."""
    aim = max(least, min(most, int(memory_bytes // mean_bytes))) if mean_bytes > 0 else now
    return aim if abs(aim - now) > band * now else now
