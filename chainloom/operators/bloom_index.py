"""Blooms of blocks as an index of logs: what a block's bloom rules out isn't read.

Logs are stored in folders of `span` numbers, sorted by number, beside a table of the blooms of those blocks. A lookup
probes the blooms for the values' bits, by built-in functions, and the blocks that may hold them prune the folders of
logs before these are scanned, by Spark's dynamic partition pruning. The logs that come out are filtered exactly, so the
bloom decides what is read and never what is found: a block without a whole bloom counts as one that may hold anything.
A bloom that lacks bits of its own logs would hide them; strict validation finds such blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.keccak import BLOOM_BITS, keccak256

SPAN, MAX_BLOCKS = 10_000, 500_000
COLUMNS = ("address", "topic_0", "topic_1", "topic_2", "topic_3")


def bits_of(value: str) -> list[int]:
    """The bits that a hex value sets in a bloom; 0 is the last bit."""
    h = keccak256(bytes.fromhex(value.removeprefix("0x")))
    return sorted({int.from_bytes(h[k : k + 2], "big") % BLOOM_BITS for k in (0, 2, 4)})


def may_hold(bloom: Column, *values: str) -> Column:
    """Whether a bloom of 512 digits has the bits of all values; true for what is no such bloom."""
    found = F.lit(True)
    for bit in sorted({b for v in values for b in bits_of(v)}):
        digits = [d for d in "0123456789abcdef" if int(d, 16) >> bit % 4 & 1]
        found = found & F.lower(F.substring(bloom, 3 + BLOOM_BITS // 4 - 1 - bit // 4, 1)).isin(digits)
    return F.coalesce(~bloom.rlike("^0x[0-9a-fA-F]{512}$"), F.lit(True)) | found


def write(logs: DataFrame, headers: DataFrame, path: str, span: int = SPAN) -> None:
    """Store logs by spans, and the blooms of all blocks that have logs; headers: chain_id, block_number, logs_bloom."""
    place = F.floor(F.col("block_number") / span).cast("bigint")
    order = ["chain_id", "span", "block_number", "log_index"]
    logs.withColumn("span", place).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("chain_id", "span").parquet(f"{path}/logs")
    numbers = logs.sparkSession.read.parquet(f"{path}/logs").select("chain_id", "span", "block_number").distinct()
    blooms = headers.select(F.col("chain_id").alias("c"), F.col("block_number").alias("n"), "logs_bloom")
    of_all = numbers.join(blooms, (F.col("chain_id") == F.col("c")) & (F.col("block_number") == F.col("n")), "left").drop("c", "n")
    # dealt by span, since ranges would be sampled and all blooms be computed twice for it
    of_all.repartition("chain_id", "span").sortWithinPartitions("chain_id", "block_number").write.parquet(f"{path}/blooms")


def events(spark: SparkSession, path: str, chain_id: int, **values: str) -> DataFrame:
    """Logs of a chain whose address or topics (COLUMNS) are these hex values.

    Blocks that may hold them are counted; beyond MAX_BLOCKS the values are too common for blooms to rule much out, and
    the logs are scanned without them. Either way gives the same rows.
    """
    if unknown := set(values) - set(COLUMNS):
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    rows = spark.read.parquet(f"{path}/logs").where(F.col("chain_id") == chain_id)
    for column, value in values.items():
        rows = rows.where(F.lower(column) == value.lower())
    candidates = spark.read.parquet(f"{path}/blooms").where(F.col("chain_id") == chain_id).where(may_hold(F.col("logs_bloom"), *values.values()))
    keys = ["chain_id", "span", "block_number"]
    if not values or candidates.count() > MAX_BLOCKS:
        return rows.drop("span")
    return rows.join(F.broadcast(candidates.select(*keys)), keys, "left_semi").drop("span")  # numbers may repeat in headers; a semi join takes a log once
