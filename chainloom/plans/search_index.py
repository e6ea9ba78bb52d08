"""A search index: what a hash, address, selector, topic or number names, as a table clustered by that key.

Entries of a batch are sorted by key in ranges, so the key's minima and maxima leave a lookup one or a few row groups, and
Parquet bloom filters those that have the key; a key of very many entries (a common event's topic) is spread over files,
as ranges go on by block and hash. Batches are added one by one and count when their mark is written, last; blocks that
a batch replaces (after a reorganisation) lose their entries of earlier batches. A batch that failed is written again
under its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.plans.query_spec import kind_of
from chainloom.scratch import freed

ROW_GROUP_BYTES, KEYS_A_GROUP = 16 << 20, 200_000
ENTRY = "key string, chain_id bigint, type string, block_number bigint, hash string"
#: The types of entries that each kind of text finds.
FINDS = {"block": ["block"], "hash": ["block", "transaction", "event_signature"], "selector": ["function_signature"], "address": ["contract", "address"]}


def entries(blocks: DataFrame, transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """The entries of the tables, each scanned once; missing and empty keys have none."""

    def of(df: DataFrame, hash_: str, *keys: tuple[str, str]) -> DataFrame:
        made = F.array(*[F.struct(F.lit(kind).alias("type"), F.expr(key).alias("key")) for kind, key in keys])
        return df.select("chain_id", "block_number", F.col(hash_).alias("hash"), F.inline(made))

    numbers = of(blocks, "hash", ("block", "CAST(block_number AS STRING)"), ("block", "hash"))
    parties = ("address", "from_address"), ("address", "CASE WHEN NOT from_address <=> to_address THEN to_address END")  # once where both are one
    calls = of(transactions, "hash", ("transaction", "hash"), ("function_signature", "function_selector"), ("contract", "contract_address"), *parties)
    rows = numbers.unionByName(calls).unionByName(of(logs, "transaction_hash", ("event_signature", "topic_0")))
    return rows.where("key <> ''").select("key", "chain_id", "type", "block_number", "hash")


def add(path: str, found: DataFrame, batch: int, replaced: DataFrame | None = None, slices: int = 1) -> None:
    """Add entries as a batch; replaced: chain_id and block_number of blocks whose earlier entries no longer hold.

    slices: entries are sorted in so many parts (up to 16, by the first hex digit of a key), one after the other. Each scans
    `found` again, and its exchange has gone from the disk when the next begins.
    """
    order = ["key", "chain_id", "block_number", "hash"]
    digit, digits = F.substring("key", 3, 1), "0123456789abcdef"
    options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(KEYS_A_GROUP), "parquet.block.size": str(ROW_GROUP_BYTES), "compression": "zstd"}
    for k in range(slices):
        part = found.where(digit.isin(*digits[16 * k // slices : 16 * (k + 1) // slices])) if k else found.where(~digit.isin(*digits[16 // slices :])) if slices > 1 else found
        clustered = part.repartitionByRange(*order).sortWithinPartitions(*order)
        with freed(found.sparkSession):
            clustered.write.mode("append" if k else "overwrite").options(**options).parquet(f"{path}/entries/batch={int(batch)}")
    spark = found.sparkSession
    mark = spark.range(1).select(F.lit(None).cast("bigint").alias("chain_id"), F.lit(None).cast("bigint").alias("block_number"))
    marks = mark if replaced is None else mark.unionByName(replaced.select("chain_id", "block_number").distinct())
    marks.write.mode("overwrite").parquet(f"{path}/marks/batch={int(batch)}")


def find(spark: SparkSession, path: str, text: str, chain_id: int | None = None) -> DataFrame:
    """(type, chain_id, block_number, hash) of what a text names, as query_spec.search finds it, on one chain or all."""
    kind = kind_of(text)
    key = str(int(text)) if kind == "block" else text
    rows = spark.read.schema(f"{ENTRY}, batch bigint").parquet(f"{path}/entries").where((F.col("key") == key) & F.col("type").isin(FINDS.get(kind, [])))
    if chain_id is not None:
        rows = rows.where(F.col("chain_id") == chain_id)
    marks = spark.read.schema("chain_id bigint, block_number bigint, batch bigint").parquet(f"{path}/marks")
    whole = F.broadcast(marks.where("block_number is null").select("batch"))  # a row a batch
    newer = marks.where("block_number is not null").groupBy("chain_id", "block_number").agg(F.max("batch").alias("since"))
    held = rows.join(whole, "batch", "left_semi").alias("e").join(newer.alias("n"), F.expr("e.chain_id = n.chain_id and e.block_number = n.block_number and e.batch < n.since"), "left_anti")
    return held.select("type", "chain_id", "block_number", "hash")
