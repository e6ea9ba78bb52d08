"""Block messages: envelopes with ordered headers, replacement batches, and the tables that are made of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import zstandard
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.operators.latest import DELETED, VERSION, delete_insert

COMPRESS_BYTES, TOPIC, TYPE = 50 * 1024 * 1024, "chain.blocks", "block_data"


@F.pandas_udf(T.BinaryType())
def _pressed(values):
    press = zstandard.ZstdCompressor()
    return values.map(lambda x: None if x is None else press.compress(x))


@F.pandas_udf(T.BinaryType())
def _unpressed(values):
    unpress = zstandard.ZstdDecompressor()
    return values.map(lambda x: None if x is None else unpress.decompressobj().decompress(x))


def messages(nested: DataFrame, at: Column, is_reorg: bool = False, compress_bytes: int | None = COMPRESS_BYTES) -> DataFrame:
    """Assembled blocks as records: topic, partition, key, value, headers (in fixed order).

    nested may have is_deleted and insert_timestamp (of replacement batches); without them rows are inserts of `at`.
    compress_bytes None: values stay JSON and no Python runs.
    """
    deleted = F.col(DELETED).cast("int") if DELETED in nested.columns else F.lit(0)
    when = F.col(VERSION) if VERSION in nested.columns else at
    children = [c for c in ("transactions", "logs", "traces") if c in nested.columns]
    data = F.struct("block", *children, "chain_id", deleted.alias(DELETED), when.alias(VERSION))
    json = F.to_json(F.struct(data.alias("data"), F.lit(TYPE).alias("type"), when.alias("timestamp")), {"ignoreNullFields": "false"})
    rows = nested.withColumn("__json", F.encode(json, "utf-8"))
    value, kind = F.col("__json"), F.lit("json")
    if compress_bytes is not None:
        large = F.length("__json") >= compress_bytes
        value, kind = F.when(large, _pressed(F.when(large, F.col("__json")))).otherwise(F.col("__json")), F.when(large, "zstd").otherwise("json")
    text = {"chain_id": F.col("chain_id").cast("string"), "block_number": F.col("block_number").cast("string"), "is_reorg": F.lit(str(is_reorg).lower()), DELETED: (deleted == 1).cast("string"), "type": F.lit(TYPE), "timestamp": when.cast("string"), "schema_version": F.lit("1"), "content-type": kind}
    headers = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v, "utf-8").alias("value")) for k, v in text.items()])
    key = F.concat_ws(":", F.col("chain_id").cast("string"), F.lit(TYPE), F.col("block_number").cast("string"))
    return rows.select(F.concat(F.lit(f"{TOPIC}."), F.col("chain_id").cast("string")).alias("topic"), F.lit(0).alias("partition"), F.encode(key, "utf-8").alias("key"), value.alias("value"), headers.alias("headers"))


def wanted(nested: DataFrame, senders: Sequence[str] = (), receivers: Sequence[str] = (), addresses: Sequence[str] = (), topics: Sequence[str] = ()) -> DataFrame:
    """Assembled blocks with only the transactions from senders or to receivers and the logs of addresses and first topics.

    Lists that are empty filter nothing; hex texts are compared without case. Blocks stay, if with nothing in them.
    """
    among = lambda c, values: F.lower(c).isin(*[v.lower() for v in values])
    if senders or receivers:
        sides = [(k, v) for k, v in (("from_address", senders), ("to_address", receivers)) if v]
        nested = nested.withColumn("transactions", F.filter("transactions", lambda t: reduce(lambda a, b: a | b, [among(t[k], v) for k, v in sides])))
    if addresses or topics:
        parts = [(k, v) for k, v in (("address", addresses), ("topic_0", topics)) if v]
        nested = nested.withColumn("logs", F.filter("logs", lambda x: reduce(lambda a, b: a & b, [among(x[k], v) for k, v in parts])))
    return nested


def measured(nested: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """nested, and what an action on it will have seen: blocks, transactions, logs, first_block and last_block."""
    seen = Observation(name)
    size = lambda c: F.sum(F.size(c)) if c in nested.columns else F.lit(0)
    kinds = [size(c).cast("bigint").alias(c) for c in ("transactions", "logs")]
    return nested.observe(seen, F.count("*").alias("blocks"), *kinds, F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block")), seen


def replacement(old: DataFrame, new: DataFrame, at: Column, **options) -> DataFrame:
    """Records of a replaced range: tombstones of the old blocks, and the new ones, whose version is later."""
    return messages(delete_insert(old, new, at), at, is_reorg=True, **options)


def opened(records: DataFrame, nested_schema: T.StructType) -> DataFrame:
    """The assembled blocks of records, with is_deleted and insert_timestamp."""
    kind = F.decode(F.get(F.filter("headers", lambda h: h["key"] == "content-type"), F.lit(0))["value"], "utf-8")
    value = F.when(kind == "zstd", _unpressed(F.when(kind == "zstd", F.col("value")))).otherwise(F.col("value"))
    names = [f for f in nested_schema.fields if f.name in ("block", "transactions", "logs", "traces")]
    data = T.StructType([*names, T.StructField("chain_id", T.LongType()), T.StructField(DELETED, T.IntegerType()), T.StructField(VERSION, T.TimestampType())])
    envelope = T.StructType([T.StructField("data", data), T.StructField("type", T.StringType())])
    rows = records.select(F.from_json(F.decode(value, "utf-8"), envelope, {"mode": "FAILFAST"}).alias("m"))
    return rows.where(F.col("m.type") == TYPE).select("m.data.*").withColumn("block_number", F.col("block.block_number"))


def materialised(nested: DataFrame, name: str) -> DataFrame:
    """Rows of one table, with the version and tombstone flag of their block."""
    extra = [F.col(DELETED).cast("tinyint").alias(DELETED), VERSION]
    if name == "blocks":
        return nested.select("block.*", *extra)
    return nested.select(F.explode(name).alias("__r"), *extra).select("__r.*", DELETED, VERSION)
