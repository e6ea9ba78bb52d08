"""The star-schema tables seen as a chain: orders are blocks, line items are versions of transactions, events are logs.

Each view has the same definition in Spark and in SQL (VIEWS). Every expression is over a row, so filters on numbers
reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.hexes import EMPTY_BLOOM
from chainloom.operators.blocks import dealt
from chainloom.operators.integrity import KEY
from chainloom.operators.latest import latest, latest_in
from chainloom.scratch import written

VERSION = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 101 != 50)


def block_columns(c: Callable[[str], Column] = F.col) -> list[Column]:
    """The columns of a header, of its order."""
    n = c("o_orderkey")
    return [
        F.lit(1).cast("bigint").alias("chain_id"), n.alias("block_number"), F.md5(n.cast("string")).alias("hash"),
        F.when(n % 97 == 0, F.md5((-n - 7).cast("string"))).otherwise(F.md5((n - 1).cast("string"))).alias("parent_hash"),
        c("o_orderdate").alias("block_timestamp"), F.concat(F.lit("m"), c("o_custkey").cast("string")).alias("miner"),
        (c("o_custkey") % 7).alias("transaction_count"), F.round(c("o_totalprice") * 100).cast("bigint").alias("gas_used"),
        F.when(n % 5 == 0, EMPTY_BLOOM).when(n % 5 == 1, "").otherwise(F.concat(F.lit("0x"), F.repeat(F.md5(n.cast("string")), 16))).alias("logs_bloom"),
    ]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 101st number is missing, every 97th has another parent; what a header states of its transactions is o_custkey % 7."""
    return _orders(spark, sf_dir).select(*block_columns())


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the columns that versions need; returned ones are tombstones.

    Versions are compared in this form: what is made of it is several times as wide, and all of it goes through shuffles.
    """
    return table(spark, sf_dir, "lineitem").select(*LINE, *VERSION, (F.col("l_returnflag") == "R").alias("is_deleted"))


def tx_columns(c: Callable[[str], Column] = F.col) -> list[Column]:
    """The columns of a transaction, of its line item."""
    name = F.concat_ws(":", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))
    return [
        F.lit(1).cast("bigint").alias("chain_id"), c("l_orderkey").alias("block_number"), c("l_linenumber").cast("bigint").alias("transaction_index"), F.md5(name).alias("hash"),
        F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("from_address"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("to_address"),
        F.round(c("l_extendedprice") * 100).cast("bigint").alias("value"), c("l_quantity").cast("bigint").alias("gas"),
        F.concat(F.lit("0x"), F.md5(c("l_partkey").cast("string"))).alias("data"),
    ]


def transactions(spark: SparkSession, sf_dir: str, kept: bool = False) -> DataFrame:
    """The final transactions; kept: their line items are chosen once and written, for what reads them many times."""
    lines = latest(line_items(spark, sf_dir), LINE, VERSION)
    return (written(lines) if kept else lines).select(*tx_columns())


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_id") % 401 != 6)


def log_columns(c: Callable[[str], Column] = F.col) -> list[Column]:
    """The columns of a log, of its event."""
    e = c("event_id")
    number = F.floor(e / 8).cast("bigint")
    return [
        F.lit(1).cast("bigint").alias("chain_id"), number.alias("block_number"), c("ts").alias("block_timestamp"),
        F.md5(F.concat_ws(":", number.cast("string"), (F.floor((e % 8) / 2)).cast("string"))).alias("transaction_hash"), (e % 8).alias("log_index"), c("event_type").alias("address"), F.md5(c("event_type")).alias("topic_0"),
        F.concat(F.lit("u"), c("user_id").cast("string")).alias("topic_1"), c("props").alias("data"), F.round(c("value") * 100).cast("bigint").alias("amount"), c("user_id").alias("user_id"),
    ]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events a block; one in 401 is lost, so some log indexes have gaps."""
    return _events(spark, sf_dir).select(*log_columns())


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their transactions and logs, by ranges of their numbers: `assembled` of the views.

    Orders, line items and events are brought together as they are, and become what the views make of them in their block.
    """
    place = lambda number: (F.lit(1).cast("bigint").alias("chain_id"), number.cast("bigint").alias("block_number"))
    headers = _orders(spark, sf_dir).select(*place(F.col("o_orderkey")), "o_custkey", "o_totalprice", "o_orderdate")
    lines = line_items(spark, sf_dir).select(*place(F.col("l_orderkey")), "l_linenumber", *VERSION, "is_deleted")
    events = _events(spark, sf_dir).select(*place(F.floor(F.col("event_id") / 8)), "event_id", "ts", "user_id", "event_type", "value", "props")
    rows = dealt(headers, transactions=lines, logs=events)
    own = lambda x, key: lambda name: F.col("block_number") if name == key else x[name]
    return rows.withColumn("transactions", latest_in("transactions", "l_linenumber")).select(
        *KEY, F.struct(*block_columns(own(F.col("block"), "o_orderkey"))).alias("block"),
        F.transform("transactions", lambda x: F.struct(*tx_columns(own(x, "l_orderkey")))).alias("transactions"), F.transform("logs", lambda x: F.struct(*log_columns(lambda name: x[name]))).alias("logs"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    kind = F.when(F.col("address") == "purchase", "erc20").when(F.col("address").isin("view", "click"), "erc721").otherwise("erc1155")
    token = F.get_json_object("data", "$.k").cast("bigint")
    return logs(spark, sf_dir).select(
        kind.alias("token_type"), "chain_id", F.col("address").alias("token_address"), F.col("topic_1").alias("from_address"), F.concat(F.lit("u"), ((u * 7 + 3) % 150).cast("string")).alias("to_address"),
        "block_number", "block_timestamp", "transaction_hash", F.when(kind == "erc20", F.lit(0).cast("bigint")).otherwise(token).alias("token_id"), "amount", "log_index",
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as many short chains of 256 numbers, with competing headers: a fifth of the numbers have a second one, whose
    parent is one of either kind, and every 31st first one has a second one as its parent, which may not be there."""
    key, m = F.col("o_orderkey"), F.col("o_custkey") % 10
    of = lambda kind, k: F.md5(F.concat(F.lit(kind), k.cast("string")))
    place = [F.floor(key / 256).cast("bigint").alias("chain_id"), (key % 256).cast("bigint").alias("block_number")]
    orders = table(spark, sf_dir, "orders")
    first = orders.select(*place, of("", key).alias("hash"), F.when(key % 31 == 0, of("f", key - 1)).otherwise(of("", key - 1)).alias("parent_hash"))
    second = orders.where(m % 5 == 0).select(*place, of("f", key).alias("hash"), F.when(m == 0, of("f", key - 1)).otherwise(of("", key - 1)).alias("parent_hash"))
    return first.unionAll(second)


HEADERS = """WITH RECURSIVE headers AS (
  SELECT CAST(o_orderkey // 256 AS BIGINT) AS chain_id, CAST(o_orderkey % 256 AS BIGINT) AS block_number, md5('' || o_orderkey) AS hash, CASE WHEN o_orderkey % 31 = 0 THEN md5('f' || (o_orderkey - 1)) ELSE md5('' || (o_orderkey - 1)) END AS parent_hash FROM orders
  UNION ALL SELECT CAST(o_orderkey // 256 AS BIGINT), CAST(o_orderkey % 256 AS BIGINT), md5('f' || o_orderkey), CASE WHEN o_custkey % 10 = 0 THEN md5('f' || (o_orderkey - 1)) ELSE md5('' || (o_orderkey - 1)) END FROM orders WHERE o_custkey % 5 = 0
), heads AS (
  SELECT chain_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY block_number DESC, hash) AS place FROM headers) WHERE place = 1
), chain AS (
  SELECT h.* FROM headers h JOIN heads USING (chain_id, hash)
  UNION ALL SELECT p.* FROM chain c JOIN headers p ON p.chain_id = c.chain_id AND p.hash = c.parent_hash AND p.block_number = c.block_number - 1
), off AS (
  SELECT * FROM headers WHERE (chain_id, hash) NOT IN (SELECT (chain_id, hash) FROM chain)
), climb AS (
  SELECT chain_id, block_number, hash, parent_hash AS up, block_number - 1 AS up_number FROM off
  UNION ALL SELECT k.chain_id, k.block_number, k.hash, o.parent_hash, o.block_number - 1 FROM climb k JOIN off o ON o.chain_id = k.chain_id AND o.hash = k.up AND o.block_number = k.up_number
), orphans AS (
  SELECT o.chain_id, o.block_number, o.hash, f.ancestor, f.ancestor_hash FROM off o
  LEFT JOIN (SELECT k.chain_id, k.hash, c.block_number AS ancestor, c.hash AS ancestor_hash FROM climb k JOIN chain c ON c.chain_id = k.chain_id AND c.hash = k.up AND c.block_number = k.up_number) f
  ON o.chain_id = f.chain_id AND o.hash = f.hash
)
"""

VIEWS = """WITH blocks AS (
  SELECT CAST(1 AS BIGINT) AS chain_id, o_orderkey AS block_number, md5(CAST(o_orderkey AS VARCHAR)) AS hash,
    CASE WHEN o_orderkey % 97 = 0 THEN md5(CAST(-o_orderkey - 7 AS VARCHAR)) ELSE md5(CAST(o_orderkey - 1 AS VARCHAR)) END AS parent_hash,
    o_orderdate AS block_timestamp, 'm' || o_custkey AS miner, o_custkey % 7 AS transaction_count, CAST(round(o_totalprice * 100) AS BIGINT) AS gas_used,
    CASE o_orderkey % 5 WHEN 0 THEN '0x' || repeat('0', 512) WHEN 1 THEN '' ELSE '0x' || repeat(md5(CAST(o_orderkey AS VARCHAR)), 16) END AS logs_bloom
  FROM orders WHERE o_orderkey % 101 <> 50
), tx_versions AS (
  SELECT CAST(1 AS BIGINT) AS chain_id, l_orderkey AS block_number, CAST(l_linenumber AS BIGINT) AS transaction_index, md5(l_orderkey || ':' || l_linenumber) AS hash,
    's' || l_suppkey AS from_address, 'p' || l_partkey AS to_address, CAST(round(l_extendedprice * 100) AS BIGINT) AS value, CAST(l_quantity AS BIGINT) AS gas,
    '0x' || md5(CAST(l_partkey AS VARCHAR)) AS data, l_returnflag = 'R' AS is_deleted,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS age
  FROM lineitem
), transactions AS (
  SELECT * EXCLUDE (is_deleted, age) FROM tx_versions WHERE age = 1 AND NOT is_deleted
), logs AS (
  SELECT CAST(1 AS BIGINT) AS chain_id, event_id // 8 AS block_number, ts AS block_timestamp, md5((event_id // 8) || ':' || ((event_id % 8) // 2)) AS transaction_hash, event_id % 8 AS log_index,
    event_type AS address, md5(event_type) AS topic_0, 'u' || user_id AS topic_1, props AS data, CAST(round(value * 100) AS BIGINT) AS amount, user_id
  FROM events WHERE event_id % 401 <> 6
), kinds AS (
  SELECT *, CASE WHEN address = 'purchase' THEN 'erc20' WHEN address IN ('view', 'click') THEN 'erc721' ELSE 'erc1155' END AS token_type FROM logs
), transfers AS (
  SELECT token_type, chain_id, address AS token_address, topic_1 AS from_address, 'u' || ((user_id * 7 + 3) % 150) AS to_address, block_number, block_timestamp, transaction_hash,
    CASE WHEN token_type = 'erc20' THEN 0 ELSE CAST(json_extract_string(data, '$.k') AS BIGINT) END AS token_id, amount, log_index
  FROM kinds
), movements AS (
  SELECT token_type, chain_id, token_address AS address, token_id, to_address AS owner, amount FROM transfers
  UNION ALL SELECT token_type, chain_id, token_address, token_id, from_address, -amount FROM transfers
), balances AS (
  SELECT token_type, chain_id, owner, address, token_id, CAST(sum(amount) AS BIGINT) AS balance FROM movements GROUP BY ALL
), tx_counts AS (
  SELECT chain_id, block_number, count(*) AS tx_count FROM transactions GROUP BY ALL
), log_counts AS (
  SELECT chain_id, block_number, count(*) AS log_count, max(log_index) AS max_log_index FROM logs GROUP BY ALL
), tx_mismatches AS (
  SELECT b.chain_id, b.block_number, b.transaction_count, coalesce(c.tx_count, 0) AS tx_count FROM blocks b LEFT JOIN tx_counts c USING (chain_id, block_number)
  WHERE b.transaction_count <> coalesce(c.tx_count, 0)
), log_reasons AS (
  SELECT b.chain_id, b.block_number, coalesce(c.log_count, 0) AS log_count, c.max_log_index,
    CASE WHEN logs_bloom <> '' AND logs_bloom <> '0x' || repeat('0', 512) THEN CASE WHEN c.log_count IS NULL THEN 'missing' WHEN max_log_index + 1 <> c.log_count THEN 'gap' END
      WHEN c.log_count > 0 THEN 'unexpected' END AS reason
  FROM blocks b LEFT JOIN log_counts c USING (chain_id, block_number)
), log_mismatches AS (
  SELECT * FROM log_reasons WHERE reason IS NOT NULL
), pairs AS (
  SELECT a.block_number, a.parent_hash = b.hash AS fits FROM blocks a JOIN blocks b ON b.block_number = a.block_number - 1
)
"""
