"""The chain queries, by name: each takes (spark, sf_dir), and has the same result in SQL over the same tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions import abi, hexes
from chainloom.functions.keccak import block_blooms, call_selector, event_topic
from chainloom.operators import blocks as nesting
from chainloom.operators import bloom_index, current, forks, integrity, latest, normalize, tokens
from chainloom.plans import chainview as view
from chainloom.plans import routes, search_index
from chainloom.plans.query_spec import QuerySpec, answer, search
from chainloom.scratch import dropped, freed, shared_dir
from chainloom.sources import staged_sink, staging
from chainloom.streaming.publish import materialised, messages, opened, replacement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LOW, HIGH = 100, 900
NOW = "2001-06-01 00:00:00"


def query(sql: str | None):
    """Register a query under its name, with its SQL over the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if sql.startswith("WITH ") else view.VIEWS + sql
        return f

    return add


def day(df: DataFrame, column: str = "block_timestamp") -> DataFrame:
    """Times as date texts, which every engine writes alike."""
    return df.withColumn(column, F.col(column).cast("date").cast("string"))


def views(f):
    """f(blocks, transactions, logs) as a query."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(view.blocks(spark, sf_dir), view.transactions(spark, sf_dir), view.logs(spark, sf_dir))

    return run


# Reads


@query(f"SELECT block_number, hash, parent_hash, miner, transaction_count FROM blocks WHERE block_number BETWEEN {LOW} AND {HIGH}")
@views
def scan_range(blocks, transactions, logs):
    return integrity.in_range(blocks, LOW, HIGH).select("block_number", "hash", "parent_hash", "miner", "transaction_count")


@query("SELECT block_number, transaction_index, hash, value FROM transactions WHERE block_number IN (7, 77, 150, 777, 1200)")
@views
def scan_in(blocks, transactions, logs):
    return transactions.where(F.col("block_number").isin(sorted({777, 7, 77, 150, 1200, 7}))).select("block_number", "transaction_index", "hash", "value")


@query(f"SELECT n.block_number, b.hash, b.parent_hash FROM (SELECT unnest(range({LOW}, {HIGH} + 1)) AS block_number) n LEFT JOIN blocks b USING (block_number)")
@views
def headers_dense(blocks, transactions, logs):
    return integrity.dense(blocks.select("chain_id", "block_number", "hash", "parent_hash"), LOW, HIGH, 1).select("block_number", "hash", "parent_hash")


@query("SELECT chain_id, max(block_number) AS max_block FROM blocks GROUP BY chain_id HAVING count(*) > 0")
@views
def max_block(blocks, transactions, logs):
    return blocks.groupBy("chain_id").agg(F.max("block_number").alias("max_block"), F.count("*").alias("n")).where("n > 0").drop("n")


@query("SELECT coalesce(max(block_number), 0) AS max_block FROM blocks WHERE block_timestamp <= TIMESTAMP '2001-06-01' - INTERVAL 1 DAY")
@views
def block_days_ago(blocks, transactions, logs):
    return blocks.where(F.col("block_timestamp") <= F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")).agg(F.coalesce(F.max("block_number"), F.lit(0)).cast("bigint").alias("max_block"))


@query("SELECT block_number, transaction_index, hash, from_address, to_address, value FROM transactions")
@views
def final_tx(blocks, transactions, logs):
    return transactions.select("block_number", "transaction_index", "hash", "from_address", "to_address", "value")


@query("SELECT block_number, transaction_index, hash, value FROM transactions")
def current_tx(spark, sf_dir):
    """The final transactions out of a kept table, into which their versions came in three batches of no order."""
    path, rows = shared_dir(spark), view.line_items(spark, sf_dir)
    sender = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    for k in range(3):
        current.merge(path, rows.where(F.crc32(sender) % 3 == k), view.LINE, view.VERSION, buckets=16)
    return current.read(spark, path).select(*view.tx_columns()).select("block_number", "transaction_index", "hash", "value")


@query("SELECT chain_id, block_number, tx_count FROM tx_counts")
@views
def tx_counts(blocks, transactions, logs):
    return integrity.tx_counts(transactions)


@query("SELECT chain_id, block_number, log_count, max_log_index FROM log_counts")
@views
def log_counts(blocks, transactions, logs):
    return integrity.log_counts(logs)


# Integrity


@query("SELECT * FROM tx_mismatches")
@views
def tx_mismatch(blocks, transactions, logs):
    return integrity.tx_mismatches(blocks, transactions)


@query("SELECT * FROM log_mismatches")
@views
def log_mismatch(blocks, transactions, logs):
    return integrity.log_mismatches(blocks, logs)


@query("SELECT chain_id, min(block_number) AS tx_start, max(block_number) AS tx_end FROM tx_mismatches GROUP BY chain_id")
@views
def mismatch_range(blocks, transactions, logs):
    return integrity.span(integrity.tx_mismatches(blocks, transactions), "tx")


@query(
    """, s AS (SELECT min(block_number) - 1 AS a FROM pairs WHERE NOT fits)
SELECT CAST(1 AS BIGINT) AS chain_id, s.a AS hash_start, coalesce((SELECT min(block_number) FROM pairs, s WHERE fits AND block_number > s.a), (SELECT max(block_number) FROM blocks)) AS hash_end FROM s"""
)
@views
def parent_hash_breaks(blocks, transactions, logs):
    return integrity.breaks(blocks)


@query("SELECT chain_id, block_number FROM blocks WHERE block_number > (SELECT min(block_number) FROM blocks) AND block_number - 1 NOT IN (SELECT block_number FROM blocks)")
@views
def contiguity(blocks, transactions, logs):
    return integrity.gaps(blocks)


@query(
    """, hole AS (SELECT min(n) AS a, max(n) AS b FROM (SELECT unnest(range(150, 251)) AS n) WHERE n NOT IN (SELECT block_number FROM blocks)),
bad AS (SELECT min(block_number) - 1 AS a FROM pairs WHERE NOT fits AND block_number BETWEEN 151 AND 250),
fine AS (SELECT min(block_number) AS b FROM pairs, bad WHERE fits AND block_number BETWEEN 151 AND 250 AND block_number > bad.a),
last AS (SELECT max(block_number) AS b FROM blocks WHERE block_number BETWEEN 150 AND 250),
tx AS (SELECT min(block_number) AS a, max(block_number) AS b FROM tx_mismatches WHERE block_number BETWEEN 150 AND 250),
lg AS (SELECT min(block_number) AS a, max(block_number) AS b FROM log_mismatches WHERE block_number BETWEEN 150 AND 250),
plan AS (SELECT coalesce(least(hole.a, bad.a, tx.a, lg.a), -1) AS start_block, coalesce(greatest(hole.b, CASE WHEN bad.a IS NOT NULL THEN coalesce(fine.b, last.b) END, tx.b, lg.b), -1) AS end_block, coalesce(last.b, 149) AS last_header FROM hole, bad, fine, last, tx, lg)
SELECT CAST(1 AS BIGINT) AS chain_id, *, CASE WHEN end_block >= 0 THEN end_block ELSE last_header END AS last_valid FROM plan"""
)
@views
def reorg_plan(blocks, transactions, logs):
    return integrity.reorg_plan(blocks, transactions, logs, 150, 250, 1)


@query(
    """, doubtful AS (
  SELECT n AS block_number FROM (SELECT unnest(range(100, 901)) AS n) WHERE n NOT IN (SELECT block_number FROM blocks)
  UNION SELECT unnest([block_number - 1, block_number]) FROM pairs WHERE NOT fits AND block_number BETWEEN 101 AND 900
  UNION SELECT block_number FROM tx_mismatches WHERE block_number BETWEEN 100 AND 900
  UNION SELECT block_number FROM log_mismatches WHERE block_number BETWEEN 100 AND 900),
islands AS (SELECT block_number, block_number - row_number() OVER (ORDER BY block_number) AS island FROM doubtful)
SELECT CAST(1 AS BIGINT) AS chain_id, min(block_number) AS start_block, max(block_number) AS end_block FROM islands GROUP BY island"""
)
@views
def repair_ranges(blocks, transactions, logs):
    return integrity.repair_ranges(blocks, transactions, logs, LOW, HIGH, 1)


@query(", islands AS (SELECT block_number, block_number - row_number() OVER (ORDER BY block_number) AS island FROM blocks)\nSELECT CAST(1 AS BIGINT) AS chain_id, min(block_number) AS start_block, max(block_number) AS end_block FROM islands GROUP BY island")
@views
def stored_ranges(blocks, transactions, logs):
    return integrity.islands(blocks)


@query(view.HEADERS + "SELECT chain_id, block_number, hash FROM chain")
def fork_choice(spark, sf_dir):
    return forks.canonical(view.headers(spark, sf_dir))


@query(view.HEADERS + "SELECT * FROM orphans")
def fork_orphans(spark, sf_dir):
    headers = view.headers(spark, sf_dir)
    forest = forks.linked(headers)
    off = forks.orphans(headers, forks.canonical(headers, forest=forest), forest)
    dropped(*forest)
    return off


@query(view.HEADERS + "SELECT chain_id, ancestor, count(*) AS n_orphans, min(block_number) AS start_block, max(block_number) AS end_block FROM orphans GROUP BY chain_id, ancestor")
def fork_branches(spark, sf_dir):
    headers = view.headers(spark, sf_dir)
    return forks.branches(forks.orphans(headers, forks.canonical(headers)))


@query(
    """SELECT b.block_number, b.transaction_count = coalesce(t.tx_count, 0) AND length(logs_bloom) >= 2 AND (regexp_matches(logs_bloom, '^0x0*$') OR coalesce(l.log_count, 0) > 0) AS valid
FROM blocks b LEFT JOIN tx_counts t USING (chain_id, block_number) LEFT JOIN log_counts l USING (chain_id, block_number)"""
)
@views
def block_validation(blocks, transactions, logs):
    return integrity.validated(blocks, transactions, logs).select("block_number", "valid")


@query("SELECT block_number, NOT regexp_matches(logs_bloom, '^0x0*$') AS bloom_set FROM blocks WHERE logs_bloom <> ''")
@views
def bloom_nonzero(blocks, transactions, logs):
    return blocks.where("logs_bloom <> ''").select("block_number", hexes.bloom_set(F.col("logs_bloom")).alias("bloom_set"))


# Blocks


@query(
    """SELECT b.block_number, coalesce(t.n, 0) AS n_transactions, coalesce(t.v, 0) AS total_value, coalesce(l.log_count, 0) AS n_logs
FROM blocks b LEFT JOIN (SELECT block_number, count(*) AS n, CAST(sum(value) AS BIGINT) AS v FROM transactions GROUP BY 1) t USING (block_number) LEFT JOIN log_counts l USING (block_number)"""
)
@views
def assemble_blocks(blocks, transactions, logs):
    rows = nesting.assembled(blocks, transactions=transactions, logs=logs)
    total = F.aggregate("transactions", F.lit(0).cast("bigint"), lambda s, t: s + t["value"])
    return rows.select("block_number", F.size("transactions").cast("bigint").alias("n_transactions"), total.alias("total_value"), F.size("logs").cast("bigint").alias("n_logs"))


AT = "2024-01-01 00:00:00"


@query("SELECT block_number, transaction_index, hash, from_address, to_address, value, gas, data FROM transactions WHERE block_number IN (SELECT block_number FROM blocks)")
def staging_roundtrip(spark, sf_dir):
    """All blocks as staged files, and their transactions read back."""
    nested, path = view.nested(spark, sf_dir), shared_dir(spark)
    child = lambda k: nested.schema[k].dataType.elementType
    staged_sink.write(staging.encoded(nested), path, gaps="allow", dealt=True)
    back = staging.decoded(staged_sink.committed(spark, path), nested.schema["block"].dataType, transactions=child("transactions"), logs=child("logs"))
    return nesting.exploded(back, "transactions").select("block_number", "transaction_index", "hash", "from_address", "to_address", "value", "gas", "data")


@query("SELECT chain_id, block_number, hash AS block_hash FROM blocks WHERE block_number >= 450")
@views
def committed_from(blocks, transactions, logs):
    """All blocks as committed files of small size, and those from a cursor on read from the files that can hold them."""
    path = shared_dir(blocks.sparkSession)
    files = staged_sink.write(staging.encoded(nesting.assembled(blocks)), path, gaps="allow", max_file_bytes=1 << 20)
    return staged_sink.committed(blocks.sparkSession, path, 450, files).select("chain_id", "block_number", "block_hash")


@query("SELECT chain_id, min(block_number) AS low, max(block_number) AS high, count(*) AS n_blocks FROM blocks GROUP BY chain_id")
@views
def staged_footers(blocks, transactions, logs):
    """What the footers of staged files say they hold."""
    path = shared_dir(blocks.sparkSession)
    staged_sink.write(staging.encoded(nesting.assembled(blocks)), path, gaps="allow")
    found = staged_sink.footers(staged_sink.listed(blocks.sparkSession, f"{path}/data", "*.parquet"))
    return found.groupBy("chain_id").agg(F.min("start_block").alias("low"), F.max("end_block").alias("high"), F.sum("n_blocks").alias("n_blocks"))


@query("SELECT block_number, log_index, address, topic_0, topic_1, data, 0 AS is_deleted FROM logs WHERE block_number IN (SELECT block_number FROM blocks)")
def message_roundtrip(spark, sf_dir):
    """All blocks as written messages, opened again."""
    nested, path = view.nested(spark, sf_dir), shared_dir(spark)
    with freed(spark):
        messages(nested, F.lit(AT).cast("timestamp"), compress_bytes=4096).write.option("compression", "zstd").parquet(path)
    rows = materialised(opened(spark.read.parquet(path), nested.schema), "logs")
    return rows.select("block_number", "log_index", "address", "topic_0", "topic_1", "data", F.col("is_deleted").cast("int").alias("is_deleted"))


@query("SELECT block_number, CASE WHEN d = 1 THEN miner ELSE 'n' || miner END AS miner, d AS is_deleted, d = 1 AS is_tombstone FROM blocks, (SELECT unnest([0, 1]) AS d)")
@views
def delete_insert_union(blocks, transactions, logs):
    new = blocks.withColumn("miner", F.concat(F.lit("n"), "miner"))
    rows = latest.delete_insert(blocks, new, F.lit(AT).cast("timestamp"))
    return rows.select("block_number", "miner", F.col("is_deleted").cast("int").alias("is_deleted"), (F.col("op_seq") == 0).alias("is_tombstone"))


@query("SELECT block_number, 'n' || miner AS miner FROM blocks")
@views
def replaced_blocks(blocks, transactions, logs):
    """A replacement of all blocks as written messages, opened, materialised and read as its latest versions."""
    old = nesting.assembled(blocks)
    new = old.withColumn("block", F.col("block").withField("miner", F.concat(F.lit("n"), "block.miner")))
    path = shared_dir(blocks.sparkSession)
    replacement(old, new, F.lit(AT).cast("timestamp"), compress_bytes=None).write.parquet(path)
    rows = materialised(opened(blocks.sparkSession.read.parquet(path), old.schema), "blocks")
    return latest.latest(rows, ["chain_id", "block_number"]).select("block_number", "miner")


@query("SELECT block_number, CASE WHEN block_number % 3 = 0 THEN CASE WHEN block_number % 2 = 0 THEN 'again' END ELSE hash END AS result, CASE WHEN block_number % 6 = 3 THEN 'still' END AS error FROM blocks")
@views
def retry_merge(blocks, transactions, logs):
    n = F.col("block_number")
    first = blocks.select("block_number", F.when(n % 3 != 0, F.col("hash")).alias("result"), F.when(n % 3 == 0, "failed").alias("error"))
    again = first.where("error is not null").select("block_number", F.when(n % 2 == 0, "again").alias("result"), F.when(n % 2 != 0, "still").alias("error"))
    return latest.retried(first, again, "block_number")


@query("SELECT chunk, count(*) AS n, min(block_number) AS low, max(block_number) AS high FROM (SELECT block_number, (row_number() OVER (ORDER BY block_number) - 1) // 100 AS chunk FROM blocks) GROUP BY 1")
@views
def chunks(blocks, transactions, logs):
    return latest.chunked(blocks, "block_number", 100).groupBy("chunk").agg(F.count("*").alias("n"), F.min("block_number").alias("low"), F.max("block_number").alias("high"))


@query("SELECT block_number, transaction_index, hash FROM transactions WHERE block_number >= 1000")
@views
def cursor_skip(blocks, transactions, logs):
    return integrity.in_range(transactions, 1000, None).select("block_number", "transaction_index", "hash")


@query("SELECT t.block_number, string_agg(hash, ',' ORDER BY transaction_index) AS hashes FROM transactions t WHERE from_address <> 's3' GROUP BY 1")
@views
def tx_hash_join(blocks, transactions, logs):
    """Blocks that hold only hashes, joined to the transactions that were found, in their order."""
    lists = transactions.groupBy("block_number").agg(F.transform(F.sort_array(F.collect_list(F.struct("transaction_index", "hash"))), lambda x: x["hash"]).alias("hashes"))
    known = transactions.where("from_address <> 's3'").select("hash")
    rows = lists.select("block_number", F.posexplode("hashes").alias("pos", "hash")).join(known, "hash")
    return rows.groupBy("block_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]), ",").alias("hashes"))


@query("SELECT 'c/blocks_' || (100 * k) || '_' || (100 * k + 99) || '.parquet' AS path, 100 * k AS start_block, 100 * k + 99 AS end_block FROM (SELECT DISTINCT block_number // 100 AS k FROM blocks) WHERE 100 * k + 99 > 450")
@views
def file_prune(blocks, transactions, logs):
    k = F.floor(F.col("block_number") / 100).cast("bigint") * 100
    names = blocks.select(F.concat(F.lit("c/blocks_"), k.cast("string"), F.lit("_"), (k + 99).cast("string"), F.lit(".parquet")).alias("path")).distinct()
    return staging.surviving(staging.ranges(names.unionAll(names.select(F.lit("c/other.parquet").alias("path")).distinct())), 450).select("path", "start_block", "end_block")


@query("SELECT greatest(coalesce(max(end_block) + 1, 120), 120) AS next_block FROM (SELECT DISTINCT 100 * (block_number // 100) + 99 AS end_block FROM blocks) WHERE end_block BETWEEN 120 AND 1250")
@views
def resume_block(blocks, transactions, logs):
    files = blocks.select((100 * F.floor(F.col("block_number") / 100) + 99).cast("bigint").alias("end_block")).distinct()
    return staging.resume(files, 120, 1250)


# The query contract


@query("SELECT block_number, log_index, address, topic_1, data FROM logs WHERE address = 'click' AND topic_1 = 'u7' ORDER BY block_number, log_index LIMIT 50")
@views
def filter_eq(blocks, transactions, logs):
    found = answer(logs, "logs", QuerySpec(filters={"address": "click", "topic_1": "u7"}, limit=50))
    return found.data.select("block_number", "log_index", "address", "topic_1", "data")


@query("SELECT from_address, count(*) AS count, CAST(sum(value) AS BIGINT) AS total_value, count(DISTINCT to_address) AS unique_to, CAST(sum(CASE WHEN value > 5000000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM transactions GROUP BY 1 ORDER BY total_value DESC, from_address LIMIT 20")
@views
def group_agg(blocks, transactions, logs):
    spec = QuerySpec(group_by=["from_address"], sort_by="total_value", sort_order="desc", limit=20, aggregates=["COUNT(*) AS count", "SUM(value) AS total_value", "COUNT(DISTINCT to_address) AS unique_to", "SUM(CASE WHEN value > 5000000 THEN 1 ELSE 0 END) AS large"])
    return answer(transactions, "transactions", spec).aggregations


@query(
    """, w AS (SELECT *, CAST(value AS HUGEINT) * 1000000000000000000 AS wide FROM transactions)
SELECT from_address, CAST(sum(CAST(wide AS DECIMAL(38, 0))) AS VARCHAR) AS total_value, CAST(max(wide) AS VARCHAR) AS most, CAST(min(wide) AS VARCHAR) AS least,
  CAST(sum(CASE WHEN wide > 5000000000000000000000000 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(DISTINCT wide) AS n_values
FROM w GROUP BY 1 ORDER BY sum(CAST(wide AS DECIMAL(38, 0))) DESC, from_address LIMIT 20"""
)
@views
def group_agg_256(blocks, transactions, logs):
    """Aggregates of 256-bit values as the library's tables hold them."""
    low, high = F.lit(10**9).cast("decimal(20,0)"), F.lit(10**9).cast("decimal(20,0)")
    wide = transactions.withColumn("value", hexes.u256_of_decimal(F.col("value").cast("decimal(19,0)") * low * high))
    aggregates = ["SUM(value) AS total_value", "MAX(value) AS most", "MIN(value) AS least", "SUM(CASE WHEN value > 5000000000000000000000000 THEN 1 ELSE 0 END) AS large", "COUNT(DISTINCT value) AS n_values"]
    return answer(wide, "transactions", QuerySpec(group_by=["from_address"], sort_by="total_value", sort_order="desc", limit=20, aggregates=aggregates)).aggregations


@query("SELECT block_number, transaction_index, hash FROM transactions WHERE value > 0 AND value = (SELECT max(value) FROM transactions) ORDER BY 1, 2 LIMIT 5")
@views
def filter_256(blocks, transactions, logs):
    """A decimal filter value on a column of 64 hex digits."""
    most = transactions.agg(F.max("value")).first()[0]
    wide = transactions.withColumn("value", hexes.u256_of(F.col("value")))
    return answer(wide, "transactions", QuerySpec(filters={"value": str(most)}, limit=0)).data.select("block_number", "transaction_index", "hash")


@query("SELECT block_number, transaction_index, hash, value FROM transactions ORDER BY value DESC, block_number, transaction_index LIMIT 25 OFFSET 50")
@views
def sort_page(blocks, transactions, logs):
    return answer(transactions, "transactions", QuerySpec(sort_by="value", sort_order="desc", page=2, limit=25)).data.select("block_number", "transaction_index", "hash", "value")


@query("SELECT count(*) AS total_items, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM transactions")
@views
def page_meta(blocks, transactions, logs):
    return answer(transactions, "transactions", QuerySpec(limit=25)).meta


@query("SELECT block_number, transaction_index, hash FROM transactions WHERE from_address = 's7' OR to_address = 's7'")
@views
def wallet_tx(blocks, transactions, logs):
    return tokens.of_wallet(transactions, "s7").select("block_number", "transaction_index", "hash")


@query("SELECT block_number, transaction_index, hash, to_address, substr(data, 1, 10) AS function_selector FROM transactions WHERE to_address = 'p77' AND substr(data, 1, 10) = '0x' || substr(md5('77'), 1, 8)")
def tx_selector(spark, sf_dir):
    rows = view.transactions(spark, sf_dir).withColumn("function_selector", hexes.selector(F.col("data")))
    chosen = "0x" + hashlib.md5(b"77").hexdigest()[:8]
    return rows.where((F.col("to_address") == "p77") & (F.col("function_selector") == chosen)).select("block_number", "transaction_index", "hash", "to_address", "function_selector")


@query("SELECT block_number, log_index, topic_1, data FROM logs WHERE address = 'purchase' AND topic_0 = md5('purchase')")
@views
def events_by_contract_sig(blocks, transactions, logs):
    return logs.where((F.col("address") == "purchase") & (F.col("topic_0") == F.md5(F.lit("purchase")))).select("block_number", "log_index", "topic_1", "data")


@query("SELECT 'block' AS type, block_number, hash FROM blocks WHERE block_number = 321")
@views
def search_block(blocks, transactions, logs):
    return search("321", blocks, transactions, logs)


@query("SELECT CASE WHEN k = 0 THEN 'block' ELSE 'transaction' END AS type, block_number, hash FROM (SELECT 0 AS k, block_number, hash FROM h_blocks UNION ALL SELECT 1, block_number, hash FROM h_transactions) WHERE hash = '0x' || md5('104:6') || md5('104:6')".replace("h_blocks", "(SELECT block_number, '0x' || hash || hash AS hash FROM blocks)").replace("h_transactions", "(SELECT block_number, '0x' || hash || hash AS hash FROM transactions)"))
@views
def search_hash(blocks, transactions, logs):
    return search(_hash("104:6"), *_hexed(blocks, transactions, logs))


@query("SELECT 'event_signature' AS type, block_number, transaction_hash AS hash FROM logs WHERE address = 'click'")
@views
def search_topic(blocks, transactions, logs):
    """A hash that is the first topic of logs."""
    return search(_hash("click"), *_hexed(blocks, transactions, logs))


@query("SELECT 'function_signature' AS type, block_number, '0x' || hash || hash AS hash FROM transactions WHERE substr(data, 1, 10) = '0x' || substr(md5('77'), 1, 8)")
@views
def search_selector(blocks, transactions, logs):
    return search("0x" + hashlib.md5(b"77").hexdigest()[:8], *_hexed(blocks, transactions, logs))


@query("SELECT type, block_number, '0x' || hash || hash AS hash FROM transactions, (SELECT unnest(['contract', 'address']) AS type) WHERE CASE type WHEN 'contract' THEN block_number % 50 = 0 AND from_address = 's7' ELSE from_address = 's7' OR to_address = 's7' END")
@views
def search_address(blocks, transactions, logs):
    return search(_address("s7"), *_hexed(blocks, transactions, logs))


def _hash(text: str) -> str:
    return "0x" + 2 * hashlib.md5(text.encode()).hexdigest()


def _address(text: str) -> str:
    return "0x" + hashlib.md5(text.encode()).hexdigest() + "0" * 8


def _hexed(blocks, transactions, logs):
    """The views with hashes and addresses as long as a chain's."""
    address = lambda c: F.concat(F.lit("0x"), F.md5(c), F.lit("0" * 8))
    twice = lambda c: F.concat(F.lit("0x"), c, c)
    made = F.when(F.col("block_number") % 50 == 0, F.col("from_address"))
    transactions = transactions.withColumns({"contract_address": address(made), "from_address": address(F.col("from_address")), "to_address": address(F.col("to_address")), "hash": twice(F.col("hash")), "function_selector": hexes.selector(F.col("data"))})
    return blocks.withColumn("hash", twice(F.col("hash"))), transactions, logs.withColumn("topic_0", twice(F.col("topic_0")))


@query(
    """, t AS (SELECT *, '0x' || hash || hash AS tx FROM transactions), b AS (SELECT *, '0x' || hash || hash AS h FROM blocks)
    SELECT 'number' AS asked, 'block' AS type, block_number, h AS hash FROM b WHERE block_number = 321
    UNION ALL SELECT 'hash', 'transaction', block_number, tx FROM t WHERE hash = md5('104:6')
    UNION ALL SELECT 'hash', 'block', block_number, h FROM b WHERE hash = md5('104:6')
    UNION ALL SELECT 'topic', 'event_signature', block_number, transaction_hash FROM logs WHERE address = 'click'
    UNION ALL SELECT 'selector', 'function_signature', block_number, tx FROM t WHERE substr(data, 1, 10) = '0x' || substr(md5('77'), 1, 8)
    UNION ALL SELECT 'address', 'contract', block_number, tx FROM t WHERE block_number % 50 = 0 AND from_address = 's7'
    UNION ALL SELECT 'address', 'address', block_number, tx FROM t WHERE from_address = 's7' OR to_address = 's7'"""
)
def search_indexed(spark, sf_dir):
    """All tables indexed, and a text of each kind looked up."""
    path, tables = shared_dir(spark), (view.blocks(spark, sf_dir), view.transactions(spark, sf_dir, kept=True), view.logs(spark, sf_dir))
    search_index.add(path, search_index.entries(*_hexed(*tables)), 1, slices=4)
    asked = {"number": "321", "hash": _hash("104:6"), "topic": _hash("click"), "selector": "0x" + hashlib.md5(b"77").hexdigest()[:8], "address": _address("s7")}
    rows = [search_index.find(spark, path, text, 1).withColumn("asked", F.lit(name)).drop("chain_id") for name, text in asked.items()]
    return reduce(DataFrame.unionByName, rows)


# Decoding

TRANSFER = "Transfer(address indexed from, address indexed to, uint256 value)"


def _events(logs):
    """Logs as transfer events of hex words."""
    padded = lambda c: F.concat(F.lit("0x"), F.repeat(F.lit("0"), 32), F.md5(c))
    return logs.withColumns({"topic_0": F.when(F.col("log_index") % 2 == 0, event_topic("Transfer(address,address,uint256)")).otherwise("0x"), "topic_2": padded(F.col("address")), "topic_1": padded(F.col("topic_1")), "data": F.concat(F.lit("0x"), hexes.u256_of(F.col("user_id")))})


@query("SELECT block_number, log_index, 'Transfer' AS name, 'Transfer(address,address,uint256)' AS signature, '0x' || repeat('0', 8) || md5(topic_1) AS sender, '0x' || repeat('0', 8) || md5(address) AS receiver, CAST(user_id AS VARCHAR) AS value FROM logs WHERE log_index % 2 = 0")
@views
def decoded_events(blocks, transactions, logs):
    rows = abi.event(_events(logs), TRANSFER)
    indexed = F.col("decoded.indexed_params")
    return rows.select("block_number", "log_index", "decoded.name", "decoded.signature", indexed["from"].alias("sender"), indexed["to"].alias("receiver"), F.col("decoded.non_indexed_params")["value"].alias("value"))


@query("SELECT block_number, log_index, CAST(user_id AS VARCHAR) AS value FROM logs WHERE log_index % 2 = 0 AND address = 'click' ORDER BY block_number DESC, log_index LIMIT 20 OFFSET 20")
@views
def decoded_page(blocks, transactions, logs):
    """The second page of a contract's events, decoded."""
    found = routes.events_of(_events(logs), QuerySpec(decode=True, page=1, limit=20, sort_by="block_number", sort_order="desc"), "click", TRANSFER)
    return found.data.select("block_number", "log_index", F.col("decoded.non_indexed_params")["value"].alias("value"))


@query("SELECT block_number, transaction_index, CAST(value AS VARCHAR) AS amount, from_address || to_address AS memo, '[\"' || gas || '\",\"' || transaction_index || '\"]' AS items FROM transactions WHERE from_address = 's7' OR to_address = 's7'")
@views
def wallet_decoded(blocks, transactions, logs):
    """Calls with a number, a text and a list among a wallet's transactions, decoded."""
    word = hexes.u256_of
    memo = F.concat("from_address", "to_address")
    text = F.rpad(F.lower(F.hex(F.encode(memo, "utf-8"))), 64, "0")
    head = F.concat(word(F.col("value")), word(F.lit(96)), word(F.lit(160)), word(F.length(memo)), text, word(F.lit(2)), word(F.col("gas")), word(F.col("transaction_index")))
    rows = tokens.of_wallet(transactions, "s7").withColumn("data", F.concat(F.lit(call_selector("pay(uint256,string,uint8[])")), head))
    inputs = F.col("decoded.inputs")
    return abi.call(rows, "pay(uint amount, string memo, uint8[] items)").select("block_number", "transaction_index", *[inputs[k].alias(k) for k in ("amount", "memo", "items")])


@query(
    """SELECT block_number, transaction_index, '[{"to":"0x' || md5(from_address) || '00000000","amounts":["' || gas || '"]},{"to":"0x' || md5(to_address) || '00000000","amounts":["' || transaction_index || '"]}]' AS orders,
    '{"ok":"' || CASE WHEN gas % 2 = 1 THEN 'true' ELSE 'false' END || '","memo":"' || from_address || '"}' AS note, '[["' || value || '"],["' || block_number || '"]]' AS grid FROM transactions"""
)
@views
def nested_calls(blocks, transactions, logs):
    """Calls with a list of tuples that hold lists, a tuple with a text and a list of fixed lists, decoded."""
    signature = "fill((address to, uint256[] amounts)[] orders, (bool ok, string memo) note, uint256[1][2] grid)"
    word = hexes.u256_of
    order = lambda who, n: F.concat(F.lit("0" * 24), F.md5(who), F.lit("0" * 8), word(F.lit(64)), word(F.lit(1)), word(n))
    orders = F.concat(word(F.lit(2)), word(F.lit(64)), word(F.lit(192)), order("from_address", F.col("gas")), order("to_address", F.col("transaction_index")))
    note = F.concat(word(F.col("gas") % 2), word(F.lit(64)), word(F.length("from_address")), F.rpad(F.lower(F.hex(F.encode("from_address", "utf-8"))), 64, "0"))
    data = F.concat(F.lit(call_selector(abi.checked(signature)[0])), word(F.lit(128)), word(F.lit(480)), word(F.col("value")), word(F.col("block_number")), orders, note)
    inputs = F.col("decoded.inputs")
    return abi.call(transactions.withColumn("data", data), signature).select("block_number", "transaction_index", *[inputs[k].alias(k) for k in ("orders", "note", "grid")])


# Tokens


@query("SELECT token_type, token_address, from_address, to_address, block_number, log_index, token_id, amount FROM transfers WHERE token_type IN ('erc20', 'erc721') AND (from_address = 'u7' OR to_address = 'u7') AND block_number BETWEEN 10 AND 1000")
def transfers(spark, sf_dir):
    rows = tokens.filtered(view.transfers(spark, sf_dir), ["erc20", "erc721"], wallet="u7", start_block=10, end_block=1000)
    return rows.select("token_type", "token_address", "from_address", "to_address", "block_number", "log_index", "token_id", "amount")


@query("SELECT token_type, token_id, transaction_hash, block_number, log_index, amount FROM transfers WHERE token_type = 'erc721' AND token_address = 'view' AND token_id IN (1, 2, 3, 5, 8) AND block_timestamp BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def transfers_filtered(spark, sf_dir):
    rows = tokens.filtered(view.transfers(spark, sf_dir), ["erc721"], "view", start_time="2024-01-01T06:00:00Z", end_time="2024-01-20T00:00:00Z", token_ids=[1, 2, 3, 5, 8])
    return rows.select("token_type", "token_id", "transaction_hash", "block_number", "log_index", "amount")


@query("SELECT owner, token_id, balance, token_type FROM balances WHERE address = 'view' AND balance <> 0 AND token_type = 'erc721' ORDER BY balance DESC, owner, token_id LIMIT 30 OFFSET 30")
def holders_page(spark, sf_dir):
    rows = tokens.balances(view.transfers(spark, sf_dir))
    return routes.holders(rows, QuerySpec(sort_by="balance", sort_order="desc", page=1, limit=30), "view", ["erc721"]).data


@query("SELECT * FROM balances WHERE balance <> 0")
def balances(spark, sf_dir):
    return tokens.balances(view.transfers(spark, sf_dir), hide_zero=True)


@query("SELECT owner, token_id, balance, token_type FROM balances WHERE address = 'purchase' AND balance <> 0")
def holders(spark, sf_dir):
    return tokens.holders(balances(spark, sf_dir), "purchase")


@query("SELECT token_type, token_id, count(DISTINCT owner) AS n_owners FROM balances WHERE address = 'signup' AND balance <> 0 GROUP BY ALL")
def token_ids(spark, sf_dir):
    return tokens.token_ids(balances(spark, sf_dir), "signup")


# Functions


@query("SELECT o_orderkey, CAST(o_custkey * 1000003 AS BIGINT) AS number, CAST(o_custkey AS BIGINT) AS indexed FROM orders")
def hex_to_u64(spark, sf_dir):
    rows = view.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("0x"), F.hex(F.col("o_custkey") * 1000003)).alias("a"), F.concat(F.lit("0x"), F.hex("o_custkey")).alias("b"))
    return rows.select("o_orderkey", hexes.to_u64(F.col("a")).cast("bigint").alias("number"), hexes.to_index(F.col("b")).alias("indexed"))


@query("SELECT o_custkey, lpad(lower(printf('%x', CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT))), 64, '0') AS total FROM orders GROUP BY 1")
def u256_sum(spark, sf_dir):
    rows = view.table(spark, sf_dir, "orders").select("o_custkey", hexes.u256_of(F.round(F.col("o_totalprice") * 100)).alias("v"))
    sums = rows.groupBy("o_custkey").agg(*[s.alias(f"l{k}") for k, s in enumerate(hexes.sum_u256(F.col("v")))])
    return sums.select("o_custkey", hexes.carried([F.col(f"l{k}") for k in range(hexes.LIMBS)]).alias("total"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS amount, '0x' || lpad(printf('%x', event_id), 40, '0') AS wallet FROM events")
def abi_words(spark, sf_dir):
    rows = view.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("0x"), hexes.u256_of(F.col("user_id")), hexes.u256_of(F.col("event_id"))).alias("data"))
    return rows.select("event_id", hexes.abi_static(hexes.abi_word(F.col("data"), 0), "uint256").alias("amount"), hexes.abi_static(hexes.abi_word(F.col("data"), 1), "address").alias("wallet"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw payloads of blocks; every third transaction has no receipt."""
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    t = view.transactions(spark, sf_dir)
    n, k = F.col("block_number"), F.col("transaction_index")
    tx = F.struct(F.col("hash"), hexed(n).alias("blockNumber"), hexed(k).alias("transactionIndex"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), hexed(F.col("value")).alias("value"), hexed(F.col("gas")).alias("gas"), F.col("data").alias("input"), F.lit("0x2").alias("type"))
    log = F.struct(F.col("hash").alias("transactionHash"), hexed(k).alias("transactionIndex"), hexed(k * 2).alias("logIndex"), F.col("to_address").alias("address"), F.array(F.md5("from_address"), F.col("from_address")).alias("topics"), F.lit("0x").alias("data"))
    receipt = F.when(k % 3 != 0, F.struct(F.col("hash").alias("transactionHash"), hexed(F.col("gas") * 2).alias("gasUsed"), F.lit("0x1").alias("status"), F.array(log).alias("logs")))
    action = F.struct(F.lit("call").alias("callType"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), hexed(F.col("gas")).alias("gas"), hexed(F.col("value")).alias("value"), F.col("data").alias("input"))
    trace = F.struct(action.alias("action"), F.struct(hexed(F.col("gas") * 2).alias("gasUsed"), F.lit("0x").alias("output")).alias("result"), F.col("hash").alias("transactionHash"), k.alias("transactionPosition"), F.lit(0).alias("subtraces"), F.array(k, k + 1).alias("traceAddress"), F.lit("call").alias("type"))
    rows = t.groupBy("block_number").agg(F.collect_list(trace).alias("traces"), F.transform(F.sort_array(F.collect_list(F.struct("transaction_index", tx.alias("x")))), lambda v: v["x"]).alias("transactions"), F.collect_list(receipt).alias("receipts"))
    block = F.struct(hexed(n).alias("number"), F.md5(n.cast("string")).alias("hash"), F.lit("0x5f5e100").alias("timestamp"), F.lit("0x").alias("logsBloom"), F.col("transactions"))
    return rows.select(F.lit(1).cast("bigint").alias("chain_id"), "block_number", F.to_json(block).alias("block"), F.to_json("receipts").alias("receipts"), F.lit(None).cast("string").alias("logs"), F.to_json("traces").alias("traces"), F.lit(None).cast("string").alias("error"))


@query("SELECT block_number, transaction_index, hash, from_address, to_address, lpad(printf('%x', value), 64, '0') AS value, substr(data, 1, 10) AS function_selector, CASE WHEN transaction_index % 3 <> 0 THEN gas * 2 END AS gas_used, CASE WHEN transaction_index % 3 <> 0 THEN 1 END AS status FROM transactions")
def normalize_transactions(spark, sf_dir):
    rows = normalize.transactions(_raw(spark, sf_dir))
    return rows.select("block_number", "transaction_index", "hash", "from_address", "to_address", "value", "function_selector", F.col("gas_used").cast("bigint").alias("gas_used"), F.col("status").cast("int").alias("status"))


@query("SELECT block_number, transaction_index, 2 * transaction_index AS log_index, to_address AS address, md5(from_address) AS topic_0, from_address AS topic_1, '' AS topic_2 FROM transactions WHERE transaction_index % 3 <> 0")
def normalize_logs(spark, sf_dir):
    return normalize.logs(_raw(spark, sf_dir)).select("block_number", "transaction_index", "log_index", "address", "topic_0", "topic_1", "topic_2")


@query("SELECT block_number, md5(CAST(block_number AS VARCHAR)) AS hash, count(*) AS transaction_count FROM transactions GROUP BY block_number")
def normalize_blocks(spark, sf_dir):
    return normalize.blocks(_raw(spark, sf_dir)).select("block_number", "hash", "transaction_count")


@query("SELECT block_number, transaction_index, hash AS transaction_hash, transaction_index || ',' || (transaction_index + 1) AS trace_address, from_address, to_address, gas, 2 * gas AS gas_used, lpad(printf('%x', value), 64, '0') AS value, data AS input FROM transactions")
def normalize_traces(spark, sf_dir):
    rows = normalize.traces(_raw(spark, sf_dir))
    return rows.select("block_number", "transaction_index", "transaction_hash", F.concat_ws(",", F.col("trace_address").cast("array<string>")).alias("trace_address"), "from_address", "to_address", F.col("gas").cast("bigint").alias("gas"), F.col("gas_used").cast("bigint").alias("gas_used"), "value", "input")


def _hex_logs(logs):
    """Logs with hex values, as blooms take them."""
    hexed = lambda c: F.concat(F.lit("0x"), F.md5(c))
    return logs.select("chain_id", "block_number", "log_index", "data", hexed(F.col("address")).alias("address"), F.concat(F.lit("0x"), "topic_0").alias("topic_0"), hexed(F.col("topic_1")).alias("topic_1"), F.lit("").alias("topic_2"), F.lit("").alias("topic_3"))


@query("SELECT block_number, log_index, data FROM logs WHERE address = 'purchase' AND topic_1 = 'u7'")
def bloom_events(spark, sf_dir):
    """All logs stored by spans with computed blooms, and a user's purchases read from the blocks that may hold them."""
    rows, path = _hex_logs(view.logs(spark, sf_dir)), shared_dir(spark)
    bloom_index.write(rows, block_blooms(rows), path, span=256)
    hexed = lambda text: "0x" + hashlib.md5(text.encode()).hexdigest()
    return bloom_index.events(spark, path, 1, address=hexed("purchase"), topic_1=hexed("u7")).select("block_number", "log_index", "data")


@query(None)
def computed_blooms(spark, sf_dir):
    """Blooms of the logs' hex topics; keccak has no SQL form, the tests have a brute-force version."""
    return block_blooms(_hex_logs(view.logs(spark, sf_dir)))
