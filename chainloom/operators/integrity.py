"""Checks of stored blocks and the plan of what to fetch again.

All checks are per chain. Neighbours are found by an equal join on the number plus one, not by a window over the whole
chain, so nothing passes through a single task; only one row a chain comes out of the aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.hexes import EMPTY_BLOOM, bloom_set
from chainloom.operators.latest import numbered

CHAIN, NUMBER = "chain_id", "block_number"
KEY = [CHAIN, NUMBER]


def in_range(df: DataFrame, start: int | None, end: int | None, number: str = NUMBER) -> DataFrame:
    """Rows of numbers start .. end, both included; None is open. Reaches the scan as a pushed filter."""
    if start is not None:
        df = df.where(F.col(number) >= start)
    return df if end is None else df.where(F.col(number) <= end)


def dense(headers: DataFrame, start: int, end: int, chain_id: int) -> DataFrame:
    """A row for each number start .. end with the header's columns, null where there is none."""
    numbers = headers.sparkSession.range(start, end + 1).select(F.lit(chain_id).cast("bigint").alias(CHAIN), F.col("id").alias(NUMBER))
    return numbers.join(in_range(headers, start, end), KEY, "left")


def tx_counts(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(*KEY).agg(F.count("*").alias("tx_count"))


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy(*KEY).agg(F.count("*").alias("log_count"), F.max("log_index").alias("max_log_index"))


def tx_mismatches(blocks: DataFrame, transactions: DataFrame) -> DataFrame:
    """Blocks whose header states another number of transactions than are stored."""
    joined = blocks.join(tx_counts(transactions), KEY, "left").withColumn("tx_count", F.coalesce("tx_count", F.lit(0).cast("bigint")))
    return joined.where(F.col("transaction_count") != F.col("tx_count")).select(*KEY, "transaction_count", "tx_count")


def log_mismatches(blocks: DataFrame, logs: DataFrame) -> DataFrame:
    """Blocks with a set bloom and no logs, a gap in log indexes, or logs where the bloom is empty ("" or all zeros)."""
    expects = (F.col("logs_bloom") != "") & (F.col("logs_bloom") != EMPTY_BLOOM)
    joined = blocks.join(log_counts(logs), KEY, "left").withColumn("log_count", F.coalesce("log_count", F.lit(0).cast("bigint")))
    why = (
        F.when(expects & (F.col("log_count") == 0), "missing")
        .when(expects & (F.col("max_log_index") + 1 != F.col("log_count")), "gap")
        .when(~expects & (F.col("log_count") > 0), "unexpected")
    )
    return joined.withColumn("reason", why).where("reason is not null").select(*KEY, "log_count", "max_log_index", "reason")


def span(rows: DataFrame, prefix: str) -> DataFrame:
    """chain_id, least and greatest number of the rows; chains without rows have none."""
    return rows.groupBy(CHAIN).agg(F.min(NUMBER).alias(f"{prefix}_start"), F.max(NUMBER).alias(f"{prefix}_end"))


def adjacent(headers: DataFrame) -> DataFrame:
    """chain_id, block_number, fits: whether the parent hash is the hash of the block before. Pairs with a hole are left out."""
    before = headers.select(CHAIN, (F.col(NUMBER) + 1).alias(NUMBER), F.col("hash").alias("hash_before"))
    return headers.select(*KEY, "parent_hash").join(before, KEY).select(*KEY, (F.col("parent_hash") == F.col("hash_before")).alias("fits"))


def breaks(headers: DataFrame) -> DataFrame:
    """The first run of headers that don't continue their parents: from the parent before it to the first child that
    fits again, or to the last header."""
    pairs = adjacent(headers)
    first = pairs.where("not fits").groupBy(CHAIN).agg((F.min(NUMBER) - 1).alias("hash_start"))
    after = pairs.where("fits").join(F.broadcast(first), CHAIN).where(F.col(NUMBER) > F.col("hash_start")).groupBy(CHAIN).agg(F.min(NUMBER).alias("__end"))
    last = headers.groupBy(CHAIN).agg(F.max(NUMBER).alias("__last"))
    return first.join(after, CHAIN, "left").join(last, CHAIN).select(CHAIN, "hash_start", F.coalesce("__end", "__last").alias("hash_end"))


def reorg_plan(blocks: DataFrame, transactions: DataFrame, logs: DataFrame, start: int, end: int, chain_id: int) -> DataFrame:
    """One row: the range to fetch again (start_block, end_block; -1 if none) and last_valid, the cursor afterwards."""
    blocks, transactions, logs = (in_range(df.where(F.col(CHAIN) == chain_id), start, end) for df in (blocks, transactions, logs))
    headers = blocks.select(*KEY, "hash", "parent_hash")
    holes = dense(headers, start, end, chain_id).where("hash is null")
    one = headers.sparkSession.createDataFrame([(chain_id,)], f"{CHAIN} bigint")
    found = [span(holes, "hole"), breaks(headers), span(tx_mismatches(blocks, transactions), "tx"), span(log_mismatches(blocks, logs), "log")]
    last = headers.groupBy(CHAIN).agg(F.max(NUMBER).alias("last_header"))
    row = reduce(lambda a, b: a.join(b, CHAIN, "left"), [*found, last], one)
    starts, ends = (F.coalesce(f(*[f"{p}_{side}" for p in ("hole", "hash", "tx", "log")]), F.lit(-1)) for f, side in ((F.least, "start"), (F.greatest, "end")))
    row = row.select(CHAIN, starts.alias("start_block"), ends.alias("end_block"), F.coalesce("last_header", F.lit(start - 1)).alias("last_header"))
    return row.withColumn("last_valid", F.when(F.col("end_block") >= 0, F.col("end_block")).otherwise(F.col("last_header")))


def gaps(blocks: DataFrame) -> DataFrame:
    """Numbers that follow no stored number: chain_id, block_number (the first after a gap), least number of a chain apart."""
    before = blocks.select(CHAIN, (F.col(NUMBER) + 1).alias(NUMBER))
    least = blocks.groupBy(CHAIN).agg(F.min(NUMBER).alias("__least"))
    return blocks.select(*KEY).join(before, KEY, "left_anti").join(F.broadcast(least), CHAIN).where(F.col(NUMBER) > F.col("__least")).select(*KEY)


def islands(rows: DataFrame) -> DataFrame:
    """The runs of consecutive numbers: chain_id, start_block, end_block. Repeats count once, nulls are left out.

    A run starts where the number before isn't there and ends where the next one isn't, which two joins tell; the k-th start
    belongs to the k-th end, in an order that no single task makes.
    """
    own = rows.select(*KEY).where(F.col(CHAIN).isNotNull() & F.col(NUMBER).isNotNull()).distinct()
    side = lambda step: numbered(own.join(own.select(CHAIN, (F.col(NUMBER) + step).alias(NUMBER)), KEY, "left_anti"), *KEY)
    starts, ends = side(1).withColumnRenamed(NUMBER, "start_block"), side(-1).select("position", F.col(NUMBER).alias("end_block"))
    return starts.join(ends, "position").select(CHAIN, "start_block", "end_block")


def doubtful(blocks: DataFrame, transactions: DataFrame, logs: DataFrame, start: int, end: int, chain_id: int) -> DataFrame:
    """chain_id, block_number and reason of every block of start .. end that is missing, doesn't fit a neighbour, or whose transactions or logs don't match."""
    blocks, transactions, logs = (in_range(df.where(F.col(CHAIN) == chain_id), start, end) for df in (blocks, transactions, logs))
    headers = blocks.select(*KEY, "hash", "parent_hash")
    apart = adjacent(headers).where("not fits").select(CHAIN, F.explode(F.array(F.col(NUMBER) - 1, F.col(NUMBER))).alias(NUMBER))
    found = [(dense(headers, start, end, chain_id).where("hash is null"), "missing"), (apart, "parent"), (tx_mismatches(blocks, transactions), "transactions"), (log_mismatches(blocks, logs), "logs")]
    return reduce(DataFrame.unionAll, [df.select(*KEY, F.lit(why).alias("reason")) for df, why in found]).distinct()


def repair_ranges(blocks: DataFrame, transactions: DataFrame, logs: DataFrame, start: int, end: int, chain_id: int) -> DataFrame:
    """The ranges to fetch again, each as short as can be: what stands between two wrong blocks and is right isn't in one."""
    return islands(doubtful(blocks, transactions, logs, start, end, chain_id))


def contiguous(blocks: DataFrame) -> DataFrame:
    """chain_id and whether its numbers have neither gaps nor repeats."""
    agg = blocks.groupBy(CHAIN).agg(F.min(NUMBER).alias("a"), F.max(NUMBER).alias("b"), F.count("*").alias("n"), F.sum((F.xxhash64(NUMBER) % 1_000_003)).alias("h"))
    repeats = blocks.groupBy(*KEY).agg(F.count("*").alias("k")).groupBy(CHAIN).agg(F.max("k").alias("most"))
    return agg.join(repeats, CHAIN).select(CHAIN, ((F.col("b") - F.col("a") + 1 == F.col("n")) & (F.col("most") == 1)).alias("contiguous"))


def verdict(mode: str = "minimal") -> Column:
    """Whether a block row with n_transactions and n_logs is valid; "strict" needs computed_bloom as well.

    The transactions root isn't recomputed: see the README.
    """
    if mode == "disabled":
        return F.lit(True)
    bloom = F.coalesce("logs_bloom", F.lit(""))
    sound = (F.col("transaction_count") == F.col("n_transactions")) & (F.length(bloom) >= 2) & (~bloom_set(bloom) | (F.col("n_logs") > 0))
    if mode == "minimal":
        return sound
    return sound & (F.lower(bloom) == F.coalesce("computed_bloom", F.lit(EMPTY_BLOOM)))


def validated(blocks: DataFrame, transactions: DataFrame, logs: DataFrame, mode: str = "minimal") -> DataFrame:
    """blocks with `valid`."""
    from chainloom.functions.keccak import block_blooms

    counted = blocks.join(tx_counts(transactions).withColumnRenamed("tx_count", "n_transactions"), KEY, "left").join(log_counts(logs).select(*KEY, F.col("log_count").alias("n_logs")), KEY, "left")
    counted = counted.na.fill(0, ["n_transactions", "n_logs"])
    if mode == "strict":
        counted = counted.join(block_blooms(logs).withColumnRenamed("logs_bloom", "computed_bloom"), KEY, "left")
    return counted.withColumn("valid", verdict(mode)).drop("n_transactions", "n_logs", "computed_bloom")
