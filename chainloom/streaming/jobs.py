"""Streams and jobs over blocks: files or an endpoint to messages, messages to tables, repair of ranges, and cursors.

A micro-batch is the unit of order: it is checked to be contiguous and to follow the cursor, then written once under its
batch number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainloom.operators.blocks import assembled
from chainloom.operators.integrity import contiguous, reorg_plan
from chainloom.operators.latest import chunked, latest
from chainloom.schemas import STAGED
from chainloom.sources.staging import decoded

from .publish import materialised, messages, replacement

CURSOR = "chain_id bigint, name string, value bigint, version bigint"
WINDOW = 100


class OrderError(RuntimeError):
    """Blocks that don't follow the cursor without a gap."""


class Cursors:
    """Named positions by chain, as a small table that is only appended to; the greatest version counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], CURSOR).write.mode("append").parquet(path)

    def table(self) -> DataFrame:
        return latest(self.spark.read.schema(CURSOR).parquet(self.path), ["chain_id", "name"], ["version", "value"], deleted=None)

    def get(self, chain_id: int, name: str) -> int:
        """The position, 0 if there is none."""
        row = self.table().where((F.col("chain_id") == chain_id) & (F.col("name") == name)).select("value").first()
        return row.value if row else 0

    def set(self, chain_id: int, name: str, value: int) -> None:
        rows = self.spark.read.schema(CURSOR).parquet(self.path).where((F.col("chain_id") == chain_id) & (F.col("name") == name))
        version = (rows.agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(chain_id, name, value, version)], CURSOR).coalesce(1).write.mode("append").parquet(self.path)


def next_block(stored: DataFrame, chain_id: int, start: int | None = None) -> int:
    """One after the greatest stored number; a start only moves it forward."""
    most = stored.where(F.col("chain_id") == chain_id).agg(F.max("block_number")).first()[0]
    return max(-1 if most is None else most, -1 if start is None else start - 1) + 1


def checked(blocks: DataFrame, cursor: int | None) -> int | None:
    """The number after the last of a batch; raises OrderError if it has gaps or repeats or doesn't begin at the cursor."""
    row = blocks.agg(F.min("block_number").alias("a"), F.max("block_number").alias("b")).first()
    if row.a is None:
        return cursor
    if (cursor is not None and row.a != cursor) or not all(r.contiguous for r in contiguous(blocks).collect()):
        raise OrderError(f"blocks {row.a} to {row.b} don't follow {cursor} without a gap")
    return row.b + 1


def publish_files(spark: SparkSession, source: str, sink: str, checkpoint: str, cursors: Cursors, chain_id: int, files_per_trigger: int = 2) -> StreamingQuery:
    """Staged files to message files: what stands below the cursor is skipped, and each batch moves the cursor."""

    def batch(df: DataFrame, number: int) -> None:
        at = cursors.get(chain_id, f"published_{number - 1}" if number else "start")
        rows = df.where((F.col("chain_id") == chain_id) & (F.col("block_number") >= at)).persist()
        try:
            after = checked(rows, at if number or at else None)
            messages(decoded(rows), F.current_timestamp()).write.mode("overwrite").parquet(f"{sink}/batch={number}")
            cursors.set(chain_id, f"published_{number}", at if after is None else after)
        finally:
            rows.unpersist()

    files = spark.readStream.schema(STAGED).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def materialise(nested: DataFrame, path: str, batch: int, tables: tuple[str, ...] = ("blocks", "transactions", "logs", "traces")) -> None:
    """Append assembled blocks to the tables below path; the same batch again replaces itself."""
    for name in tables:
        if name == "blocks" or name in nested.columns:
            materialised(nested, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def poll(spark: SparkSession, options: dict[str, str], handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Blocks of an endpoint as they come: handle(raw rows, batch number) for each stretch of at most max_blocks_per_trigger."""
    from chainloom.sources.rpc import ChainRpc

    spark.dataSource.register(ChainRpc)
    return spark.readStream.format("chain_rpc").options(**options).load().writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def reorg_window(last_valid: int, greatest: int, lag: int = 500, size: int = WINDOW) -> tuple[int, int] | None:
    """The range to check, or None as long as it would be shorter than size."""
    start = max(last_valid - 1, 1)
    end = min(greatest - lag, start + size)
    return (start, end) if end - start >= size else None


def requested(spark: SparkSession, numbers: list[int], cursor: int, skip_check: bool = False, size: int = 10) -> DataFrame:
    """Distinct asked-for numbers above the cursor (all with skip_check), with the number of their batch."""
    rows = spark.createDataFrame([(n,) for n in numbers], "block_number bigint").distinct()  # a request's own list
    rows = rows if skip_check else rows.where(F.col("block_number") > cursor)
    return chunked(rows, "block_number", size).withColumnRenamed("chunk", "batch")


def last_valid(cursors: Cursors, blocks: DataFrame, chain_id: int, now: str | None = None) -> int:
    """The cursor of checked blocks; where there is none yet, the last block that is a day old."""
    at = cursors.get(chain_id, "last_valid")
    if at > 0:
        return at
    time = blocks.schema["block_timestamp"].dataType.simpleString()
    day_ago = (F.lit(now) if now else F.current_timestamp()).cast(time) - F.expr("INTERVAL 1 DAY")
    return blocks.where((F.col("chain_id") == chain_id) & (F.col("block_timestamp") <= day_ago)).agg(F.max("block_number")).first()[0] or 0


def stored(tables: dict[str, DataFrame], chain_id: int, numbers: DataFrame) -> DataFrame:
    """The stored blocks of some numbers (block_number), assembled with their children."""
    own = {k: df.where(F.col("chain_id") == chain_id).join(numbers.select("block_number").distinct(), "block_number", "left_semi") for k, df in tables.items()}
    return assembled(own.pop("blocks"), **own)


def replaced(tables: dict[str, DataFrame], new: DataFrame, chain_id: int, numbers: DataFrame, sink: str, at: Column) -> None:
    """Write the replacement of some numbers: tombstones of what is stored, and new blocks, in one write below sink."""
    old = stored(tables, chain_id, numbers)
    children = [c for c in ("transactions", "logs", "traces") if c in old.columns and c in new.columns]
    columns = ["chain_id", "block_number", "block", *children]
    replacement(old.select(columns), new.select(columns), at).write.mode("overwrite").parquet(sink)


def reorganise(
    tables: dict[str, DataFrame], cursors: Cursors, chain_id: int, fetch: Callable[[int, int], DataFrame], sink: str, at: Column | None = None, lag: int = 500, size: int = WINDOW, now: str | None = None
) -> tuple[int, int] | None:
    """Check the next window of stored blocks and replace what is wrong; the range that was replaced, or None.

    fetch(start, end) gives new assembled blocks. The cursor moves after the write, so a run that failed is done again
    and overwrites what it wrote: a range has its own folder.
    """
    blocks = tables["blocks"]
    greatest = blocks.where(F.col("chain_id") == chain_id).agg(F.max("block_number")).first()[0]
    window = reorg_window(last_valid(cursors, blocks, chain_id, now), greatest or 0, lag, size)
    if window is None:
        return None
    plan = reorg_plan(blocks, tables["transactions"], tables["logs"], *window, chain_id).first()
    span = None
    if plan.end_block >= 0:
        span = (plan.start_block, plan.end_block)
        numbers = blocks.sparkSession.range(span[0], span[1] + 1).withColumnRenamed("id", "block_number")
        replaced(tables, fetch(*span), chain_id, numbers, f"{sink}/range={span[0]}_{span[1]}", F.current_timestamp() if at is None else at)
    cursors.set(chain_id, "last_valid", plan.last_valid)
    return span


def repair(
    tables: dict[str, DataFrame], cursors: Cursors, chain_id: int, numbers: list[int], fetch: Callable[[list[int]], DataFrame], sink: str, at: Column | None = None, skip_check: bool = False, size: int = 10
) -> int:
    """Replace asked-for blocks in batches, and say how many batches there were.

    Numbers up to the cursor "repaired" have been done and are skipped. Each batch fetches, writes and then moves the cursor;
    with skip_check all are done and the cursor stays. fetch(numbers) gives new assembled blocks; one that it doesn't have
    fails the batch before anything is written.
    """
    spark = cursors.spark
    rows = requested(spark, numbers, cursors.get(chain_id, "repaired"), skip_check, size)
    batches: dict[int, list[int]] = {}
    for r in rows.orderBy("block_number").collect():  # a request's own list
        batches.setdefault(r.batch, []).append(r.block_number)
    for batch in batches.values():
        new = fetch(batch)
        found = {r.block_number for r in new.select("block_number").collect()}
        if missing := sorted(set(batch) - found):
            raise OrderError(f"blocks {missing} weren't fetched")
        asked = spark.createDataFrame([(n,) for n in batch], "block_number bigint")
        replaced(tables, new, chain_id, asked, f"{sink}/range={batch[0]}_{batch[-1]}", F.current_timestamp() if at is None else at)
        if not skip_check:
            cursors.set(chain_id, "repaired", batch[-1])
    return len(batches)
