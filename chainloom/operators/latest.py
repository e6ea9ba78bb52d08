"""Versions of rows: the latest of each key, tombstones, and batches that replace rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.scratch import written

DELETED, VERSION = "is_deleted", "insert_timestamp"


def latest(df: DataFrame, keys: Iterable[str], version: Iterable[str | Column] = (VERSION,), deleted: str | None = DELETED) -> DataFrame:
    """The row of greatest version of each key; keys whose latest row is a tombstone are gone. Nulls are the least version.

    The winner is chosen first and tombstones are dropped then. Filters on key columns pass below the window by
    themselves, others must stand above it. Of rows of one version an insert wins over a tombstone. Spark keeps only the
    first row a key on the map side, so a key with very many versions is no hot partition.
    """
    order = [F.desc(v) if isinstance(v, str) else v.desc() for v in version]
    if deleted:
        order.append(F.asc(deleted))
    best = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")
    return best.where(~F.coalesce(F.col(deleted).cast("boolean"), F.lit(False))) if deleted else best


def latest_in(versions: str, key: str, deleted: str = DELETED) -> Column:
    """Of an array column of versions in ascending order, key first, the last of each key that isn't a tombstone."""
    last = lambda x, k: ~F.coalesce(F.get(versions, k + 1)[key].eqNullSafe(x[key]) & (k + 1 < F.size(versions)), F.lit(False))
    return F.filter(versions, lambda x, k: last(x, k) & ~F.coalesce(x[deleted].cast("boolean"), F.lit(False)))


def delete_insert(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Tombstones of old rows and the rows that replace them, `op_seq` 0 and 1; inserts are a microsecond later."""
    tombs = old.withColumn(DELETED, F.lit(1).cast("tinyint")).withColumn(VERSION, at).withColumn("op_seq", F.lit(0))
    rows = new.withColumn(DELETED, F.lit(0).cast("tinyint")).withColumn(VERSION, at + F.expr("INTERVAL 1 MICROSECOND")).withColumn("op_seq", F.lit(1))
    return tombs.unionByName(rows)


def retried(first: DataFrame, retry: DataFrame, key: str, value: str = "result", error: str = "error") -> DataFrame:
    """Results by key: those of the retry stand in for failures; a key the retry doesn't have stays as it was."""
    r = retry.select(F.col(key).alias("__key"), F.col(value).alias("__value"), F.col(error).alias("__error"))
    joined = first.join(r, F.col(key) == F.col("__key"), "left")
    failed = F.col(error).isNotNull() & F.col("__key").isNotNull()
    return joined.select(key, F.when(failed, F.col("__value")).otherwise(F.col(value)).alias(value), F.when(failed, F.col("__error")).otherwise(F.col(error)).alias(error))


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with its rows' places (from 0) in an order, without a window over the whole.

    Rows are dealt in ranges and written; counts of the ranges, a row each, give where each begins, and places within a
    range are counted in its own task. Rows that tie in the order have some order.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    rows = written(ranged)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row a range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__own")).cast("bigint")).drop("__part", "__own", "__before")


def chunked(df: DataFrame, by: str, size: int) -> DataFrame:
    """df with `chunk`: `size` rows each in the order of `by`, but for the last; size 0 or less is one chunk."""
    if size <= 0:
        return df.withColumn("chunk", F.lit(0).cast("bigint"))
    return numbered(df, by, name="__place").withColumn("chunk", F.floor(F.col("__place") / size).cast("bigint")).drop("__place")
