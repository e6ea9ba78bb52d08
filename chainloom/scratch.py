"""Folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Only where the session names none and runs on one machine (tests) a local temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = getattr(spark, "_chainloom_scratch", None)
        if base is None:
            base = spark._chainloom_scratch = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/chainloom-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again: it cuts lineage and outlives executors."""
    path = shared_dir(df.sparkSession)
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._chainloom_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Give the disk of written tables back, once nothing is read from them or from what was made of them."""
    for table in tables:
        table.sparkSession.createDataFrame([], table.schema).coalesce(1).write.mode("overwrite").parquet(table._chainloom_path)
