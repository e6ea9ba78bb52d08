"""A table of latest versions that is kept, not computed: buckets by key, and copies of the buckets that a batch touches.

`merge` sends a batch's rows to the buckets of their keys, writes these buckets anew beside the old ones and commits a map
of each bucket to its folder, as one small file; readers take the newest map, so a merge that fails or is killed leaves
nothing that is read, and running it again is safe. Tombstones stay in their buckets, since an older version of their key
may still come; `read` leaves them out, and needs neither window nor exchange. Two merges at once can't both commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.operators.latest import DELETED, VERSION
from chainloom.scratch import dropped, freed, written


def folders(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The number of the newest commit (0: none), and the folder of each bucket; "" is an empty one. A row a bucket."""
    try:
        commits = spark.read.schema("bucket int, folder string, commit bigint").parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = commits.agg(F.max("commit")).first()[0] or 0
    return newest, {r.bucket: r.folder for r in commits.where(F.col("commit") == newest).collect()}


def _stored(spark: SparkSession, places: Iterable[str]) -> DataFrame:
    return spark.read.parquet(*places)


def merge(path: str, batch: DataFrame, keys: list[str], version: Iterable[str] = (VERSION,), deleted: str = DELETED, buckets: int = 64) -> list[int]:
    """Bring a batch of versions in and return the buckets that were written.

    Of one version an insert wins over a tombstone, nulls are the least version; rows that tie in all of it have some
    order. The number of buckets is that of the first merge; one of a gigabyte or so suits tasks. Versions of a key are
    brought down to one on the map side first, so a key with very many of them in a batch is no hot partition.
    """
    spark = batch.sparkSession
    commit, held = folders(spark, path)
    held = held or dict.fromkeys(range(buckets), "")
    order = [*[F.desc(v) for v in version], F.asc(deleted)]
    best = lambda df, *by: df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rank = 1").drop("__rank")
    slot = F.pmod(F.xxhash64(*keys), F.lit(len(held))).cast("int")
    fresh = written(best(batch, *keys).withColumn("bucket", slot))
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most one a bucket
    if not touched:
        dropped(fresh)
        return []
    old = [held[b] for b in touched if held[b]]
    rows = fresh.unionByName(_stored(spark, [f"{path}/{f}" for f in old]).withColumn("bucket", slot), allowMissingColumns=True) if old else fresh
    data = f"data/{uuid.uuid4().hex}"
    with freed(spark):
        best(rows.repartition("bucket"), "bucket", *keys).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/{data}")
    now = held | {b: f"{data}/bucket={b}" for b in touched}
    spark.createDataFrame(list(now.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{path}/commits/commit={commit + 1}")
    dropped(fresh)
    return touched


def read(spark: SparkSession, path: str, deleted: str = DELETED) -> DataFrame:
    """The latest version of each key that isn't deleted."""
    _, held = folders(spark, path)
    places = [f"{path}/{f}" for f in held.values() if f]
    if not places:
        raise ValueError(f"nothing was merged into {path}")
    return _stored(spark, places).where(~F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)))
