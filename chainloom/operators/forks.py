"""Choice among competing headers: the canonical chain, and where each other branch leaves it.

Several headers may have one number. The canonical chain is that of the best header of a chain, of the greatest number and
then the least hash (or of a given head), and its ancestors by parent hash. Both questions are answered by pointer
doubling, so the rounds grow with the logarithm of the longest branch: in round k every header knows its 2^k-th ancestor.
Headers are numbered and linked once (`linked`), so rounds hold pairs of ids instead of hashes; each is a written table of two
joins, and takes the place of the one before on the disk. Nothing passes through one task.

Repeated headers count once. A header without number or hash is left out. Hashes are those of one chain; a branch whose
parents aren't stored has no ancestor. Parent hashes that form a circle end as branches without an ancestor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators.integrity import CHAIN, NUMBER
from chainloom.scratch import dropped, written

NODE = [CHAIN, "hash"]


def linked(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers as written tables: chain_id, hash, block_number, parent_hash and id, a row a header, and links: id and up, the
    parent's id, where it is stored and has the number before."""
    own = headers.where(F.col("hash").isNotNull() & F.col(NUMBER).isNotNull()).select(CHAIN, "hash", NUMBER, "parent_hash").dropDuplicates(NODE)
    nodes = written(own.withColumn("id", F.monotonically_increasing_id()))
    parents = nodes.select(CHAIN, F.col("hash").alias("parent_hash"), (F.col(NUMBER) + 1).alias(NUMBER), F.col("id").alias("up"))
    return nodes, written(nodes.select(CHAIN, "parent_hash", NUMBER, "id").join(parents, [CHAIN, "parent_hash", NUMBER]).select("id", "up"))


def heads(nodes: DataFrame) -> DataFrame:
    """id of the best header of each chain."""
    return nodes.groupBy(CHAIN).agg(F.min_by("id", F.struct((-F.col(NUMBER)).alias("n"), "hash")).alias("id")).select("id")


def doubled(jumps: DataFrame) -> DataFrame:
    """Jumps (id, up) twice as far; those that would leave the chain are gone."""
    return jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up"))


def canonical(headers: DataFrame, head: DataFrame | None = None, forest: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """chain_id, block_number, hash of the canonical chain, a written table; head: chain_id and hash, else the best header.

    forest: what `linked` made of the headers, for callers that ask more than once; it is left as it is.
    """
    nodes, links = forest or linked(headers)
    jumps, found = links, written(heads(nodes) if head is None else nodes.join(head.select(*NODE).distinct(), NODE, "left_semi").select("id"))
    while not jumps.isEmpty():  # all ancestors at a distance below 2^k are found before round k
        more, far = written(found.union(found.join(jumps, "id").select(F.col("up").alias("id")))), written(doubled(jumps))
        dropped(found, *([] if jumps is links else [jumps]))
        found, jumps = more, far
    chain = written(nodes.join(found, "id", "left_semi").select(CHAIN, NUMBER, "hash"))
    dropped(found, *([nodes, links] if forest is None else []))
    return chain


def orphans(headers: DataFrame, chain: DataFrame, forest: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """chain_id, block_number and hash of headers off the chain, with the last canonical ancestor (null if there is none), a written table."""
    nodes, links = forest or linked(headers)
    on = written(nodes.join(chain.select(*NODE), NODE, "left_semi").select("id"))
    ends = on.select(F.col("id").alias("up"), F.lit(True).alias("ends"))
    now = written(links.join(on, "id", "left_anti").join(ends, "up", "left").select("id", "up", F.coalesce("ends", F.lit(False)).alias("ends")))
    depth, rounds = nodes.count() - on.count(), 0
    while 1 << rounds <= depth and not now.where("not ends").isEmpty():
        far = now.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("ends").alias("far_ends"))
        open_ = now.where("not ends").join(far, "up").select("id", F.col("far").alias("up"), F.col("far_ends").alias("ends"))
        more = written(now.where("ends").union(open_))  # a jump that leaves the stored headers is gone
        dropped(now)
        now, rounds = more, rounds + 1
    names = nodes.join(on, "id", "left_semi").select(F.col("id").alias("up"), F.col(NUMBER).alias("ancestor"), F.col("hash").alias("ancestor_hash"))
    ancestor = now.where("ends").join(names, "up").select("id", "ancestor", "ancestor_hash")
    off = written(nodes.join(on, "id", "left_anti").join(ancestor, "id", "left").select(CHAIN, NUMBER, "hash", "ancestor", "ancestor_hash"))
    dropped(now, on, *([nodes, links] if forest is None else []))
    return off


def branches(off: DataFrame) -> DataFrame:
    """What left the chain at each ancestor: chain_id, ancestor, n_orphans, and the numbers to fetch again (start_block, end_block)."""
    return off.groupBy(CHAIN, "ancestor").agg(F.count("*").alias("n_orphans"), F.min(NUMBER).alias("start_block"), F.max(NUMBER).alias("end_block"))
