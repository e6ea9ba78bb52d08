"""Connected components of an edge table, by hooking and contraction.

Each round, every node with a lesser neighbour hooks to the least one: a grouped minimum, the round's only shuffle as long
as tables stay below the counted bound of broadcasts. Hooks are followed to their ends by joins of that table with itself,
which halve the way each, and edges become edges between those ends; those within one are left out. A node that remains for
two rounds takes in another one, so the rounds grow with the logarithm of the nodes at most. Minima are written before they
are joined, so that adaptive execution can split a node with very many neighbours. Rounds are written tables in the shared
folder. The driver sees two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, written


def _ends(hooks: DataFrame) -> DataFrame:
    """u and the end of its way by hooks (u, v), of all u, a written table."""
    now = hooks
    while True:
        further = bounded(now.select(F.col("u").alias("v"), F.col("v").alias("next")))
        now = written(now.select("u", "v").join(further, "v", "left").select("u", F.coalesce("next", "v").alias("v"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("u", "v")


def _led(rows: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns hold the ends of what they held."""
    for c in columns:
        to = bounded(ends.select(F.col("u").alias(c), F.col("v").alias("end")))
        rows = rows.join(to, c, "left").withColumn(c, F.coalesce("end", c)).drop("end")
    return rows


def _edges(edges: DataFrame) -> DataFrame:
    """The edges (u, v) whose ends differ, the greater one first, a written table."""
    return written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))


def components(edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """node and component (its least node) of every node that has an edge, a written table. Null ends are left out.

    known: such a table of other edges, which count too.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    found = None  # u and its component's least node so far, of all nodes that hooked
    if known is not None:
        found = known.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v")
        now = _led(now, found, "u", "v")
    now = _edges(now)
    while now.limit(1).count():
        ends = _ends(written(now.groupBy("u").agg(F.min("v").alias("v"))))
        found = ends if found is None else written(_led(found, ends, "v").select("u", "v").union(ends))
        now = _edges(_led(now, ends, "u", "v"))
    if found is None:
        found = now
    return written(found.union(found.select("v").distinct().select("v", "v")).toDF("node", "component"))
