"""Blocks with their transactions, logs and traces as nested arrays, and back to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integrity import KEY

CHILDREN = {"transactions": ["transaction_index"], "logs": ["log_index"], "traces": ["transaction_index", "trace_address"]}


def assembled(blocks: DataFrame, **children: DataFrame) -> DataFrame:
    """A row a block: chain_id, block_number, block and one ordered array for each child table, empty where it has no rows.

    A group holds one block's rows, so it is bounded by a block's size. Children are grouped first and joined on the
    same keys, which keeps one exchange a table. Blocks without a header are left out.
    """
    out = blocks.select(*KEY, F.struct(*blocks.columns).alias("block"))
    for name, df in children.items():
        order = CHILDREN[name]
        rest = [c for c in df.columns if c not in order]
        item = F.struct(*order, *rest)
        rows = df.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias(name))
        out = out.join(rows, KEY, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def dealt(blocks: DataFrame, **children: DataFrame) -> DataFrame:
    """As `assembled`, by ranges of (chain_id, block_number) and in their order, for what is written so.

    The rows of all tables go through one exchange as they are given; what is wider and can be made of them is better made
    afterwards. A child's rows are ordered by its columns, from the first on; columns of the key aren't repeated in it.
    """
    tables = {"block": blocks, **{name: df.dropna(subset=KEY) for name, df in children.items()}}
    items = {name: F.struct(*[c for c in df.columns if c not in KEY]) for name, df in tables.items()}
    kinds = {name: df.select(items[name].alias("x")).schema["x"].dataType for name, df in tables.items()}
    missing = {name: F.lit(None).cast(kind) for name, kind in kinds.items()}
    rows = reduce(DataFrame.unionByName, [df.select(*KEY, *[(items if k == name else missing)[k].alias(k) for k in tables]) for name, df in tables.items()])
    lists = [F.collect_list("block").alias("block"), *[F.sort_array(F.collect_list(name)).alias(name) for name in children]]
    grouped = rows.repartitionByRange(*KEY).groupBy(*KEY).agg(*lists)
    return grouped.select(*KEY, F.explode("block").alias("block"), *children).sortWithinPartitions(*KEY)  # numbers may repeat among headers


def exploded(nested: DataFrame, name: str) -> DataFrame:
    """The rows of one kind out of assembled blocks."""
    if name == "blocks":
        return nested.select("block.*")
    return nested.select(F.explode(name).alias("r")).select("r.*")
