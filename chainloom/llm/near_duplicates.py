"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

One hash of each n-gram deals a set into bins and orders each bin: a bin's least hash is its value. An empty bin takes the
value of the first bin with one in an order that the bin itself gives all bins at random (the same for every set), so two
sets still agree in a bin as often as they are similar. `ROWS` values make a band; sets that agree in a band share its
bucket. With 32 bands of 4 rows a pair of similarity s shares no band with a probability of (1 - s^4)^32: 5e-8 at 0.8.

A bucket gives a star: each member with its least one. Sizes and parity sketches drop pairs that can't link; the others are
confirmed on full sets, and linked components are found. Where a bucket's star leaves several components, pairs of members
of different ones are compared by size and sketch, in blocks, and confirmed alike: no link of a bucket is lost, and pairs
stay bounded where copies are many. Equal sets are one node from the start.

Null or empty texts and texts without words have an empty set and link with nothing. Fewer words than n: the whole
sequence is one n-gram. Rows that repeat an id are one node. Null ids get a null component and are kept. Empty table: no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read, written
from .jaccard_join import Order, grouped, same_sets, sketches

BANDS, ROWS = 32, 4


def donors(bins: int) -> np.ndarray:
    """[i, j]: the place of bin j in the order in which an empty bin i asks the others."""
    return np.argsort(np.random.default_rng(13).random((bins, bins)), 1).argsort(1)


def signature(s: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A value for each bin of a set that isn't empty; s: sorted hashes with the highest bit set, so bins are stretches of it."""
    bins = len(places)
    bits = bins.bit_length() - 1  # bins are a power of two
    starts = np.searchsorted(s, np.uint64(1 << 63) + (np.arange(bins, dtype=np.uint64) << np.uint64(63 - bits)))
    full = np.diff(starts, append=len(s)) > 0
    values = s[np.minimum(starts, len(s) - 1)]
    if not full.all():
        some = np.flatnonzero(full)
        values[~full] = values[some[places[np.ix_(~full, full)].argmin(1)]]
    return values


def bands(n_bands: int, rows: int) -> Callable[[np.ndarray], np.ndarray]:
    """The bucket keys of a set, one a band; none of an empty set."""
    places = donors(n_bands * rows)

    def keys(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        parts = signature(s, places).reshape(n_bands, rows)
        out = np.arange(n_bands, dtype=np.uint64)
        for k in range(rows):
            out = (out ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    return keys


def full_links(stored: list[np.ndarray], probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(stored set, probes whose Jaccard similarity with it reaches percent), of sets that aren't empty."""
    sizes = np.array([len(s) for s in stored])
    items, starts = np.concatenate(stored), np.cumsum(sizes) - sizes
    near = np.zeros((len(stored), len(probes)), bool)
    for p, probe in enumerate(probes):
        both = np.add.reduceat(probe[np.minimum(np.searchsorted(probe, items), len(probe) - 1)] == items, starts)
        near[:, p] = 100 * both >= percent * (sizes + len(probe) - both)
    for k in np.flatnonzero(near.any(1)):
        yield int(k), np.flatnonzero(near[k])


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, n_bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id that links lead to) and kept (whether that is its own)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = written(sketches(docs, n, bands(n_bands, rows)))
    sets = table.where("size > 0 and id is not null")
    copies = same_sets(sets)
    groups = grouped(docs, sets.join(bounded(copies), "id", "left_anti"), n, percent, Order(np.zeros(0, np.uint64)), full_links, count_shared=False)
    out = table.select("id", "size").join(bounded(copies), "id", "left").withColumn("own", F.coalesce("rep", "id"))
    out = out.join(bounded(groups), F.col("own") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "own"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", kept.alias("kept"))


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), n=2, percent=80)
