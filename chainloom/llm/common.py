"""Shared pieces: scratch tables in the cluster's shared folder, word rules, native text helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.scratch import shared_dir

#: Words are runs of anything but space and \t \n \x0b \f \r; bytes.split() has exactly these separators.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def written(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again: it cuts lineage and outlives executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What this process keeps for later tasks, by maker and arguments, and the function of the last task.
_kept: dict[tuple, object] = {}
_last: list[str] = []


def keep(make: Callable, *args):
    """make(*args), made once a process and kept until a `lean` task of another function begins in it."""
    key = (make.__qualname__, *args)
    if key not in _kept:
        _kept[key] = make(*args)
    return _kept[key]


def begin(name: str) -> None:
    """A task of this function begins: what tasks of another one kept goes."""
    if _last != [name]:
        _kept.clear()
        _last[:] = [name]


def lean(rows: Callable) -> Callable:
    """rows, a function of mapInArrow or an iterator of arrow_udf, that gives freed memory back to the system when its task ends.

    Python workers are kept for later tasks, so what the allocators hold back would add to what later stages take, and so
    would what earlier stages kept.
    """

    @wraps(rows)
    def run(batches):
        begin(f"{rows.__module__}.{rows.__qualname__}")
        try:
            yield from rows(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return run


#: Bytes of an Arrow batch of texts, up to which Spark adds rows to it.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of about BATCH_BYTES; the session's own bound returns after.

    By Spark's defaults a batch has 10,000 rows or 64 MB, and for each running task it is held both by the executor's
    JVM, outside of the heap, and by the Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of a side that may be broadcast; such rows hold a few numbers or a digest, about 250 bytes each in a hash table.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """df, a written table of narrow rows, to be joined: broadcast if it has at most BROADCAST_ROWS counted rows.

    Beyond that it is shuffled. Being read from files it has no grouping of its own, so the other side is a plain shuffle
    and adaptive execution can split a frequent key of it; a join with an aggregate on the same key can't be split.
    """
    if df.count() <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df.hint("merge")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array of strings; of null: empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def given(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df with further columns that are computed once a row.

    A projection may be merged into lambdas above it and then be evaluated once an element; a generator isn't merged.
    """
    one = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return df.select(*keep, F.inline(one))


#: 64-bit values of bytes, the base of the polynomial over a word's bytes and its inverse.
BYTE_VALUES = np.random.default_rng(2026).integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
IS_SPACE = np.isin(np.arange(256), [*SPACES.encode()])
HASHED_BYTES = 1 << 20
_separator = re.compile(SPACE.encode())
_powers = {x: np.ones(1, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base, kept for further texts."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text start and end, and a 64-bit hash of each, without making the words: differences of running sums over its bytes.

    Longer texts than HASHED_BYTES go by parts that end at a separator; a word's hash doesn't depend on its place.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(text) > HASHED_BYTES:
        cuts = [0]
        while cuts[-1] < len(text):
            cut = _separator.search(text, cuts[-1] + HASHED_BYTES // 2)
            cuts.append(cut.end() if cut else len(text))
        if len(cuts) > 2:
            parts = [(a, *word_hashes(text[a:b])) for a, b in zip(cuts, cuts[1:])]
            return np.concatenate([a + x for a, x, _, _ in parts]), np.concatenate([a + x for a, _, x, _ in parts]), np.concatenate([x for *_, x in parts])
    b = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], IS_SPACE[b], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[b] * powers(BASE, len(b)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), len(b))[starts]
    return starts, ends, out ^ (out >> np.uint64(32))


def text_hashes(text: bytes) -> np.ndarray:
    """The hash of each word of a text, by `word_hashes`."""
    return word_hashes(text)[2]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive items."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DIGIT = re.compile("[0-9]")
