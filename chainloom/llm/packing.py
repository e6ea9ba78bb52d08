"""Best-fit packing of token pieces into sequences of at most `capacity` tokens.

Bounded-space online best fit: a fixed number of bins is open; a bitset has a bit for each amount of free space that
some open bin has, so the tightest bin that takes a piece is one shift and one lowest bit. When no bin takes it and all
are open, the fullest is closed. Pieces are dealt by hash into groups of about `group_rows`, one task packing each; the
longest pieces of a group come first, so that short ones fill what these leave; the waste is what is left in a group's
last bins, a share that doesn't grow with the input.

A document longer than capacity is cut into pieces; the first is the shorter one, so the others fill a sequence each.
Null or empty text: one piece with the end id only. Repeated rows are packed each. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, small_batches, written
from .tokens import KEPT, encoder

CAPACITY, OPEN_BINS, GROUP_ROWS = 1024, 32_768, 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """The open bins, by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.count, self.made = capacity, limit, 0, 0
        self.free = 0  # bit f: some open bin has f tokens left
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (bin, used)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number, used = self._take(space)
        else:
            if self.count >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            number, used, space = self.made, 0, self.capacity
            self.made += 1
        if space > length:
            self.bins[space - length].append((number, used + length))
            self.free |= 1 << (space - length)
            self.count += 1
        return number, used

    def _take(self, space: int) -> tuple[int, int]:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.count -= 1
        return found


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces. kept: bound of what encoders keep."""

    @lean
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, limit=kept)
        end = np.array([end_id], "<u4")
        kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), coder.encode_all(batch.column(1))):
                ids = np.concatenate([found.astype("<u4"), end])
                ends = [*range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def cut_table(docs: DataFrame, tokenizer: str, end_id: int, kept: int = KEPT) -> DataFrame:
    """cut as a written table."""
    with small_batches(docs.sparkSession):
        return written(cut(docs, tokenizer, end_id, CAPACITY, "doc_id", "text", kept))


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            if batch.num_rows:
                at = [bins.place(n) for n in batch.column("length").to_pylist()]
                yield pa.record_batch([*batch.columns, pa.array([first + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    groups = max(1, round(pieces.count() / group_rows))
    dealt = pieces.repartition(groups, F.xxhash64("doc_id", "piece", "length", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return pack(cut_table(docs, public_tokenizers.path("byte_bpe_50k.json"), 2))
