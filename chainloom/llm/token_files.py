"""Token ids in Arrow files of equal-length sequences.

A part file is an Arrow IPC file whose batches hold two fixed-size-list columns, `ids` (the smallest unsigned integers
that fit the vocabulary) and `mask` (true for real tokens): the stream of all its documents' ids, cut every seq_len
tokens, only the last sequence being padded. Any sequence is found by arithmetic and read without a copy. Beside it an
index file lists doc_id, start in the part, n_tokens. Documents are range-partitioned, so parts are in ascending doc_id
order; what stands before a part is a sum over a manifest with one row a part. The number of parts
follows from the counted bytes of the texts.

A task writes files under names of its own and reports them as its result, so those of lost or doubled attempts are
never read. Null text: no ids but the end id. Equal doc_ids: in the order of their texts. Empty table: no files, no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_dir, written
from .tokens import encoder

SEQ_LEN, BATCH, PART_BYTES = 1024, 256, 256 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class PartWriter:
    """One part: ids are appended, full batches go to the file; memory holds one batch."""

    def __init__(self, uri: str, dtype: np.dtype, seq_len: int = SEQ_LEN):
        self.files, self.base = pafs.FileSystem.from_uri(uri)
        self.files.create_dir(self.base, recursive=True)
        self.name, self.dtype, self.seq_len = uuid.uuid4().hex, dtype, seq_len
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = self.files.open_output_stream(f"{self.base}/{self.name}.arrow")
        self.data = pa.ipc.new_file(self.out, self.schema)
        self.index_out = self.files.open_output_stream(f"{self.base}/{self.name}.index.arrow")
        self.index = pa.ipc.new_file(self.index_out, INDEX)
        self.held: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []
        self.n_held = self.total = self.n_docs = 0

    def append(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.held.append(ids)
        self.n_held, self.total, self.n_docs = self.n_held + len(ids), self.total + len(ids), self.n_docs + 1
        if self.n_held >= BATCH * self.seq_len:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        ids, size = np.concatenate([*self.held, np.zeros(0, self.dtype)]).astype(self.dtype), BATCH * self.seq_len
        while len(ids) >= size or (last and len(ids)):
            now, ids = ids[:size], ids[size:]
            rows = -(-len(now) // self.seq_len)
            full = np.zeros(rows * self.seq_len, self.dtype)
            full[: len(now)] = now
            mask = np.arange(rows * self.seq_len) < len(now)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (full, mask)]
            self.data.write_batch(pa.record_batch(columns, schema=self.schema))
        self.held, self.n_held = [ids], len(ids)

    def _flush_index(self) -> None:
        if self.docs:
            self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.docs)], schema=INDEX))
        self.docs = []

    def close(self) -> dict:
        self._flush(True)
        self._flush_index()
        for x in (self.data, self.out, self.index, self.index_out):
            x.close()
        return {"name": self.name, "n_docs": self.n_docs, "n_tokens": self.total}


class PartReader:
    """Random access to the sequences and documents of a part; local files are mapped, and arrays are views of them."""

    def __init__(self, uri: str, name: str):
        files, base = pafs.FileSystem.from_uri(uri)
        local = isinstance(files, pafs.LocalFileSystem)
        self.files, self.base, self.name = files, base, name
        self.opened = lambda p: pa.memory_map(p) if local else files.open_input_file(p)
        self.data = pa.ipc.open_file(self.opened(f"{base}/{name}.arrow"))
        self.seq_len = self.data.schema.field("ids").type.list_size
        self._at, self._ids = -1, np.zeros(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._ids = k, self.data.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)
        return self._ids

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The i-th sequence's ids and mask, both views of the file; the mask stays packed, a bit a token."""
        k, j = divmod(i, BATCH)
        return self._batch(k)[j * self.seq_len : (j + 1) * self.seq_len], self.data.get_batch(k).column(1)[j].values

    def n_real(self) -> int:
        """How many tokens the masks mark, which all documents together must have."""
        return sum(pc.sum(self.data.get_batch(k).column(1).values).as_py() for k in range(self.data.num_record_batches))

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids start .. start + n, a batch at a time."""
        size = BATCH * self.seq_len
        while n > 0:
            k, j = divmod(start, size)
            view = self._batch(k)[j : j + n]
            yield view
            start, n = start + len(view), n - len(view)

    def documents(self) -> Iterator[tuple[int, int, int]]:
        index = pa.ipc.open_file(self.opened(f"{self.base}/{self.name}.index.arrow"))
        for k in range(index.num_record_batches):
            yield from zip(*(c.to_pylist() for c in index.get_batch(k).columns))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs below path (a URI that all executors see); returns the manifest: part, name, n_docs, n_tokens, base."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, coder = None, encoder(tokenizer)
        end = np.array([end_id], coder.dtype)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = out or PartWriter(path, coder.dtype)
                out.append(doc_id, np.concatenate([coder.encode(text.as_py()), end]))
        if out:
            row = {"part": TaskContext.get().partitionId()} | out.close()
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = written(rows.mapInArrow(write, "part long, name string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (in the whole stream), n_tokens and ids_crc32 of every document, from the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part, held, total = PartReader(path, name), [], 0
                for doc_id, start, n in part.documents():
                    crc, total = 0, total + n
                    for view in part.tokens(start, n):
                        crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                    held.append((doc_id, base + start, n, crc))
                    if len(held) >= 10_000:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        held = []
                if total != part.n_real():
                    raise ValueError(f"{name}: documents have {total} tokens, masks {part.n_real()}")
                if held:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = manifest.select("name", "base").repartition(max(1, manifest.count()))  # a task a file
    return parts.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    manifest = write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_documents(manifest, path)
