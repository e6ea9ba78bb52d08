"""A committing sink of staged blocks, as a Spark data source: format "chain_staged".

    spark.dataSource.register(ChainStaged)
    staged.write.format("chain_staged").option("path", uri).mode("append").save()

A task writes its rows, which come ordered by chain and number (`write` deals them so), to files that are rolled by
`max_file_bytes`. A file is named by what it holds, data/chain_<id>/year=<yyyy>/<task>/blocks_<start>_<end>.parquet, the year
being that of its first block; its SHA-256 is computed as it is written. Numbers are checked in the task, and once more
between files when all tasks are done: with gaps=fail (the default) a hole or a repeat fails the write, with gaps=allow
holes may stand but repeats fail.

What counts is the manifest: one file of a row a data file, manifest/<write>.json, which the commit puts in place when all
tasks are done. Readers take their files from manifests only. So a task that dies, runs twice or is aborted leaves nothing
that is read; the abort removes the files of tasks that had ended, and `orphans` finds what lost executors left behind.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from chainloom.schemas import STAGED
from chainloom.scratch import freed
from chainloom.sources.staging import StagingError, scan, surviving

MANIFEST = "file string, chain_id bigint, start_block bigint, end_block bigint, n_blocks bigint, bytes bigint, text_bytes bigint, sha256 string, write string"
TEXTS = ("block_json", "transactions_json", "logs_json", "traces_json")
MAX_FILE_BYTES, GROUP_BYTES = 512 << 20, 8 << 20


class Hashed:
    """An output stream with the digest of what went through it."""

    def __init__(self, out):
        self.out, self.sha, self.closed, self.at = out, hashlib.sha256(), False, 0

    def write(self, data) -> int:
        data = bytes(data)
        self.sha.update(data)
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.out.flush()

    def writable(self) -> bool:
        return True

    readable = seekable = lambda self: False

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.out.close()


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, as rows of the manifest."""

    files: list[dict] = field(default_factory=list)


class TaskFiles:
    """The files of one task: a row group for each GROUP_BYTES of text, a new file beyond max_bytes or for another chain."""

    def __init__(self, uri: str, schema: pa.Schema, max_bytes: int, gaps: bool):
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.schema, self.max_bytes, self.gaps, self.task = schema, max_bytes, gaps, uuid.uuid4().hex
        self.done: list[dict] = []
        self.open: dict | None = None
        self.last: tuple[int, int] | None = None
        self.held: list[pa.RecordBatch] = []
        self.held_bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows of a batch, checked against those before them."""
        chains, numbers = batch.column("chain_id").to_pylist(), batch.column("block_number").to_pylist()
        low = 0
        for k, at in enumerate(zip(chains, numbers)):
            if None in at:
                raise StagingError(f"a row without chain or number: {at}")
            if self.last and at[0] == self.last[0]:
                if at[1] <= self.last[1] or not self.gaps and at[1] != self.last[1] + 1:
                    raise StagingError(f"chain {at[0]}: block {at[1]} after {self.last[1]}")
            elif self.last:
                if at[0] < self.last[0]:
                    raise StagingError(f"chain {at[0]} after {self.last[0]}")
                self._hold(batch.slice(low, k - low))
                self.end()
                low = k
            self.last = at
        self._hold(batch.slice(low))

    def _hold(self, rows: pa.RecordBatch) -> None:
        step = max(1, rows.num_rows * GROUP_BYTES // max(1, rows.nbytes))
        for k in range(0, rows.num_rows, step):
            part = rows.slice(k, step)
            self.held.append(part)
            self.held_bytes += part.nbytes
            if self.held_bytes >= GROUP_BYTES:
                self._group()
                if self.open["out"].at >= self.max_bytes:
                    self.end()

    def _group(self) -> None:
        rows = pa.Table.from_batches(self.held, self.schema)
        self.held, self.held_bytes = [], 0
        if not rows.num_rows:
            return
        numbers = rows.column("block_number")
        if self.open is None:
            chain = rows.column("chain_id")[0].as_py()
            year = datetime.fromtimestamp(rows.column("block_timestamp")[0].as_py() or 0, timezone.utc).year
            folder = f"data/chain_{chain}/year={year}/{self.task}"
            self.fs.create_dir(f"{self.base}/{folder}", recursive=True)
            name = f"{folder}/part-{len(self.done)}"
            out = Hashed(self.fs.open_output_stream(f"{self.base}/{name}", compression=None))
            self.open = {"name": name, "folder": folder, "chain_id": chain, "start_block": numbers[0].as_py(), "n_blocks": 0, "text_bytes": 0, "out": out, "writer": pq.ParquetWriter(out, self.schema, compression="zstd")}
        self.open["writer"].write_table(rows)
        self.open["end_block"] = numbers[-1].as_py()
        self.open["n_blocks"] += rows.num_rows
        self.open["text_bytes"] += sum(pc.sum(pc.binary_length(rows.column(c))).as_py() or 0 for c in TEXTS)

    def end(self) -> None:
        """Close the file and give it the name of its range."""
        if self.held:
            self._group()
        if self.open is None:
            return
        now, self.open = self.open, None
        now["writer"].close()
        now["out"].close()
        name = f"{now['folder']}/blocks_{now['start_block']}_{now['end_block']}.parquet"
        self.fs.move(f"{self.base}/{now['name']}", f"{self.base}/{name}")
        self.done.append({"file": name, "bytes": now["out"].at, "sha256": now["out"].sha.hexdigest()} | {k: now[k] for k in ("chain_id", "start_block", "end_block", "n_blocks", "text_bytes")})

    def drop(self) -> None:
        """Remove all that this task wrote."""
        if self.open:
            self.open["out"].close()
        for folder in {f["file"].rpartition("/")[0] for f in self.done} | ({self.open["folder"]} if self.open else set()):
            self.fs.delete_dir(f"{self.base}/{folder}")


class Writer(DataSourceArrowWriter):
    def __init__(self, options, schema):
        self.uri, self.gaps = options["path"].rstrip("/"), {"allow": True, "fail": False}[options.get("gaps", "fail")]
        self.max_bytes, self.name = int(options.get("max_file_bytes", MAX_FILE_BYTES)), options.get("write", uuid.uuid4().hex)
        wanted = [c.split(" ")[0] for c in STAGED.split(", ")]
        if sorted(schema.names) != sorted(wanted):
            raise StagingError(f"staged rows have columns {wanted}, not {schema.names}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = None
        try:
            for batch in iterator:
                if batch.num_rows:
                    files = files or TaskFiles(self.uri, batch.schema, self.max_bytes, self.gaps)
                    files.add(batch)
            if files:
                files.end()
        except BaseException:
            if files:
                files.drop()
            raise
        return Written(files.done if files else [])

    def commit(self, messages: list[Written | None]) -> None:
        """Check the files against each other, then put the manifest of this write in place at once."""
        found = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["chain_id"], f["start_block"]))
        for x, y in zip(found, found[1:]):
            if x["chain_id"] == y["chain_id"] and (y["start_block"] <= x["end_block"] or not self.gaps and y["start_block"] != x["end_block"] + 1):
                self.abort(messages)
                raise StagingError(f"chain {x['chain_id']}: blocks from {y['start_block']} after {x['end_block']}")
        fs, base = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(f"{base}/manifest", recursive=True)
        lines = "".join(json.dumps(f | {"write": self.name}) + "\n" for f in found)
        with fs.open_output_stream(f"{base}/manifest/_{self.name}", compression=None) as out:
            out.write(lines.encode())
        fs.move(f"{base}/manifest/_{self.name}", f"{base}/manifest/{self.name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        for folder in {f["file"].rpartition("/")[0] for m in messages if m for f in m.files}:
            fs.delete_dir(f"{base}/{folder}")


class ChainStaged(DataSource):
    @classmethod
    def name(cls):
        return "chain_staged"

    def schema(self):
        return STAGED

    def writer(self, schema, overwrite):
        if overwrite:
            raise StagingError("staged files are only appended to")
        return Writer(self.options, schema)


def write(staged: DataFrame, uri: str, gaps: str = "fail", max_file_bytes: int = MAX_FILE_BYTES, name: str | None = None, dealt: bool = False) -> DataFrame:
    """Write staged rows below uri and return its manifest. A write of the same name replaces nothing that is read: it fails
    if blocks repeat within it, and its manifest takes the place of the earlier one.

    dealt: rows come by ranges of chain and number and in their order (`blocks.dealt`), so their texts need no exchange;
    if they don't, the checks within and between files fail the write.
    """
    staged.sparkSession.dataSource.register(ChainStaged)
    columns = [c.split(" ")[0] for c in STAGED.split(", ")]
    rows = staged.select(columns)
    rows = rows if dealt else rows.repartitionByRange("chain_id", "block_number").sortWithinPartitions("chain_id", "block_number")
    options = {"path": uri, "gaps": gaps, "max_file_bytes": str(max_file_bytes)} | ({"write": name} if name else {})
    with freed(staged.sparkSession):
        rows.write.format("chain_staged").options(**options).mode("append").save()
    return manifest(staged.sparkSession, uri)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """The files that committed writes made; none where nothing was written."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{uri.rstrip('/')}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    return rows.withColumn("file", F.concat(F.lit(uri.rstrip("/") + "/"), "file"))


def committed(spark: SparkSession, uri: str, cursor: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """Staged rows of committed files; with a cursor only files that can hold later blocks are read, and rows from it on."""
    files = manifest(spark, uri) if files is None else files
    files = files if cursor is None else surviving(files, cursor - 1)
    paths = [r.file for r in files.select("file").collect()]  # a name a file, as Spark's own listing holds
    return scan(spark, paths, cursor) if paths else spark.createDataFrame([], STAGED)


def orphans(spark: SparkSession, uri: str) -> DataFrame:
    """path and length of files that no manifest has: of writes under way, or left by lost tasks."""
    return listed(spark, f"{uri.rstrip('/')}/data").join(manifest(spark, uri).select(F.regexp_replace("file", "^file:/+", "/").alias("key")), F.regexp_replace("path", "^file:/+", "/") == F.col("key"), "left_anti")


def listed(spark: SparkSession, uri: str, pattern: str = "*") -> DataFrame:
    """path and length of all files below a prefix; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(uri)
    return files.select("path", "length")


def footers(files: DataFrame, column: str = "path") -> DataFrame:
    """chain_id, start_block, end_block, n_blocks and bytes of Parquet files of any writer, from their footers alone, read in tasks.

    A footer without statistics of the two columns gives nulls for them. A file that isn't Parquet fails the job.
    """
    out = "path string, chain_id bigint, start_block bigint, end_block bigint, n_blocks bigint, bytes bigint"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    meta, size = pq.ParquetFile(f).metadata, f.size()
                place = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
                seen: dict[str, list] = {"chain_id": [], "block_number": []}
                for name, values in seen.items():
                    for g in range(meta.num_row_groups if name in place else 0):
                        stats = meta.row_group(g).column(place[name]).statistics
                        values += [stats.min, stats.max] if stats and stats.has_min_max else [None]
                known = {k: None in v or not v for k, v in seen.items()}
                chain = None if known["chain_id"] or min(seen["chain_id"]) != max(seen["chain_id"]) else seen["chain_id"][0]
                low, high = (None, None) if known["block_number"] else (min(seen["block_number"]), max(seen["block_number"]))
                yield pa.RecordBatch.from_pylist([{"path": path, "chain_id": chain, "start_block": low, "end_block": high, "n_blocks": meta.num_rows, "bytes": size}], pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("chain_id", "start_block", "end_block", "n_blocks", "bytes"))]))

    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select(F.col(column).alias("path")).repartition(parts, "path").mapInArrow(rows, out)


def overlapping(files: DataFrame, low: int, high: int) -> DataFrame:
    """Files that may hold blocks of low .. high: their range meets it or isn't known."""
    return files.where(F.col("start_block").isNull() | ((F.col("start_block") <= high) & (F.col("end_block") >= low)))


def mean_block_bytes(files: DataFrame) -> DataFrame:
    """chain_id and the mean bytes of the texts of a block, from the manifest."""
    return files.groupBy("chain_id").agg((F.sum("text_bytes") / F.sum("n_blocks")).alias("mean_bytes"))
