"""WARC archives: writing with revisits and segments, and reading with segment reassembly.

Writing: the response of each payload of at least `min_revisit` bytes is the row with the largest id; the others are
revisit records that refer to it. HTTP bodies are framed in chunks; a block longer than `segment` bytes is split into a
first segment and continuation records. Each record is a gzip member of its own.

Reading: continuation records are grouped by the origin's identifier and put in order of their segment numbers; the
total length they state is checked, then the HTTP header is taken off and the chunked framing decoded. A record whose
segments are missing, doubled unequally or of another total length is reported with a null payload. Groups are the
segments of one record, so they are bounded by one record's size.

Null html: empty payload. Equal payloads below the bound are all responses. Null or repeated ids: each row is a record;
rows with a null id, and all that repeat a payload's largest id, are responses. Empty table: no archives, no rows.

A response that others revisit is named by its id and digest, and WARC-Refers-To names it; where several rows repeat that
id and payload the name would not be unique, so they get names of their own and revisits state the page's id only.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, read, shared_dir, written

MIN_REVISIT, SEGMENT, CHUNK = 1000, 16_384, 4096
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(payload) -> F.Column:
    """Bare lower-case hex SHA-1."""
    return F.sha1(payload)


def chunked(body: bytes) -> bytes:
    parts = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of chunked transfer framing; raises ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if len(data) < end + 4 + size:
            raise ValueError("chunk cut short")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes | None) -> bytes | None:
    """The payload of an HTTP response block; None if it isn't whole."""
    if block is None:
        return None
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    try:
        return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0)


def name_of(page_id, key: str) -> str:
    return f"<urn:chainloom:{page_id}:{key}>"


def records(page_id, uri: str | None, payload: bytes | None, n_bytes: int, sha1: str, refers_to, named: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a response in as many segments as it takes, or a revisit, which has no payload.

    named: whether the response of this payload is named by its id and digest, which only one row of a payload may be.
    """
    name = name_of(page_id, sha1 if named and refers_to is None else uuid.uuid4().hex)
    uri = "".join((uri or "about:blank").split())
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Page-Id", page_id)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name_of(refers_to, sha1) if named else None), ("X-Refers-To-Page", refers_to), ("X-Payload-Bytes", n_bytes)], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", len(block)) if k == len(parts) else ("WARC-Truncated", None)
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:chainloom:{uuid.uuid4().hex}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), last], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, segment: int = SEGMENT) -> DataFrame:
    """Write pages below path (a URI all executors see); returns the names of the files, a written table.

    Only digests are grouped, with partial sums before the shuffle, and only those of repeated payloads are joined back:
    broadcast up to a counted bound, so that no payload moves. Beyond it ids and digests alone are joined with them, which
    adaptive execution splits where a digest is frequent, and payloads are dealt by id and digest to leave out revisits.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", digest("payload")).withColumn("n_bytes", F.length("payload").cast("long"))
    groups = rows.where((F.col("n_bytes") >= min_revisit) & F.col("page_id").isNotNull()).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    groups = groups.groupBy("sha1").agg(F.max(F.struct("page_id", "n")).alias("top"), F.count("*").alias("ids"))
    repeated = written(groups.where("ids > 1").select("sha1", F.col("top.page_id").alias("first"), (F.col("top.n") == 1).alias("named")))
    refers_to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    columns = ["page_id", "uri", "payload", "n_bytes", "sha1", "refers_to", "named"]
    if repeated.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(repeated), "sha1", "left").withColumn("refers_to", refers_to)
    else:
        known = rows.drop("payload").join(repeated.hint("merge"), "sha1").withColumn("refers_to", refers_to)
        again = written(known.where("refers_to is not null"))
        firsts = repeated.where("named").select("sha1", F.col("first").alias("page_id"), "named")
        left = rows.join(again.select("sha1", "page_id").distinct().hint("merge"), ["sha1", "page_id"], "left_anti").join(firsts.hint("merge"), ["sha1", "page_id"], "left")
        rows = left.withColumn("refers_to", F.lit(None).cast("long")).withColumn("first", F.col("page_id")).select(*columns, "first").union(again.withColumn("payload", F.lit(None).cast("binary")).select(*columns, "first"))
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    rows = rows.withColumn("named", F.coalesce(F.col("named") & F.coalesce((F.col("page_id") == F.col("first")) | F.col("refers_to").isNotNull(), F.lit(False)), F.lit(False))).select(columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                for r in records(*row, segment):
                    out.write(r)
        if out:
            out.close()
            yield pa.record_batch([pa.array([name])], names=["name"])

    return written(rows.select(columns).mapInArrow(write, "name string"))


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream, one member in memory at a time."""
    held, inflate, plain = b"", None, []
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                return
        inflate = inflate or zlib.decompressobj(31)
        plain.append(inflate.decompress(held))
        held = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            head, _, rest = b"".join(plain).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            inflate, plain = None, []


def read_records(files: DataFrame, path: str) -> DataFrame:
    """Every record of the archives."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        names = ["kind", "record_id", "origin", "number", "total", "page_id", "refers_to", "digest", "declared", "block"]
        types = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: None if x in (None, "None") else int(x)

        def batch(held):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for h, block in parsed(stream):
                        held.append((h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Segment-Origin-ID"), number(h.get("WARC-Segment-Number")), number(h.get("WARC-Segment-Total-Length")), number(h.get("X-Page-Id")), number(h.get("X-Refers-To-Page")), h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, number(h.get("X-Payload-Bytes")), block))
                        size += len(block)
                        if size > 8 << 20:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    schema = "kind string, record_id string, origin string, number int, total long, page_id long, refers_to long, digest string, declared long, block binary"
    return files.repartition(max(1, files.count())).mapInArrow(rows, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """One row for each response or revisit: its fields and the payload (null if it can't be put together)."""
    head = ["kind", "record_id", "page_id", "refers_to", "digest", "declared"]
    whole = records.where("kind <> 'continuation' and number is null").select(*head, "block")
    part = F.struct("number", "block", "total")
    first = F.when(F.col("kind") != "continuation", F.struct(*head))
    groups = records.where("number is not null").groupBy(F.coalesce("origin", "record_id").alias("key")).agg(F.max(first).alias("head"), F.array_sort(F.collect_set(part)).alias("parts"))
    n = F.size("parts")
    in_order = F.col("parts.number") == F.sequence(F.lit(1), n)
    block = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["block"]))
    fits = in_order & (F.length(block) == F.get("parts", n - 1)["total"])
    joined = groups.where(F.col("head").isNotNull()).select("head.*", F.when(fits, block).alias("block"))
    rows = whole.unionByName(joined)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns[:-1], pa.array([payload_of(x.as_py()) for x in b.column(b.num_columns - 1)], pa.binary())], names=[*b.schema.names[:-1], "payload"])

    fields = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields[:-1])
    return rows.mapInArrow(decode, f"{fields}, payload binary")


def read_archives(files: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page; figures of responses are computed
    from the payload read back, those of revisits are what their records state."""
    rows = reassembled(read_records(files, path))
    revisit = F.col("kind") == "revisit"
    return rows.select(
        "page_id",
        F.when(revisit, F.col("declared")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(digest("payload")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    return read_archives(write_archives(read(spark, sf_dir, "pages"), path), path)
