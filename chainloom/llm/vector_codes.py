"""Compression of vectors to codes of part codebooks, by Lloyd rounds that are maintained by deltas.

Components become integers, so sums are exact and don't depend on order. Vectors are written once, bucketed by a row
number of their own (so no vec_id or label can be hot). A round reads them beside the assignments of the round before,
which are bucketed alike: the join needs no exchange. It writes the new assignments and, in the same pass, the
contributions of parts whose assignment changed: plus to the new entry, minus from the old one, summed in the task first.
Only these contributions are shuffled; added to the running integer sums (a written table of a row for each component of
an entry) they give the next codebook. The codebook is the only thing on the driver; its size is a parameter.
A round without changes ends the rounds, as all later ones would be the same.

Left out: null vectors, vectors with null or non-finite components or without components, and vectors of another length
than that of the kept row with the least vec_id (null ids come last). Integers are held to +-`bound(length)` (for 64
components about 1.9e8, so |x| up to 46,000), beyond which squared distances wouldn't fit 64 bits. Lengths that the parts
don't divide: parts differ by one component. Fewer kept rows than entries: fewer entries. Repeated rows and ids count
each. Equal ids among the first entries are ordered by their vectors. A label's sum beyond 64 bits is null. Empty table:
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.scratch import shared_dir

from .common import bounded, lean, read, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
ROWS_A_BUCKET = 1_000_000
#: Differences of components that are held at once.
BLOCK = 4_000_000
ASSIGNED = "row long, code binary, part int, entry int, place int, delta long"


def bound(length: int) -> int:
    return math.isqrt((1 << 63) // length) // 2 - 1


def bucketed(df: DataFrame, n: int) -> DataFrame:
    """df, whose tasks each hold the rows of one bucket, written as a table in the shared folder and read by buckets."""
    name = f"chainloom_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "row").option("path", shared_dir(df.sparkSession)).option("compression", "zstd").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def edges(length: int, parts: int) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def integers(table: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label and v, the integers of every vector that is kept whatever its length."""
    x = F.col(vec_col)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(1e12)), F.lit(-1e12)) * scale))
    return table.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))


def nearest(v: np.ndarray, books: list[np.ndarray], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row, ties to the lower index, and the squared distances, summed over parts."""
    codes, errors = np.zeros((len(v), len(books)), np.uint8), np.zeros(len(v), np.int64)
    step = max(1, BLOCK // max(1, max(b.size for b in books)))
    for low in range(0, len(v), step):
        rows = v[low : low + step]
        for p, book in enumerate(books):
            differ = rows[:, None, at[p] : at[p + 1]] - book
            squares = np.einsum("nek,nek->ne", differ, differ)
            codes[low : low + step, p] = found = squares.argmin(1)
            errors[low : low + step] += squares[np.arange(len(rows)), found]
    return codes, errors


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def binaries(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def assigned(rows: DataFrame, books: list[np.ndarray], at: list[int]) -> DataFrame:
    """Of rows (row, v, code, the entries of the round before or null): row and code, and rows of contributions.

    A contribution adds delta to a component of the sum of an entry, place -1 to the number of its parts; it carries the
    number of some row of its task, so that it is written to the bucket of that.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in ASSIGNED.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        row = None
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row")[0].as_py()
            v = matrix(batch.column("v"), at[-1])
            new, _ = nearest(v, books, at)
            before = batch.column("code").to_pylist()
            known = np.array([c is not None for c in before])
            old = np.full_like(new, 255)
            if known.any():
                old[known] = np.frombuffer(b"".join(c for c in before if c is not None), np.uint8).reshape(-1, len(books))
            for p, s in enumerate(sums):
                moved = np.flatnonzero((new[:, p] != old[:, p]) | ~known)
                part = np.concatenate([np.ones((len(moved), 1), np.int64), v[moved, at[p] : at[p + 1]]], 1)
                for e in range(len(s)):
                    s[e] += part[new[moved, p] == e].sum(0) - part[(old[moved, p] == e) & known[moved]].sum(0)
            nothing = [pa.nulls(batch.num_rows, k) for k in kinds[2:]]
            yield pa.record_batch([batch.column("row"), binaries(new), *nothing], names=names)
        found = [(row, None, p, int(e), int(k) - 1, int(s[e, k])) for p, s in enumerate(sums) for e, k in np.argwhere(s)]
        if found:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return rows.select("row", "v", "code").mapInArrow(run, ASSIGNED)


def coded(rows: DataFrame, books: list[np.ndarray], at: list[int]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row."""
    label = rows.schema["label"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = nearest(matrix(batch.column("v"), at[-1]), books, at)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compressed(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code and error of every kept row, the codebook of each part)."""
    spark = table.sparkSession
    kept = integers(table, id_col, vec_col, label_col, scale)
    size = kept.select(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), F.coalesce("vec_id", F.lit(0)))).alias("n"), F.count("*").alias("rows")).first()
    length = size["n"] or 1
    limit, at = F.lit(bound(length)).cast("long"), edges(length, parts)
    v = F.transform("v", lambda c: F.greatest(F.least(c, limit), -limit).cast("int"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["rows"] / ROWS_A_BUCKET))
    kept = kept.where(F.size("v") == length).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", v.alias("v"))
    vectors = bucketed(kept.repartition(n, "row"), n)
    first = vectors.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not first:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    books = [np.array([r["v"][a:b] for r in first], np.int64).reshape(len(first), b - a) for a, b in zip(at, at[1:])]
    rows, sums = vectors.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        now = bucketed(assigned(rows, books, at), n)
        changes = now.where("part is not null").select("part", "entry", "place", "delta")
        if not changes.limit(1).count():
            break
        sums = written((sums.unionByName(changes) if sums else changes).groupBy("part", "entry", "place").agg(F.sum("delta").alias("delta")))
        held = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for part, entry, place, total in sums.collect():
            held[part][entry, place + 1] = total
        books = [np.where(h[:, :1] > 0, h[:, 1:] // np.maximum(h[:, :1], 1), b) for h, b in zip(held, books)]
        codes = now.where("code is not null").select("row", "code").hint("shuffle_hash")
        rows = vectors.join(codes, "row")
    return coded(vectors, books, at), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compressed(read(spark, sf_dir, "embeddings"))
    found = written(found)
    labels = written(found.groupBy("label").agg(F.try_sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    out = found.join(bounded(labels), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
