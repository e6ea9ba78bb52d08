"""Quality classifier: histogram gradient-boosted trees over document statistics.

The model is fitted in numpy on a bounded sample of labelled rows (`max_rows`, in the order of a hash of the id; rows held
out are never read), as trees over quantile bins. The sample's labels are chosen first and broadcast, so statistics of the
sample's texts are all that is computed for it. The fitted trees are flattened into arrays; one pass over all whole texts
computes their statistics and walks all rows of an Arrow batch through a tree at once. Nothing is shuffled but labels.
Labels, lang, source and doc_id are no inputs.

Null text counts as empty and is scored as every other text. A repeated label or document row counts each time, within
the bound; null labels and ids are left out; with one class or no labels the score is the class share, or 0.5. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, utf8, written

MAX_ROWS, TREES, DEPTH, BINS, RATE, REGULAR, THRESHOLD = 20_000, 60, 4, 64, 0.15, 1.0, 0.3
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACES = [32, *range(9, 14)]
N_STATISTICS = 22


def statistics(text: str | None) -> list[float]:
    """The figures of one text; all are defined for an empty one."""
    data = utf8(text)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    ended = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines)
    top = sorted(tally.values())[-3:] if tally else [0]
    of = lambda chars: counts[list(chars)].sum() / size
    return [
        np.log1p(len(data)), np.log1p(len(words)), counts[_LETTERS].sum() / n, of(b"#*$%&<>~^=_{}[]@"), of(b"|"), of(b"!"), of(b".,"),
        of(range(48, 58)), of(range(65, 91)), counts[_LETTERS].sum() / size, counts[_SPACES].sum() / size, counts[10] / size,
        len(tally) / n, pairs / n, top[-1] / n, sum(top) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / n_lines,
        ended / n_lines, n / n_lines, np.log1p(len(lines)), max(map(len, words), default=0) / 100,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[str] = ()) -> DataFrame:
    """id and `stats` (array of doubles) of each row, and further columns as they are."""
    kept = docs.select(F.col(id_col), *extra, F.col(text_col).alias("__text"))

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([statistics(x.as_py()) for x in b.column(b.num_columns - 1)], float).reshape(b.num_rows, N_STATISTICS)
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * N_STATISTICS, pa.array(found.ravel()))
            yield pa.record_batch([*b.columns[:-1], lists], names=[*b.schema.names[:-1], "stats"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema.fields[:-1])
    return kept.mapInArrow(rows, f"{fields}, stats array<double>")


class Forest:
    """Trees as arrays: node k of tree t has feature, threshold and children 2k + 1, 2k + 2; leaves are the last level."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.threshold, self.leaf, self.start = feature, threshold, leaf, start

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss; each level's histograms are one bincount over (node, feature, bin)."""
    n, m = x.shape if len(x) else (0, N_STATISTICS)
    inner = 2**DEPTH - 1
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0)
    binned = np.stack([np.searchsorted(edges[:, j], x[:, j], "left") for j in range(m)], 1)
    raw, features, thresholds, leaves = np.full(n, start), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            key = (((node - first)[:, None] * m + np.arange(m)) * BINS + binned).ravel()
            sums = [np.bincount(key, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(2) for v in (grad, hess)]
            (g, h), (gs, hs) = (s[:, :, :-1] for s in sums), (s[:, :, -1:] for s in sums)
            gain = g**2 / (h + REGULAR) + (gs - g) ** 2 / (hs - h + REGULAR) - gs**2 / (hs + REGULAR)
            gain[(h < 1) | (hs - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            found = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // (BINS - 1), best % (BINS - 1)
            feature[first : first + width], threshold[first : first + width] = f, np.where(found, edges[b, f], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + REGULAR)
        raw += leaf[at]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), start)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on at most max_rows labelled rows that aren't held out."""
    known = labels.select(id_col, F.col("quality").cast("double").alias("__y")).where(F.col("__y").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    order = [F.xxhash64(id_col), id_col, "__y"]
    chosen = written(known.orderBy(*order).limit(max_rows))
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    sample = with_statistics(rows, id_col, text_col, ["__y"]).orderBy(*order, F.col("stats").cast("string")).limit(max_rows).select("stats", "__y").toArrow()
    x = np.array(sample.column("stats").to_pylist(), float).reshape(-1, N_STATISTICS)
    return fit(x, np.array(sample.column("__y").to_pylist(), float))


def scored(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    kept = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)], float).reshape(b.num_rows, N_STATISTICS)
            yield pa.record_batch([b.column(0), pa.array(forest.score(x))], names=[id_col, "score"])

    return kept.mapInArrow(rows, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least threshold; columns and their order stay, nothing is shuffled."""

    @F.arrow_udf("boolean")
    @lean
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([statistics(t.as_py()) for t in texts], float).reshape(len(texts), N_STATISTICS)
            yield pa.array(forest.score(x) >= threshold)

    return docs.where(good(text_col))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    forest = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs, forest).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
