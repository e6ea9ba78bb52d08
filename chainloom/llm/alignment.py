"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the token pairs that overlap.

Elementary intervals: the union of both arrays of token ends cuts a text's bytes into intervals, each inside one token of
either side (found by searchsorted); so each interval is one overlap, a link. An end that both sides have closes a group.
`products` expands the groups to all their pairs of tokens.

Both sides begin a token at every single space, so a part between two spaces has the same tokens, groups and links in
every text. The distinct parts of many texts are aligned together and kept, up to a bound; a text gathers those of its
parts. Texts with other white space at a space, and those with a part that isn't spelled, are aligned as a whole.

A pair of ids counts the documents that hold it linked. A document keeps its distinct pairs and how often each is linked;
these are exploded and aggregated on Spark. The counts go back to the documents by a join: the most frequent pairs, up to
a counted bound, are broadcast; the others, whose occurrences are few by being rare, are joined by a shuffle. A pair of
one document is in neither table, if it isn't its first id's best one: it counts 1.

Null or empty texts, and texts whose tokens on one side don't spell a space and the text (U+2581 in a text, an unknown
piece), have no tokens: zeros and an empty digest. Repeated rows and null ids are documents each. Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lean, read, written
from .tokens import Encoder, byte_letters, cut_at_spaces

SPACE = "▁"  # stands for a space in pieces
#: Links after which a batch of documents is passed on.
BATCH_LINKS = 1_000_000
#: Parts whose alignment a process keeps, about 500 bytes each, and parts whose first ids it keeps.
KEPT_PARTS, KEPT_IDS = 150_000, 50_000
#: Parts that are aligned together; they bound what their lists and arrays take.
PARTS_AT_ONCE = 5_000


@dataclass
class Alignment:
    """Token ids of both sides, the tokens that own each interval, and the group of each token."""

    a: np.ndarray
    b: np.ndarray
    own_a: np.ndarray
    own_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.group_a[-1]) + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all overlapping occurrences, by interval."""
        return self.a[self.own_a], self.b[self.own_b]

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pairs of tokens that stand in one group."""
        sizes = np.bincount(self.group_b)
        n = sizes[self.group_a]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.a, n), self.b[np.repeat((np.cumsum(sizes) - sizes)[self.group_a], n) + within]

    def groups(self) -> list[tuple[list[int], list[int]]]:
        """The ids of each group on both sides."""
        cuts = [np.searchsorted(g, np.arange(1, self.n_groups)) for g in (self.group_a, self.group_b)]
        return [(x.tolist(), y.tolist()) for x, y in zip(np.split(self.a, cuts[0]), np.split(self.b, cuts[1]))]


class Part(NamedTuple):
    """What a part adds to its text: counts, the text of its groups, its links' pairs as 64-bit integers."""

    n_a: int
    n_b: int
    n_groups: int
    n_products: int
    groups: bytes
    pairs: bytes


class Document(NamedTuple):
    """Counts and digest of a text; the pair of each link in any order."""

    n_a: int
    n_b: int
    n_groups: int
    n_products: int
    groups_sha256: str
    pairs: np.ndarray


class Aligner:
    """byte_path: a byte-level vocabulary of the tokenizers library. piece_path: a model of sentencepiece."""

    def __init__(self, byte_path: str, piece_path: str):
        self.coder = Encoder(byte_path, limit=KEPT_IDS, specials=False)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = {c: bytes([b]) for b, c in byte_letters().items()}
        names = self.coder.tokenizer.get_vocab()
        self.bytes_a = [b""] * (1 + max(names.values()))
        for name, k in names.items():
            self.bytes_a[k] = b"".join(letters.get(c, c.encode()) for c in name)
        p = self.pieces
        self.by_parts = not any(SPACE in p.id_to_piece(k).lstrip(SPACE) for k in range(p.get_piece_size()))
        self.kept: dict[str, Part | None] = {}
        self.bytes_b = [bytes([int(p.id_to_piece(k)[3:5], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace(SPACE, " ").encode() for k in range(p.get_piece_size())]
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        self.n_b = len(self.bytes_b)
        self.texts = [f"{k}{mark}" for n in (len(self.bytes_a), self.n_b) for k in range(n) for mark in ",|;"]

    def align(self, text: str | None) -> Alignment | None:
        """None where the two sides don't both spell a space and the text."""
        if not text:
            return None
        raw = (" " + text).encode("utf-8", "replace")
        a, b = self.coder.encode(" " + text).astype(np.int64), np.array(self.pieces.encode(text, num_threads=1), np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        return self._overlap(a, b)

    def _overlap(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = ends[(ends_a[own_a] == ends) & (ends_b[own_b] == ends)]
        return Alignment(a, b, own_a, own_b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b))

    def text(self, found: Alignment) -> str:
        """The groups as `a1,a2|b1;a3|b2,b3`, decimal ids in order."""
        return "".join(self._marked(found))[:-1]

    def _marked(self, found: Alignment) -> list[str]:
        """The text of each token of either side by groups, with the mark after it."""
        side = np.concatenate([2 * found.group_a, 2 * found.group_b + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        mark = np.zeros(len(side), np.int64)  # within a side of a group; after its first side; after the group
        mark[:-1] = np.where(side[:-1] == side[1:], 0, 1 + side[:-1] % 2)
        tokens = np.concatenate([found.a, found.b + len(self.bytes_a)])[order]
        return list(map(self.texts.__getitem__, (3 * tokens + mark).tolist()))

    def align_parts(self, parts: list[str]) -> list[Part | None]:
        """Each part after a space; None where the two sides don't both spell that."""
        if not parts:
            return []
        raw = [(" " + p).encode("utf-8", "replace") for p in parts]
        sides_a = [np.frombuffer(self.coder.part(p), self.coder.dtype) for p in parts]
        sides_b = self.pieces.encode(parts, num_threads=1)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, cuts, spelled = [], [], True
        for side, sizes, names in ((np.concatenate(sides_a), self.sizes[0], self.bytes_a), (np.fromiter(chain.from_iterable(sides_b), np.int64), self.sizes[1], self.bytes_b)):
            ids.append(side.astype(np.int64))
            cuts.append(np.cumsum(np.fromiter(map(len, sides_b if len(cuts) else sides_a), np.int64, len(parts))))
            ends = np.concatenate([[0], np.cumsum(sizes[ids[-1]])])[cuts[-1]]
            spelled = spelled and np.array_equal(np.diff(ends, prepend=0), lengths) and b"".join(map(names.__getitem__, side.tolist())) == b"".join(raw)
        if not spelled:
            spells = lambda side, names, want: b"".join(map(names.__getitem__, side)) == want
            good = [spells(a.tolist(), self.bytes_a, r) and spells(b, self.bytes_b, r) for a, b, r in zip(sides_a, sides_b, raw)]
            rest = iter(self.align_parts([p for p, g in zip(parts, good) if g]))
            return [next(rest) if g else None for g in good]
        found = self._overlap(*ids)
        a, b = found.links()
        pairs, words = (a * self.n_b + b).tobytes(), self._marked(found)
        # a part's last tokens end together, so they are the last of a group and of an interval
        last_a, last_b = (c - 1 for c in cuts)
        groups = found.group_a[last_a] + 1
        links = np.searchsorted(found.own_a, last_a, "right")
        products = np.cumsum(np.bincount(found.group_a) * np.bincount(found.group_b))[groups - 1]
        counts = [np.diff(x, prepend=0).tolist() for x in (*cuts, groups, products)]
        at_word, at_pair = [0, *(cuts[0] + cuts[1]).tolist()], [0, *(8 * links).tolist()]
        texts = ["".join(words[i:j])[:-1].encode() for i, j in zip(at_word, at_word[1:])]
        return list(map(Part._make, zip(*counts, texts, [pairs[i:j] for i, j in zip(at_pair, at_pair[1:])])))

    def _parts(self, distinct: list[str]) -> list[Part | None]:
        missing = [p for p in distinct if p not in self.kept]
        new: dict[str, Part | None] = {}
        for k in range(0, len(missing), PARTS_AT_ONCE):
            some = missing[k : k + PARTS_AT_ONCE]
            new.update(zip(some, self.align_parts(some)))
        found = [new[p] if p in new else self.kept[p] for p in distinct]
        for p in missing[: KEPT_PARTS - len(self.kept)] if len(self.kept) < KEPT_PARTS else ():
            self.kept[p] = new[p]
        return found

    def document(self, text: str | None) -> Document | None:
        found = self.align(text)
        if not found:
            return None
        a, b = found.links()
        products = int((np.bincount(found.group_a) * np.bincount(found.group_b)).sum())
        return Document(len(found.a), len(found.b), found.n_groups, products, hashlib.sha256(self.text(found).encode()).hexdigest(), a * self.n_b + b)

    def documents(self, texts: pa.Array) -> Iterator[Document | None]:
        """As document, of each text."""
        if not self.by_parts:
            yield from (self.document(t.as_py()) for t in texts)
            return
        void = Part(0, 0, 0, 0, b"", b"")
        for cut in cut_at_spaces(texts):
            found = self._parts(cut.distinct)
            lost = np.fromiter((x is None for x in found), bool, len(found))
            if lost.any():
                cut.plain[np.searchsorted(cut.ends, np.flatnonzero(lost[cut.codes]), "right")] = False
            *counts, groups, pairs = zip(*(x or void for x in found))
            starts = np.concatenate([[0], cut.ends[:-1]])
            sums = zip(*(np.add.reduceat(np.array(c, np.int64)[cut.codes], starts).tolist() for c in counts))
            for (k, plain, codes), own in zip(cut.each(), sums):
                if plain:
                    links = np.frombuffer(b"".join(map(pairs.__getitem__, codes)), np.int64)
                    yield Document(*own, hashlib.sha256(b";".join(map(groups.__getitem__, codes))).hexdigest(), links)
                else:
                    yield self.document(cut.texts[k].as_py())


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One a process and pair of vocabularies."""
    key = (byte_path, piece_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups, an array of (a, b) with the ids of a group on both sides; empty without tokens."""
    side = pa.list_(pa.int32())
    kinds = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(pa.struct([("a", side), ("b", side)])))])

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [both.align(t.as_py()) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array([[{"a": a, "b": b} for a, b in f.groups()] if f else [] for f in found], kinds.field(1).type)], schema=kinds)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


PROFILE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_products long, groups_sha256 string, pairs array<long>, times array<int>"


def profiles(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts, the digest of its groups, its distinct linked pairs and how often each is linked, a written table.

    A pair is a * (pieces of the second vocabulary) + b. row is a number of its own for each row.
    """
    names = [f.split(" ")[0] for f in PROFILE.split(", ")]

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        none = np.zeros(0, np.int64)

        def batch() -> pa.RecordBatch:
            *plain, pairs, times = zip(*held)
            cuts = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(pairs))), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(times).astype(np.int32)))]
            kinds = [pa.int64()] * 7 + [pa.string()]
            return pa.record_batch([*(pa.array(c, k) for c, k in zip(plain, kinds)), *lists], names=names)

        for b in batches:
            n = 0
            for doc_id, found in zip(b.column(0).to_pylist(), both.documents(b.column(1))):
                if found:
                    pairs, times = np.unique(found.pairs, return_counts=True)
                    held.append((row, doc_id, found.n_a, found.n_b, found.n_groups, len(found.pairs), found.n_products, found.groups_sha256, pairs, times))
                    n += len(pairs)
                else:
                    held.append((row, doc_id, 0, 0, 0, 0, 0, "", none, none))
                row += 1
                if n > BATCH_LINKS:
                    yield batch()
                    held, n = [], 0
            if held:
                yield batch()
                held = []

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, PROFILE))


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether n is the highest of its first id), a written table; n_b: pieces of the second vocabulary."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    counts = counts.withColumn("a", F.expr(f"pair div {n_b}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    return written(counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def link_sums(found: DataFrame, counts: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """row, n_best (links whose pair is its first id's best) and count_sum (of all links' counts) of every document with links.

    Pairs above a power of two are broadcast, the least power that at most `limit` pairs reach.
    """
    told = counts.where("n > 1 or best").withColumn("bits", F.length(F.bin("n")))
    sizes = dict(told.groupBy("bits").count().collect())
    low, kept = 65, 0
    while low > 1 and kept + sizes.get(low - 1, 0) <= limit:
        low -= 1
        kept += sizes.get(low, 0)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    frequent = F.broadcast(told.where(F.col("bits") >= low).drop("bits"))
    if low > 1:  # not all are broadcast
        rare = told.where(F.col("bits") < low).drop("bits").hint("merge")
        marked = each.join(frequent, "pair").unionByName(each.join(frequent, "pair", "left_anti").join(rare, "pair", "left"))
    else:
        marked = each.join(frequent, "pair", "left")
    return marked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.coalesce("n", F.lit(1))).alias("count_sum"))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, limit: int = BROADCAST_ROWS, **columns: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_products (pairs of tokens in one group) of every document."""
    found = profiles(docs, byte_path, piece_path, **columns)
    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    sums = link_sums(found, pair_counts(found, n_b), limit)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_products")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
