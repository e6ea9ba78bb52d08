"""Substring dedup by suffix automata of reference shards.

A span of at least MIN_WORDS words is removed where its text also starts in a document with a smaller id (`deduplicated`:
the corpus is its own reference) or in a given reference (`without`). Documents are streamed through automata; matching
statistics tell for each word the longest match that ends there, and maximal spans above the threshold go.

A given reference of counted, bounded size is broadcast as automata of its shards. A corpus isn't bounded, so its shards
are brought to the text instead of being broadcast everywhere:

1. Texts that repeat as a whole become one, the least id; their other rows are removed entirely.
2. Each window of MIN_WORDS words has an anchor, its ANCHOR words of least hash, so equal windows have equal anchors.
   Anchors of two or more documents are found by counting, with partial sums; all else can't repeat.
3. The words around a shared anchor that its windows span are a segment. Segments are combined within a task, then
   dealt by anchor; each anchor's distinct segments are a reference shard of bounded size, for which one automaton is
   built that knows the least id of each state. Windows of anchors in more than HOT documents are dealt by their own
   text instead, so no shard or key grows with the corpus.
4. What the automaton says of each window (least id) is joined back to the segments' places, and to the texts.

What is counted or grouped is written before rows are joined with it, so that adaptive execution can split a frequent
digest or anchor; only ids and digests are ever broadcast, up to a counted bound.

Windows are judged on the input. Null or empty texts and texts of under MIN_WORDS words lose nothing. Rows of one id
with equal texts are one document; with unequal texts they don't make each other's spans repeat. Null ids are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read, runs, text_hashes, utf8, written

MIN_WORDS, ANCHOR, HOT = 13, 5, 2000
COMBINED, REFERENCE_WORDS, SHARD_WORDS = 100_000, 2_000_000, 50_000


class SuffixAutomaton:
    """All substrings of several word sequences, with the least owner of each state's substrings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.owner: list[int | None] = [None]
        self.ends: list[tuple[int, int]] = []

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(None)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list, owner: int) -> None:
        last, nexts, link, length = 0, self.next, self.link, self.length
        for word in words:
            q = nexts[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                now = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = now
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[now] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = now
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def close(self) -> SuffixAutomaton:
        """Carry least owners to the suffixes of each state; call once, after the last add."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            mine, up = self.owner[v], self.link[v]
            if up > 0 and mine is not None and (self.owner[up] is None or mine < self.owner[up]):
                self.owner[up] = mine
        return self

    def owners(self, words: list, n: int) -> list[int | None]:
        """For each window of n words of a text: the least owner of that window here, or None.

        Streams the text for matching statistics (state and matched length); a window occurs if the match has n words,
        and its own state is the last one on the suffix links that still holds n words.
        """
        state = matched = 0
        nexts, link, length, out = self.next, self.link, self.length, []
        for k, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state, matched = nexts[state][word], matched + 1
            while length[link[state]] >= n if state else False:
                state = link[state]
                matched = length[state]
            if k >= n:
                out.append(self.owner[state] if matched >= n else None)
        return out


def anchors(hashes: np.ndarray, n: int = MIN_WORDS, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's hash of each k-word run, and for each window of n words the place of its anchor (the first least one)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = runs(hashes, k)
    seen = np.lib.stride_tricks.sliding_window_view(keys, n - k + 1)
    return keys, seen.argmin(1) + np.arange(len(seen))


def spread(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with an id in ids (a written table), and the others."""
    ids = bounded(ids)
    return docs.join(ids, "id", "left_semi"), docs.join(ids, "id", "left_anti")


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                keys, at = anchors(text_hashes(utf8(text.as_py())))
                if len(at):
                    found.append(np.unique(keys[at]))
                    owners.append(np.full(len(found[-1]), doc_id, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners))], names=["anchor", "id"])

    return docs.select("id", "text").mapInArrow(rows, "anchor long, id long")


def _segments(docs: DataFrame) -> DataFrame:
    """key, sh (hash of the segment), id, th, pos and seg, for docs with packed text and lists of shared anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["key", "sh", "id", "th", "pos", "seg"]
        types = [pa.int64()] * 5 + [pa.binary()]
        signed = lambda b: xxhash.xxh3_64_intdigest(b) - (1 << 63)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                doc_id, th, packed, shared, hot = (c[i].as_py() for c in b.columns)
                text = unpack.decompress(packed)
                words = text.split()
                keys, at = anchors(text_hashes(text))
                known = np.isin(keys[at], np.array(shared, np.int64).view(np.uint64))
                busy = np.isin(keys[at], np.array(hot, np.int64).view(np.uint64))
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
                for s, e in zip(cuts, [*cuts[1:], len(at)]):
                    if busy[s]:
                        for w in range(s, e):
                            seg = b" ".join(words[w : w + MIN_WORDS])
                            h = signed(seg)
                            out.append((h, h, doc_id, th, w, seg))
                    elif known[s]:
                        seg = b" ".join(words[s : e + MIN_WORDS - 1])
                        out.append((int(keys[at[s]].view(np.int64)), signed(seg), doc_id, th, int(s), seg))
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select("id", "th", "packed", "shared", "hot").mapInArrow(rows, "key long, sh long, id long, th long, pos long, seg binary")


def _combined(segments: DataFrame) -> DataFrame:
    """Distinct segments of a task, with least and greatest id: what is equal in many documents is combined before it moves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush():
            (key, sh), values = zip(*held), [*held.values()]
            seg = [v[2] for v in values]
            return pa.record_batch([pa.array(key, pa.int64()), pa.array(sh, pa.int64()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64()), pa.array(seg, pa.binary())], names=["key", "sh", "low", "high", "seg"])

        for b in batches:
            for key, sh, doc_id, seg in zip(*(c.to_pylist() for c in b.columns)):
                known = held.get((key, sh))
                if known is None:
                    held[key, sh] = [doc_id, doc_id, seg]
                else:
                    known[0], known[1] = min(known[0], doc_id), max(known[1], doc_id)
            if len(held) >= COMBINED:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return segments.select("key", "sh", "id", "seg").mapInArrow(rows, "key long, sh long, low long, high long, seg binary")


def _judged(shards: DataFrame) -> DataFrame:
    """key, sh and least (the least id of each window) of segments some of whose places may have to go. Rows come by key."""

    def judge(key: int, group: dict) -> Iterator[tuple]:
        if len(group) == 1:
            (sh, (low, high, seg)), = group.items()
            if low < high:
                yield key, sh, [low]
            return
        automaton = SuffixAutomaton()
        texts = {sh: seg.split() for sh, (_, _, seg) in group.items()}
        for sh, (low, _, _) in group.items():
            automaton.add(texts[sh], low)
        automaton.close()
        for sh, (low, high, _) in group.items():
            least = automaton.owners(texts[sh], MIN_WORDS)
            if min(least) < high:
                yield key, sh, least

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, {}, []

        def done():
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.list_(pa.int64())])], names=["key", "sh", "least"])
            out.clear()
            return batch

        for b in batches:
            for key, sh, low, high, seg in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    if group:
                        out += judge(at, group)
                    at, group = key, {}
                known = group.get(sh)
                group[sh] = (low, high, seg) if known is None else (min(low, known[0]), max(high, known[1]), seg)
            if len(out) > 20_000:
                yield done()
        if group:
            out += judge(at, group)
        if out:
            yield done()

    return shards.mapInArrow(rows, "key long, sh long, least array<long>")


def _kept(docs: DataFrame, id_type: str) -> DataFrame:
    """id, n_words, n_removed, kept_text from text and starts (windows that go) or whole (all of it goes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text, starts, whole = (b.column(k)[i].as_py() for k in (1, 2, 3))
                words = utf8(text).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if starts:
                    np.add.at(gone, np.array(starts), 1)
                    np.add.at(gone, np.array(starts) + MIN_WORDS, -1)
                covered = np.cumsum(gone)[:-1] > 0
                if whole and len(words) >= MIN_WORDS:
                    covered[:] = True
                if covered.any():
                    kept = [w for w, c in zip(words, covered) if not c]
                else:
                    kept = words
                out.append((len(words), int(covered.sum()), b" ".join(kept).decode()))
            columns = zip(*out) if out else [[]] * 3
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()]))], names=["id", "n_words", "n_removed", "kept_text"])

    return docs.select("id", "text", "starts", "whole").mapInArrow(rows, f"id {id_type}, n_words long, n_removed long, kept_text string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and kept_text, with the corpus as its own reference."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.select("id", F.md5(F.encode("text", "utf-8")).alias("digest")).where("id is not null")
    firsts = written(named.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    copies = written(named.join(bounded(firsts), "digest").where("id <> first").select("id", F.expr("conv(left(digest, 15), 16, 10)").cast("long").alias("th")).distinct())

    th = F.expr("conv(left(md5(encode(text, 'utf-8')), 15), 16, 10)").cast("long")
    keyed = rows.where("id is not null").withColumn("th", th)
    known = bounded(copies)
    own = keyed.join(known, ["id", "th"], "left_anti")

    anchor = _anchor_rows(own)
    shared = written(anchor.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    lists = written(anchor.join(shared.hint("merge"), "anchor").groupBy("id").agg(F.collect_list("anchor").alias("shared"), F.collect_list(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot")))

    @F.pandas_udf("binary")
    def pack(texts):
        press = zstandard.ZstdCompressor(3)
        return texts.map(lambda x: press.compress(x.encode("utf-8", "replace")))

    texts, _ = spread(own, lists.select("id"))
    segments = written(_segments(texts.select("id", "th", pack("text").alias("packed")).join(lists.hint("merge"), "id")))
    parts = max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = _combined(segments).repartition(parts, "key").sortWithinPartitions("key")
    judged = _judged(shards)

    one = F.size("least") == 1
    starts = F.when(one & (F.col("least")[0] < F.col("id")), F.sequence(F.col("pos"), F.col("pos") + F.col("n_windows") - 1)).otherwise(
        F.filter(F.transform("least", lambda x, i: F.when(x < F.col("id"), F.col("pos") + i)), lambda x: x.isNotNull())
    )
    places = segments.select("key", "sh", "id", "th", "pos", (F.size(F.split(F.decode("seg", "utf-8"), " ")) - (MIN_WORDS - 1)).alias("n_windows"))
    gone = places.join(judged, ["key", "sh"]).select("id", "th", starts.alias("starts")).where(F.size("starts") > 0)
    gone = written(gone.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))

    changed, same = spread(own, written(gone.select("id").distinct()))
    whole = keyed.join(known, ["id", "th"], "left_semi")
    none = F.lit(None).cast("array<long>")
    nulls = rows.where("id is null")
    parts = [
        changed.join(gone.hint("merge"), ["id", "th"], "left").select("id", "text", "starts", F.lit(False).alias("whole")),
        same.select("id", "text", none.alias("starts"), F.lit(False).alias("whole")),
        whole.select("id", "text", none.alias("starts"), F.lit(True).alias("whole")),
        nulls.select("id", "text", none.alias("starts"), F.lit(False).alias("whole")),
    ]
    out = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return _kept(out, "long").withColumnRenamed("id", id_col)


def without(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", max_words: int = REFERENCE_WORDS) -> DataFrame:
    """Per row: id, n_words, n_removed and kept_text, spans of the reference removed; raises if it has over max_words words."""
    words = reference.select(F.coalesce(F.col(reference_col), F.lit("")).alias("text"))
    if (words.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0) > max_words:
        raise ValueError(f"the reference has more than {max_words} words; join it to the documents with deduplicated()")
    shards, size = [SuffixAutomaton()], 0
    for row in words.toLocalIterator():
        sequence = utf8(row.text).split()
        if size + len(sequence) > SHARD_WORDS and size:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(sequence, 0)
        size += len(sequence)
    shared = docs.sparkSession.sparkContext.broadcast([(a.next, a.link, a.length, a.owner) for a in (x.close() for x in shards)])

    @F.pandas_udf("array<long>")
    def starts(texts):
        found = []
        for parts in shared.value:
            a = SuffixAutomaton()
            a.next, a.link, a.length, a.owner = parts
            found.append(a)

        def of(text):
            words = utf8(text).split()
            return sorted({k for a in found for k, o in enumerate(a.owners(words, MIN_WORDS)) if o is not None})

        return texts.map(of)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _kept(rows.select("id", "text", starts("text").alias("starts"), F.lit(False).alias("whole")), docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
