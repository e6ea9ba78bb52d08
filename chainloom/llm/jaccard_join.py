"""Exact n-gram Jaccard join with connected components, by prefix-tree joins.

A document's set is its distinct hashed n-grams. Equal sets become one representative, the least id. Sets are ordered by
one global order: the most frequent n-grams of the corpus first, the others by hash. A tree stores sets in that order as
paths; a join walks it once with all probes, so that the overlaps with a stretch that several sets share are counted
once, and leaves a subtree when what remains of its sets and of the probes can't make up for what was missed.

Sets that reach the threshold share an n-gram of their last, rarest ones (the prefix filter, read from the rare end), so
they meet in that n-gram's bucket. A bucket isn't turned into all its pairs:

1. Every member meets the bucket's least member. Size and a parity sketch (whose Hamming distance never exceeds the sets'
   difference) drop pairs that can't link. The owner of such pairs walks the tree of its members' sets: first for the
   least owner of each member, then, after components of these links, for pairs between components.
2. In buckets that still hold several components, members are compared by size and sketch, in blocks of size classes:
   a class meets itself and the next one only, as sets further apart can't link. Members of a class's largest component
   needn't meet each other and are dealt apart. Pairs are counted by the n-grams that their
   rare ends share, and those with enough for a link are verified by trees as before.
3. `n_links` counts the links of a representative exactly: members of a component are joined with themselves, in blocks,
   and only counts leave a task. This takes comparisons in proportion to the square of a component's different sets (an
   answer of that size isn't avoidable by components alone); leave it out with count_links=False.

So copies and near copies of a text, however many, cost a number of candidate pairs in proportion to their number, no
link is lost, and no group is held by one task beyond a block.

Null or empty texts and texts without words have an empty set and link with nothing. Fewer words than n: the whole
sequence is one n-gram. Rows that repeat an id are one node. Null ids get a null component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded, lean, read, runs, small_batches, utf8, word_hashes, written
from .components import components

HOT_ROWS, HOT_LIMIT, CHUNK = 64, 100_000, 750_000
SKETCH = 8  # longs
#: Sets and n-grams of a block of sets, members that an owner meets in one task, and members of a block of a bucket.
BLOCK, BLOCK_GRAMS, SLICE, BUCKET = 1024, 400_000, 256, 256
#: Words of more bytes are hashed one by one. Bytes and texts whose n-grams are made at once.
LONG_WORD, TOGETHER, TOGETHER_TEXTS = 64, 1 << 17, 512
PACKED = "id long, packed binary"


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, sorted, a text after the other, and their bounds: one more than texts.

    The highest bit is set, so that ranks of frequent ones stay below. Words of all texts are hashed at once; the sums
    behind these hashes are weak on long words, so those are hashed one by one.
    """
    joined = b" ".join(texts).translate(LOWER)
    starts, ends, hashes = word_hashes(joined)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # the words before each text
    words = np.diff(first)
    at = np.zeros(len(hashes), np.uint64)  # the n-gram that starts at a word, or the whole of a text of fewer words
    at[: max(len(hashes) - n + 1, 0)] = runs(hashes, n)
    for k in range(1, n):
        short = first[:-1][words == k]
        if len(short):
            at[short] = runs(hashes, k)[short]
    counts = np.where(words < n, np.minimum(words, 1), words - n + 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    found = at[np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts)] | np.uint64(1 << 63)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[bounds[:-1][counts > 0]] = True
    return found[new], np.concatenate([[0], np.cumsum(new)])[bounds]


class Order:
    """The global order: frequent n-grams become their rank (0 is the most frequent), others stay and come after them."""

    def __init__(self, hot: np.ndarray):
        self.rank = np.argsort(hot).astype(np.uint64)
        self.known = hot[self.rank.astype(np.int64)]

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(s) or not len(self.known):
            return s
        k = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        hot = self.known[k] == s
        return np.concatenate([np.sort(self.rank[k[hot]]), s[~hot]]) if hot.any() else s


def together(texts: pa.Array) -> Iterator[list[bytes]]:
    """Neighbouring texts, lists of about TOGETHER bytes and at most TOGETHER_TEXTS of them."""
    held, size = [], 0
    for text in texts:
        held.append(utf8(text.as_py()))
        size += len(held[-1])
        if size >= TOGETHER or len(held) >= TOGETHER_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def frequent(docs: DataFrame, n: int) -> DataFrame:
    """Frequent n-grams of all documents, the most frequent first, at most HOT_LIMIT: gram, n_docs. Only the order of n-grams rests on it.

    Tasks count within chunks of about CHUNK n-grams and report those of 4 or more.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= 4
            return pa.record_batch([pa.array(found[many].view(np.int64)), pa.array(times[many])], names=["gram", "n"])

        for b in batches:
            for texts in together(b.column(0)):
                held.append(grams(texts, n)[0])
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    sums = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n_docs"))
    return sums.where(F.col("n_docs") >= HOT_ROWS).orderBy(F.desc("n_docs"), "gram").limit(HOT_LIMIT)


def prefix_length(size: int, percent: int) -> int:
    """How many of the rarest n-grams a set is found by; none if no other set can reach the threshold with it."""
    return 0 if 100 * size < percent * (size + 1) else size - -(-percent * size // 100) + 1


def sketches(docs: DataFrame, n: int, keys: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id, size, digest, s0 .. s7 (parity sketch) and keys of every document; keys makes a set's bucket keys, 64-bit integers."""

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, bits, found = [], [], [np.zeros((0, SKETCH), np.int64)], [np.zeros(0, np.int64)]
            for texts in together(b.column(1)):
                flat, bounds = grams(texts, n)
                sets = [flat[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                sizes += map(len, sets)
                digests += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                of = np.repeat(np.arange(len(sets)), np.diff(bounds)) * (64 * SKETCH) + (flat & np.uint64(64 * SKETCH - 1)).astype(np.int64)
                parity = np.bincount(of, minlength=len(sets) * 64 * SKETCH).astype(np.uint8) & 1
                bits.append(np.packbits(parity).view(np.int64).reshape(-1, SKETCH))
                found += [keys(s).astype(np.int64) for s in sets]  # copies, else they hold the sets until the batch ends
            bits = np.concatenate(bits)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(e) for e in found]).astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(bits[:, j].copy()) for j in range(SKETCH)), lists], names=["id", "size", "digest", *(f"s{j}" for j in range(SKETCH)), "keys"])

    return docs.select("id", "text").mapInArrow(rows, "id long, size long, digest binary, " + "".join(f"s{j} long, " for j in range(SKETCH)) + "keys array<long>")


def rare_ends(order: Order, percent: int) -> Callable[[np.ndarray], np.ndarray]:
    """The rarest n-grams of a set, the rarest first: linked sets share one of them."""
    return lambda s: order.of(s)[::-1][: prefix_length(len(s), percent)]


def can_link(x: str, y: str, percent: int) -> Column:
    """Bounds that linked sets keep: sizes, and the sketches' distance (at most the sets' difference)."""
    c = lambda t, k: F.col(f"{t}.{k}")
    a, b = c(x, "size"), c(y, "size")
    apart = sum((F.bit_count(c(x, f"s{j}").bitwiseXOR(c(y, f"s{j}"))) for j in range(1, SKETCH)), F.bit_count(c(x, "s0").bitwiseXOR(c(y, "s0"))))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (apart * (100 + percent) <= (a + b) * (100 - percent))


class PrefixTree:
    """Sorted sequences as a tree of compressed paths: a node is a run of neighbours and the stretch that all of them share."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.sets = [sets[k] for k in self.order]
        self.lengths = np.array([len(s) for s in self.sets], np.int64)
        self.shared = np.array([self._common(a, b) for a, b in zip(self.sets, self.sets[1:])], np.int64)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def join(self, probes: list[np.ndarray], possible: Callable, links: Callable) -> Iterator[tuple[int, np.ndarray]]:
        """(stored set, probes that link with it), by place.

        possible(stored, depth, overlap, left): which probes can still link with one of the stored sets, after their first
        `depth` items; overlap is what a probe shares with these, left what it has beyond them.
        links(k, overlap): which probes link with the k-th stored set. Both get arrays with a value a probe.
        """
        sizes = np.array([len(p) for p in probes], np.int64)
        items, rank = np.unique(np.concatenate([np.zeros(0, np.uint64), *probes]), return_inverse=True)
        owner = np.repeat(np.arange(len(probes)), sizes)
        placed = owner * len(items) + rank  # ascending, as probes are sorted
        who = owner[np.argsort(rank, kind="stable")]
        first = np.searchsorted(np.sort(rank), np.arange(len(items) + 1))
        begins = np.cumsum(sizes) - sizes
        stack = [(0, len(self.sets), 0, np.zeros(len(probes), np.int64))] if self.sets and probes else []
        while stack:
            low, high, depth, overlap = stack.pop()
            end = int(self.shared[low : high - 1].min()) if high - low > 1 else int(self.lengths[low])
            left = sizes
            if end > depth:
                stretch = self.sets[low][depth:end]
                at = np.searchsorted(items, stretch)
                at = at[items[np.minimum(at, len(items) - 1)] == stretch] if len(items) else at[:0]
                n = first[at + 1] - first[at]
                hits = who[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                overlap = overlap + np.bincount(hits, minlength=len(probes))
            if end:
                passed = np.searchsorted(items, self.sets[low][end - 1], "right")
                left = sizes - (np.searchsorted(placed, np.arange(len(probes)) * len(items) + passed) - begins)
            alive = possible(self.order[low:high], end, overlap, left)
            if not alive.any():
                continue
            overlap = np.where(alive, overlap, -(1 << 40))  # stays impossible below
            while low < high and self.lengths[low] == end:  # sets that end here come first
                found = np.flatnonzero(links(self.order[low], overlap))
                if len(found):
                    yield self.order[low], found
                low += 1
            if low < high:
                cuts = [low, *(low + 1 + np.flatnonzero(self.shared[low : high - 1] == end)), high]
                stack += [(int(a), int(b), end, overlap) for a, b in zip(cuts, cuts[1:])]


def tree_links(stored: list[np.ndarray], probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(stored set, probes whose Jaccard similarity with it reaches percent)."""
    sizes, sides = np.array([len(s) for s in stored], np.int64), np.array([len(p) for p in probes], np.int64)

    def possible(members, depth, overlap, left):
        """The best size of a subtree's set is the one that takes all that the probe has left, or the nearest to it."""
        size = np.clip(depth + left, sizes[members].min(), sizes[members].max())
        return (overlap + np.minimum(size - depth, left)) * (100 + percent) >= percent * (sides + size)

    def links(k, overlap):
        return 100 * overlap >= percent * (sizes[k] + sides - overlap)

    return PrefixTree(stored).join(probes, possible, links)


def keyed(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows by their first n_keys columns, which come together."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, lambda r: r[:n_keys])


def emitted(rows: Iterator[tuple], names: list[str], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows of longs as batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], names=names)


def dealt(rows: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and compressed text of the documents in ids (a written table of distinct ids), a written table.

    Up to a counted bound ids are broadcast, so texts aren't shuffled; beyond, both sides are shuffled by id.
    """

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([press.compress(utf8(t.as_py())) for t in b.column(1)], pa.binary())], names=["id", "packed"])

    return written(docs.join(bounded(ids), "id", "left_semi").select("id", "text").mapInArrow(rows, PACKED))


def set_reader(n: int, order: Order) -> Callable[[bytes], np.ndarray]:
    """The ordered set of a compressed text."""
    unpack = zstandard.ZstdDecompressor()
    return lambda packed: order.of(grams([unpack.decompress(packed)], n)[0])


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int, order: Order, links_of: Callable = tree_links) -> DataFrame:
    """The pairs (a, b) that reach the threshold by links_of (stored sets, probes, percent), a written table.

    The members of an owner a are dealt in slices by a counted number; its own text goes to each slice once.
    """

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = set_reader(n, order)

        def found():
            for (a, _), members in keyed(batches, 2):
                own, held, size = [], [], 0

                def links():
                    return sorted({(a, held[k][0]) for k, _ in links_of([s for _, s in held], own, percent)})

                for _, _, b, packed in members:  # the owner's rows come first
                    s = set_of(packed)
                    if b is None:
                        own.append(s)
                        continue
                    held.append((b, s))
                    size += len(s)
                    if size > BLOCK_GRAMS or len(held) >= BLOCK:
                        yield from links()
                        held, size = [], 0
                if held:
                    yield from links()

        return emitted(found(), ["a", "b"])

    pairs = written(pairs)
    if not pairs.limit(1).count():
        return pairs
    ends = pairs.select(F.col("a").alias("id"), F.lit(1).alias("n")).union(pairs.select("b", F.lit(0)))
    ends = written(ends.groupBy("id").agg(F.ceil(F.sum("n") / SLICE).alias("slices")))
    owners = ends.where("slices > 0").select(F.col("id").alias("a"), "slices")
    texts = packed_texts(docs, ends.select("id"))
    of = lambda side: texts.select(F.col("id").alias(side), "packed")
    theirs = pairs.join(of("b"), "b").join(bounded(owners), "a").select("a", F.expr("pmod(xxhash64(b), slices)").alias("slice"), "b", "packed")
    mine = owners.join(of("a"), "a").select("a", F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"), F.lit(None).cast("long").alias("b"), "packed")
    return written(dealt(theirs.union(mine), ["a", "slice"], ["b"]).mapInArrow(rows, "a long, b long"))


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends aren't in one component yet."""
    of = lambda side: bounded(groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def can_reach(percent: int) -> Column:
    """Whether n_shared n-grams in both rare ends leave room for a link of sets of `small` and `large` n-grams.

    What isn't in both ends lies behind the end that stops first, and so is at most what follows it.
    """
    behind = F.ceil(F.col("large") * percent / 100) - 1
    return (F.col("n_shared") + behind) * (100 + percent) >= (F.col("small") + F.col("large")) * percent


def size_class(size: Column, percent: int) -> Column:
    """Sets whose sizes don't forbid a link are in the same or in neighbouring classes."""
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    return F.floor(F.log(size) / width).cast("int")


def cells(rest: DataFrame) -> DataFrame:
    """How each bucket that still holds several components is cut up: a row for each of its size classes, a written table.

    gram, weight (buckets with the same members, which are one), class, main (the class's largest component), others and
    mains (blocks of its members outside and inside of main), and the same of the classes beside it. A bucket of up to
    BUCKET members isn't cut: whole.
    """
    hashes = [F.xxhash64("id"), F.xxhash64("id", F.lit(1))]
    several = lambda c: F.bit_xor(c).alias(c)
    found = rest.groupBy("gram", "class", "component").agg(F.count("*").alias("k"), *[F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(hashes)])
    found = found.groupBy("gram", "class").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("main"), F.min("component").alias("low"), F.max("component").alias("high"), several("x0"), several("x1"))
    blocks = lambda c: F.ceil(c / BUCKET)
    one = F.struct("class", "main", blocks(F.col("n") - F.col("most")).alias("others"), blocks(F.col("most")).alias("mains"))
    found = found.groupBy("gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), several("x0"), several("x1"), F.collect_list(one).alias("classes"))
    found = found.where("low < high").groupBy("n", "x0", "x1").agg(F.min("gram").alias("gram"), F.count("*").alias("weight"), F.min_by("classes", "gram").alias("classes"))
    beside = lambda step, name: F.expr(f"get(filter(classes, c -> c.class = own.class + {step}), 0)").alias(name)
    found = found.select("gram", "weight", (F.col("n") <= BUCKET).alias("whole"), "classes", F.explode("classes").alias("own"))
    return written(found.select("gram", "weight", "whole", F.col("own.class").alias("class"), F.struct("own.main", "own.others", "own.mains").alias("own"), beside(-1, "before"), beside(1, "after")))


def met(rest: DataFrame, sets: DataFrame, percent: int, count_shared: bool = True) -> DataFrame:
    """Pairs (a, b) of two components that meet in buckets and may link by size and sketch.

    With count_shared also by the number of buckets that they share, which is that of n-grams in both rare ends.
    rest: gram, id, class, component. sets: id, size and sketch of every node. Members of a bucket are compared in blocks
    of neighbouring sizes; only pairs that pass leave a task, with the weight of their bucket.
    """

    def near(x: tuple, y: tuple) -> np.ndarray:
        """The table of members that may link: of other components, near in size and sketch."""
        (size, component, bits), (sides, groups, others) = x, y
        size, component = size[:, None], component[:, None]
        differ = sum(np.bitwise_count(bits[:, k, None] ^ others[:, k]).astype(np.int64) for k in range(SKETCH))
        return (component != groups) & (100 * np.minimum(size, sides) >= percent * np.maximum(size, sides)) & (differ * (100 + percent) <= (size + sides) * (100 - percent))

    def pairs(weight: int, members: list[tuple]) -> Iterator[tuple]:
        members.sort(key=lambda m: m[3])
        close = [100 * x[3] >= percent * y[3] for x, y in zip(members, members[1:])]
        members = [m for m, before, after in zip(members, [False, *close], [*close, False]) if before or after]
        stored, probes = [m for m in members if m[0]], [m for m in members if m[1]]
        if not stored or not probes:
            return
        of = lambda ms: (np.array([m[3] for m in ms]), np.array([m[4] for m in ms]), np.array([m[5:] for m in ms], np.int64).view(np.uint64))
        found = {}
        for i, j in np.argwhere(near(of(stored), of(probes))).tolist():
            (_, _, a, small, *_), (_, _, b, large, *_) = stored[i], probes[j]
            found[min(a, b), max(a, b)] = (min(small, large), max(small, large))
        for (a, b), (small, large) in found.items():
            yield a, b, small, large, weight

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (pair for (*_, weight), members in keyed(batches, 6) for pair in pairs(weight, [m[6:] for m in members]))
        return emitted(found, ["a", "b", "small", "large", "weight"])

    sketch = [f"s{k}" for k in range(SKETCH)]
    placed = rest.join(cells(rest).hint("merge"), ["gram", "class"]).join(sets, "id")
    placed = placed.withColumn("is_main", F.expr("component = own.main")).withColumn("i", F.expr("if(is_main, own.others + pmod(xxhash64(id), own.mains), pmod(xxhash64(id), own.others))"))
    upto = "if({n} > 0, sequence(0L, {n} - 1), cast(array() as array<bigint>))".format
    within = upto(n="(own.others + if(is_main, 0, own.mains))")
    met_by = lambda side: upto(n=f"coalesce({side}.others + if(is_main and {side}.main = own.main, 0, {side}.mains), 0)")
    cell = "named_struct('c', {0}, 'low', {1}, 'd', {2}, 'high', {3}, 'stored', {4}, 'probe', {5})".format
    alone = cell("0", "0L", "0", "0L", "true", "true")
    placed = placed.withColumn("cell", F.explode(F.expr(f"""if(whole, array({alone}), concat(
        transform({within}, j -> {cell("class", "least(i, j)", "class", "greatest(i, j)", "i <= j", "i >= j")}),
        transform({met_by("after")}, j -> {cell("class", "i", "class + 1", "j", "true", "false")}),
        transform({met_by("before")}, j -> {cell("class - 1", "j", "class", "i", "false", "true")})))""")))  # fmt: skip
    keys = ["gram", "c", "low", "d", "high"]
    placed = placed.select("gram", *[f"cell.{k}" for k in keys[1:]], "weight", "cell.stored", "cell.probe", "id", "size", "component", *sketch)
    found = dealt(placed, keys).mapInArrow(rows, "a long, b long, small long, large long, weight long")
    if not count_shared:
        return found.select("a", "b").distinct()
    return found.groupBy("a", "b", "small", "large").agg(F.sum("weight").alias("n_shared")).where(can_reach(percent)).select("a", "b").distinct()


def link_counts(docs: DataFrame, groups: DataFrame, own: DataFrame, n: int, percent: int, order: Order) -> DataFrame:
    """id and n_links, the number of other sets that a node of groups (node, component) links with, a written table.

    A component is cut into blocks by its counted n-grams; each two blocks meet in a task. own: id and size of sets that differ.
    """

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = set_reader(n, order)

        def found():
            for (_, low, high), members in keyed(batches, 3):
                sides: dict[int, list] = {low: [], high: []}
                for _, _, _, block, node, packed in members:
                    sides[block].append((node, set_of(packed)))
                links = set()
                stored, probes = sides[low], sides[high]
                for k, near in tree_links([s for _, s in stored], [s for _, s in probes], percent):
                    a = stored[k][0]
                    links.update((a, b) if a < b else (b, a) for b in (probes[p][0] for p in near) if a != b)
                tally: dict[int, int] = {}
                for pair in links:
                    for x in pair:
                        tally[x] = tally.get(x, 0) + 1
                yield from tally.items()

        return emitted(found(), ["id", "n_links"])

    nodes = own.join(bounded(groups.withColumnRenamed("node", "id")), "id").groupBy("id")
    nodes = written(nodes.agg(F.min("component").alias("component"), F.sum("size").alias("size"), F.count("*").alias("n")))
    blocks = F.greatest(F.ceil(F.sum("size") / BLOCK_GRAMS), F.ceil(F.sum("n") / BLOCK)).alias("blocks")
    blocks = written(nodes.groupBy("component").agg(blocks))
    texts = packed_texts(docs, nodes.select("id"))
    placed = nodes.select("id", "component").join(bounded(blocks), "component").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    placed = placed.join(texts, "id").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = placed.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "packed")
    return written(dealt(placed, ["component", "low", "high"]).mapInArrow(rows, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links")))


def same_sets(sets: DataFrame) -> DataFrame:
    """id and rep of every row whose set is also that of a lesser id, the least, a written table."""
    several = written(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("digest", "rep"))
    return written(sets.select("id", "digest").join(bounded(several), "digest").where("id <> rep").select("id", "rep").distinct())


def grouped(docs: DataFrame, own: DataFrame, n: int, percent: int, order: Order, links_of: Callable = tree_links, count_shared: bool = True) -> DataFrame:
    """node and component of every set that links with another one that it meets in a bucket, a written table.

    docs: id, text. own: id, size, sketch and keys of sets that differ. count_shared: as of `met`.
    """
    check = lambda pairs: verified(docs, pairs, n, percent, order, links_of)
    of = own.select("id", "size", *[f"s{k}" for k in range(SKETCH)]).dropDuplicates(["id", "size", "s0"])
    tokens = own.select(F.explode("keys").alias("gram"), "id", size_class(F.col("size"), percent).alias("class"))
    buckets = written(tokens.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("gram", "low", "n"))
    places = written(tokens.join(buckets.hint("merge"), "gram").select("gram", "id", "class", "low", "n"))

    star = places.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    star = star.alias("p").join(of.alias("y"), F.col("p.b") == F.col("y.id")).join(of.alias("x"), (F.col("p.a") == F.col("x.id")) & can_link("x", "y", percent)).select("a", "b")
    star = written(star)  # ids that repeat with other sets may repeat pairs; distinct would keep frequent owners from being split
    groups = components(check(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    more = check(apart(star, groups))
    if more.limit(1).count():
        groups = components(more, known=groups)

    rest = places.where("n > 2 and id <> low").join(bounded(groups), F.col("id") == F.col("node"), "left").select("gram", "id", "class", F.coalesce("component", "id").alias("component"))
    last = check(met(written(rest), of, percent, count_shared))
    if last.limit(1).count():
        groups = components(last, known=groups)
    return groups


def linked(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """Per row: id, n_shingles and component_id, the least id that links lead to; with count_links also n_links, how many other sets link with its set."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = Order(frequent(docs, n).toArrow().column("gram").to_numpy().view(np.uint64))
    table = written(sketches(docs, n, rare_ends(order, percent)))
    sets = table.where("size > 0 and id is not null")
    copies = same_sets(sets)
    own = sets.join(bounded(copies), "id", "left_anti")
    groups = grouped(docs, own, n, percent, order)

    out = table.select("id", "size").join(bounded(copies), "id", "left").withColumn("own", F.coalesce("rep", "id"))
    out = out.join(bounded(groups), F.col("own") == F.col("node"), "left")
    columns = [F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "own").alias("component_id")]
    if count_links:
        counted = link_counts(docs, groups, own.select("id", "size"), n, percent, order).withColumnRenamed("id", "counted")
        out = out.join(bounded(counted), F.col("own") == F.col("counted"), "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.select(*columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):  # what is left to run after it has no Python
        return linked(read(spark, sf_dir, "documents"), count_links=True)
