"""Near duplicates by one-permutation hashing against all pairs."""

import random

import brute
import numpy as np
import pytest
from chainloom.llm import common, jaccard_join, near_duplicates
from edge_rows import by_id, each


def plain_rows(rows, n=2, percent=80):
    return {d: (size, root, d == root) for d, (size, root, _) in brute.jaccard(rows, n, percent).items()}


def test_whole_table_and_edges(docs, plain, edge, empty):
    for df, rows in each(docs, plain, edge):
        assert by_id(near_duplicates.near_duplicates(df, 2), "n_shingles", "component_id", "kept") == plain_rows(rows)
    assert near_duplicates.near_duplicates(empty).count() == 0


def mutated(seed):
    """Families of texts whose members share a passage with every other family, and drift apart by steps."""
    q = random.Random(seed)
    passage, rows = [f"p{k}" for k in range(40)], []
    for _ in range(12):
        w = [f"v{q.randint(0, 60)}" for _ in range(q.randint(1, 60))]
        for _ in range(8):
            w = list(w)
            for _ in range(q.choice([0, 1, 1, 3])):
                w[q.randrange(len(w))] = f"n{q.randint(0, 9)}"
            rows.append((len(rows), " ".join(q.choice([w, w, passage + w]))))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, None), (2, 3), (3, 2)])
def test_random(spark, monkeypatch, seed, block):
    """With small blocks and one bucket for nearly all, members of a bucket are dealt to several tasks."""
    if block:
        for name in ("BLOCK", "SLICE", "BUCKET"):
            monkeypatch.setattr(jaccard_join, name, block)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = mutated(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((2, 80), (5, 80)):
        got = by_id(near_duplicates.near_duplicates(df, n, percent), "n_shingles", "component_id", "kept")
        assert got == plain_rows(rows, n, percent)


@pytest.mark.parametrize("block", [4, 1000])
def test_bucket_of_all(spark, monkeypatch, block):
    """A single bucket that holds all sets loses no link either, whatever its least member links with."""
    monkeypatch.setattr(jaccard_join, "BUCKET", block)
    monkeypatch.setattr(near_duplicates, "bands", lambda *_: lambda s: np.ones(min(len(s), 1), np.uint64))
    rows = mutated(4)
    got = by_id(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2), "n_shingles", "component_id", "kept")
    assert got == plain_rows(rows)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"x{k}" for k in range(40))
    rows = [(1, text), (1, text), (None, text), (2, text + " end"), (3, "a b c d e"), (3, text + " fin"), (None, None), (4, "a b c d e"), (5, "a b c d e f")]
    df = spark.createDataFrame([(*x, "k", 1.5, None) for x in rows], "doc_id long, text string, id string, size double, keys string")
    got = near_duplicates.near_duplicates(df, 2).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.component_id, x.kept) for x in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False), (None, None, True)}


def test_signature_agrees_as_often_as_sets_do():
    """The share of bins that agree estimates the similarity, for full and for nearly empty signatures."""
    r = np.random.default_rng(5)
    places = near_duplicates.donors(128)
    for size in (4, 30, 600):
        shares = []
        for _ in range(300):
            items = np.unique(r.integers(0, 1 << 63, size + 1, dtype=np.uint64) | np.uint64(1 << 63))
            x, y = np.delete(items, 0), np.delete(items, r.integers(1, len(items)))
            shares.append((near_duplicates.signature(x, places) == near_duplicates.signature(y, places)).mean())
        assert abs(np.mean(shares) - (size - 1) / (size + 1)) < 0.03


def test_signature_by_definition():
    r = np.random.default_rng(6)
    places = near_duplicates.donors(16)
    for size in (1, 5, 80):
        s = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) | np.uint64(1 << 63))
        bins = {}
        for h in s.tolist():
            bins.setdefault((h >> 59) & 15, h)
        want = [bins.get(i) or bins[min(bins, key=lambda j: places[i, j])] for i in range(16)]
        assert near_duplicates.signature(s, places).tolist() == want
