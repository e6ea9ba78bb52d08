"""Alignment of two tokenizers against a plain version by ranges of bytes."""

import brute
import public_tokenizers
import pytest
from chainloom.llm import alignment
from edge_rows import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256 n_products".split()
ODD = [(20, "has ▁ inside"), (21, "<s> <unk> <|endoftext|> <0x41>"), (None, "one two one two"), (None, None), (20, "one two one two"), (20, "one two one two"), (22, "\u0000​\U000f0000"), (23, " a  b \n\n c ")]


def sorted_rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def test_whole_table_and_edges(spark, docs, plain, edge, empty):
    for df, rows in ((docs, plain), (edge, EDGE)):
        assert sorted_rows(alignment.aligned(df, *PATHS)) == sorted(brute.alignment(rows), key=str)
    assert alignment.aligned(empty, *PATHS).count() == 0


@pytest.mark.parametrize("limit", [0, 3, 40])
def test_pairs_beyond_the_bound(spark, monkeypatch, limit):
    """Some pairs, or all, are joined by a shuffle; batches of one document."""
    monkeypatch.setattr(alignment, "BATCH_LINKS", 1)
    rows = ODD + EDGE[:7] + [(30 + k, f"the word{k % 3} and another" * (k % 4)) for k in range(20)]
    df = spark.createDataFrame([(d, t, 1, None, "x") for d, t in rows], "doc_id long, text string, row int, pairs string, n string")
    assert sorted_rows(alignment.aligned(df, *PATHS, limit=limit)) == sorted(brute.alignment(rows), key=str)


def test_groups_are_real(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    got = alignment.token_groups(df, *PATHS).collect()
    assert len(got) == len(ODD)
    both = alignment.aligner(*PATHS)
    texts = sorted(b"".join(both.bytes_a[i] for a, _ in x.groups for i in a) for x in got)
    assert texts == sorted((" " + t).encode() if t and "▁" not in t else b"" for _, t in ODD)
    assert all(b"".join(both.bytes_a[i] for i in a) == b"".join(both.bytes_b[i] for i in b) for x in got for a, b in x.groups)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aeth \n1.éあ\U0001f600▁"), max_size=30))
def test_products_and_links(text):
    found = alignment.aligner(*PATHS).align(text)
    assert (found is None) == (brute.token_bytes(text) is None)
    if found:
        groups = found.groups()
        assert list(zip(*(x.tolist() for x in found.products()))) == [(a, b) for x, y in groups for a in x for b in y]
        assert set(zip(*(x.tolist() for x in found.links()))) <= {(a, b) for x, y in groups for a in x for b in y}
        assert alignment.aligner(*PATHS).text(found) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
