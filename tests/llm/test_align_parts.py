"""Documents aligned by their parts: as aligned whole, and each distinct part is encoded once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from chainloom.llm import alignment, tokens
from hypothesis import given, settings
from hypothesis import strategies as st

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["'", "'s", "\n", "\t", " ", " ", " ", "  ", "　", "\x1c", "\x85", "\x00", "word", "Word", "é", "Σας", "½", "7", "42", ".", "don't", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "\U0001f600", "ß", "\xa0", "▁", "\U000f0000", "ation"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=30)


def plain(found):
    return found and (*found[:5], np.sort(found.pairs).tolist())


@pytest.mark.parametrize("size, kept", [(1, 0), (60, 5), (8 << 20, 200_000)])
def test_parts_make_the_whole(monkeypatch, size, kept):
    monkeypatch.setattr(tokens, "SLICE_BYTES", size)
    monkeypatch.setattr(alignment, "KEPT_PARTS", kept)
    monkeypatch.setattr(alignment, "PARTS_AT_ONCE", 1 + kept // 2)
    both = alignment.Aligner(*PATHS)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.none() | TEXTS, max_size=12))
    def check(texts):
        got = both.documents(pa.array(["skipped", *texts], pa.string()).slice(1))
        assert [plain(x) for x in got] == [plain(both.document(t)) for t in texts]
        assert len(both.kept) <= kept

    check()


def test_a_part_is_encoded_once_for_all_texts_that_hold_it(monkeypatch):
    both, calls = alignment.Aligner(*PATHS), []
    pieces = both.pieces

    class Counted:
        def encode(self, texts, **kw):
            calls.extend([texts] if isinstance(texts, str) else texts)
            return pieces.encode(texts, **kw)

    texts = [f"start{k % 2} thonoushe, edath {k % 3}" for k in range(500)] * 2 + ["thonoushe, edath"]
    want = [plain(both.document(t)) for t in texts]
    monkeypatch.setattr(both, "pieces", Counted())
    assert [plain(x) for t in (texts, texts) for x in both.documents(pa.array(t))] == want * 2
    assert len(calls) == len(set(calls)) == 7
