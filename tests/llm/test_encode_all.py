"""Texts encoded together: the library's ids, and each distinct part is looked up once."""

import public_tokenizers
import pyarrow as pa
import pytest
from chainloom.llm import tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PIECES = ["'", '"', "'s", "'that", "'re", "\n", "\t", " ", " ", "  ", "　", "\x1c", "\x1f", "\x85", "\x0b", "\x00", "word", "Word", "é", "Σας", "½", "²", "7", "42", ".", "…", "don't", "<|endoftext|>", "\U0001f600", "ß", "_", "\xa0", "​"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=30)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize("size", [1, 40, 8 << 20])
def test_texts_together_are_the_library(monkeypatch, name, specials, size):
    monkeypatch.setattr(tokens, "SLICE_BYTES", size)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = not specials
    coder = tokens.Encoder(public_tokenizers.path(name), limit=300, specials=specials)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.none() | TEXTS, max_size=12))
    def check(texts):
        got = coder.encode_all(pa.array(["skipped", *texts], pa.string()).slice(1))
        assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]

    check()


def test_a_part_is_encoded_once_for_all_texts_that_hold_it(monkeypatch):
    coder, calls = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), limit=0), []
    part = coder.part
    monkeypatch.setattr(coder, "part", lambda text: calls.append(text) or part(text))
    texts = [f"start{k % 2} thonoushe, edath {k % 3}" for k in range(500)]
    got = [x.tolist() for x in coder.encode_all(pa.array(texts))]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == len(set(calls)) <= 7
