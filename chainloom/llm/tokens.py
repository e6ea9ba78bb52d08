"""Token ids by the tokenizers library, with its results kept by word.

A text is cut at places that no pre-token of the tokenizer spans; each distinct piece is encoded once by the library's
own model and kept, up to a bound, as little-endian unsigned integers. Many texts are encoded together by
`Encoder.encode_all`: Arrow cuts them at spaces and finds the distinct parts, so that each is looked up once.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import keep

#: Unicode white space, and the splitting patterns of the two public vocabularies.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: str.split() also splits at these, which are no white space in Unicode.
SEPARATORS = regex.compile("[\x1c-\x1f]")
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: What BYTE_PATTERN is for ASCII texts; its \s and white space of Unicode are the same there.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Bytes of texts that are cut together.
SLICE_BYTES = 4 << 20


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Parts:
    """Texts cut at their spaces: the distinct parts, and each text's parts by place in that list.

    plain: whether a text can be read part by part: none is empty, and none begins or ends with white space.
    """

    texts: pa.Array
    distinct: list[str]
    codes: np.ndarray
    ends: np.ndarray
    plain: np.ndarray

    def each(self) -> Iterator[tuple[int, bool, list[int]]]:
        """Number, plain and the parts' places of each text."""
        for k, (a, b) in enumerate(zip([0, *self.ends[:-1].tolist()], self.ends.tolist())):
            yield k, bool(self.plain[k]), self.codes[a:b].tolist()


def cut_at_spaces(texts: pa.Array) -> Iterator[Parts]:
    """The parts of all texts, in slices of about SLICE_BYTES; a null text is one empty part."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(edges, edges[1:]):
        some = texts.slice(a, b - a)
        lists = pc.split_pattern(pc.fill_null(some, ""), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        plain = np.ones(len(some), bool)
        odd = np.fromiter((not p or p.strip() != p for p in distinct), bool, len(distinct))
        if odd.any():
            plain[np.searchsorted(ends, np.flatnonzero(odd[codes]), "right")] = False
        yield Parts(some, distinct, codes, ends, plain)


class Encoder:
    """ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    Without specials, strings of special tokens inside a text are plain text.
    """

    def __init__(self, path: str, limit: int = 400_000, specials: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.model = self.tokenizer.model
        self.lowers = self.tokenizer.normalizer is not None
        self.pattern = regex.compile(WORD_PATTERN if self.lowers else BYTE_PATTERN)
        self.chunks = regex.compile(f"[^{WHITE}]+" if self.lowers else f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.doubles = regex.compile(f"[{WHITE}][{WHITE}]|[{WHITE}]\\Z")
        self.letters = "".join(c for _, c in sorted(byte_letters().items()))
        self.limit, self.kept, self.pieces = limit, {}, {}

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token. One that a whole part between spaces could be is kept with those."""
        kept, key = (self.kept, text) if self.lowers else (self.kept, text[1:]) if text[0] == " " else (self.pieces, text)
        found = kept.get(key)
        if found is None:
            letters = charmap_decode(text.encode(), "strict", self.letters)[0]
            found = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(kept) < self.limit:
                kept[key] = found
        return found

    def chunk(self, text: str) -> bytes:
        if not self.lowers:
            return self.piece(text) if (text[1:] if text[0] == " " else text).isalpha() else b"".join(map(self.piece, self.pattern.findall(text)))
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in text):  # letters to one Unicode version and not to another
                return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.piece(text) if text.isalpha() else b"".join(map(self.piece, self.pattern.findall(text)))

    def part(self, text: str) -> bytes:
        """What stands between two single spaces; the one before it belongs to it in byte-level vocabularies."""
        if self.lowers:
            found = self.chunk(text)
        elif text.isalpha():
            found = self.piece(" " + text)
        elif text.isascii():
            found = b"".join(map(self.piece, ASCII_PATTERN.findall(" " + text)))
        else:
            found = b"".join(map(self.chunk, self.chunks.findall(" " + text)))
        if len(self.kept) < self.limit:
            self.kept[text] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        get, part = self.kept.get, self.part
        if self.lowers:
            parts = text.split() if not SEPARATORS.search(text) else self.chunks.findall(text)
            return np.frombuffer(b"".join([get(p) or part(p) for p in parts]), self.dtype)
        if self.doubles.search(text):
            return np.frombuffer(b"".join(map(self.chunk, self.chunks.findall(text))), self.dtype)
        first, *parts = text.split(" ")
        found = [b"".join(map(self.chunk, self.chunks.findall(first)))]
        found += [get(p) or part(p) for p in parts]
        return np.frombuffer(b"".join(found), self.dtype)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as by encode."""
        if self.lowers:
            yield from (self.encode(t.as_py()) for t in texts)
            return
        get, part = self.kept.get, self.part
        for cut in cut_at_spaces(texts):
            for s in self.specials:
                cut.plain &= ~pc.fill_null(pc.match_substring(cut.texts, s), False).to_numpy(zero_copy_only=False)
            found = [get(p) or part(p) for p in cut.distinct]
            for k, plain, codes in cut.each():
                if plain:
                    first = b"".join(map(self.chunk, self.chunks.findall(cut.distinct[codes[0]])))
                    yield np.frombuffer(first + b"".join(map(found.__getitem__, codes[1:])), self.dtype)
                else:
                    yield self.encode(cut.texts[k].as_py())


#: Parts, and pieces that follow no space, that an encoder keeps. Fewer take less memory and more time; ids are the same.
KEPT = 400_000


def encoder(path: str, specials: bool = True, limit: int = KEPT) -> Encoder:
    """One encoder a process and vocabulary, for the tasks of one function that a Python worker serves."""
    return keep(Encoder, path, limit, specials)
