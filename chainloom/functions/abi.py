"""Decoding of ABI data by a signature, as built-in column expressions.

A signature's types are read into a tree (Kind) and the tree is compiled to nested reads of offsets. A value of a static
type is a text, one of a list or tuple is a JSON text: lists as arrays, tuples as objects by the names of their parts.

What can't be read is null where it stands, and the parts around it stay: what ends before its value does, an offset or
length that doesn't fit, data that isn't hex. Elements of lists have to lie in their order without overlap, as encoders
write them, otherwise the list is null: so what is decoded never outgrows the data, however the offsets are nested.
Texts that aren't UTF-8 have replacement characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.hexes import abi_static
from chainloom.functions.keccak import call_selector, event_topic

STATIC = re.compile(r"address|bool|u?int(\d{0,3})|bytes([1-9]|[12]\d|3[0-2])")
TOKEN = re.compile(r"\s*([A-Za-z_$][\w$]*|\[\d*\]|[(),])")


@dataclass(frozen=True)
class Kind:
    """A type: base is a static type's name, "string", "bytes", "list" or "tuple"."""

    base: str
    parts: tuple[tuple[str, Kind], ...] = ()  # (name, type) of a tuple's parts, or a list's element
    count: int | None = None  # of a list of fixed length

    @property
    def dynamic(self) -> bool:
        return self.base in ("string", "bytes") or (self.base == "list" and self.count is None) or any(k.dynamic for _, k in self.parts)

    @property
    def nested(self) -> bool:
        return self.base in ("list", "tuple")

    @property
    def head(self) -> int:
        """Words that a value takes where it stands; a dynamic one's offset is one."""
        return 1 if self.dynamic or not self.nested else (self.count or 1) * sum(k.head for _, k in self.parts)

    def __str__(self) -> str:
        if self.base == "list":
            return f"{self.parts[0][1]}[{'' if self.count is None else self.count}]"
        return f"({','.join(str(k) for _, k in self.parts)})" if self.base == "tuple" else self.base


class _Reader:
    """The tokens of a signature, from left to right."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            found = TOKEN.match(text, at)
            if not found:
                raise ValueError(f"no signature: {text}")
            self.tokens.append(found[1])
            at = found.end()

    def peek(self) -> str:
        return self.tokens[0] if self.tokens else ""

    def take(self, expected: str | None = None) -> str:
        if not self.tokens or expected not in (None, self.tokens[0]):
            raise ValueError(f"no signature: {self.text}")
        return self.tokens.pop(0)

    def kind(self) -> Kind:
        word = self.peek()
        if word == "tuple":
            self.take()
        if self.peek() == "(":
            parts = self.parameters()
            if not parts:
                raise ValueError(f"empty tuple: {self.text}")
            found = Kind("tuple", tuple((name, kind) for kind, name, _ in parts))
        else:
            base = {"uint": "uint256", "int": "int256"}.get(self.take(), word)
            bits = STATIC.fullmatch(base)
            if base not in ("string", "bytes") and not (bits and (not bits[1] or (int(bits[1]) % 8 == 0 and 8 <= int(bits[1]) <= 256))):
                raise ValueError(f"unknown type: {word} in {self.text}")
            found = Kind(base)
        while self.peek().startswith("["):
            size = self.take()[1:-1]
            if size and not int(size):
                raise ValueError(f"list without elements: {self.text}")
            found = Kind("list", (("", found),), int(size) if size else None)
        return found

    def parameters(self) -> list[tuple[Kind, str, bool]]:
        """(type, name, indexed) of each in parentheses; what has no name is arg<place>."""
        self.take("(")
        found = []
        while self.peek() != ")":
            if found:
                self.take(",")
            kind, words = self.kind(), []
            while self.peek() not in (",", ")", ""):
                words.append(self.take())
            names = [w for w in words if w not in ("indexed", "memory", "calldata", "storage", "payable")]
            if len(names) > 1 or any(not re.fullmatch(r"[A-Za-z_$][\w$]*", n) for n in names):
                raise ValueError(f"no signature: {self.text}")
            found.append((kind, names[0] if names else f"arg{len(found)}", "indexed" in words))
        self.take(")")
        if len({name for _, name, _ in found}) < len(found):
            raise ValueError(f"a name stands twice: {self.text}")
        return found


def kind_of(text: str) -> Kind:
    """The Kind of a type such as "(address to, uint256[2] range)[]"."""
    reader = _Reader(text)
    found = reader.kind()
    if reader.tokens:
        raise ValueError(f"unknown type: {text}")
    return found


def checked(signature: str) -> tuple[str, list[tuple[Kind, str, bool]]]:
    """(canonical signature, [(type, name, indexed)]) of "Name(type [indexed] [name], ...)"; raises ValueError."""
    reader = _Reader(signature)
    name = reader.take()
    if not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
        raise ValueError(f"no signature: {signature}")
    found = reader.parameters()
    if reader.tokens:
        raise ValueError(f"no signature: {signature}")
    return f"{name}({','.join(str(kind) for kind, _, _ in found)})", found


def word(data: Column, at: Column | int, start: int) -> Column:
    """The 32-byte word that begins at byte `at` after character `start` (from 1); null where the data ends before it."""
    found = F.lower(F.substring(data, F.lit(start) + F.lit(2).cast("long") * at, F.lit(64)))
    return F.when((F.length(found) == 64) & found.rlike("^[0-9a-f]*$"), found)


def small(w: Column) -> Column:
    """A word as a number, null from 2^32 on: offsets and lengths beyond that fit no data."""
    return F.conv(F.when(F.substring(w, 1, 56) == "0" * 56, F.substring(w, 57, 8)), 16, 10).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: expressions that use a place several times would double at each level."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _word_at(data: Column, at: Column, end: Column) -> Column:
    """The word at byte `at` of binary data, as hex digits; null unless it ends by `end`."""
    return F.when((at >= 0) & (at + 32 <= end), F.lower(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(32)))))


def _read(data: Column, at: Column, end: Column, kind: Kind) -> Column:
    """The value encoded at byte `at` of binary data, which may reach up to byte `end`: a text, array or struct."""
    if kind.base == "tuple":
        return F.struct(*[c.alias(name) for name, c in _parts(data, at, end, kind)])
    if kind.base == "list":
        element = kind.parts[0][1]
        if kind.count is not None:
            return _elements(data, at, end, element, F.lit(kind.count).cast("long"))
        return bound(small(_word_at(data, at, end)), lambda n: _elements(data, at + 32, end, element, n))
    if kind.dynamic:
        length = small(_word_at(data, at, end))

        def content(n: Column) -> Column:
            found = F.when(at + 32 + n <= end, F.substring(data, (at + 33).cast("int"), n.cast("int")))
            return F.concat(F.lit("0x"), F.lower(F.hex(found))) if kind.base == "bytes" else F.make_valid_utf8(found.cast("string"))

        return bound(length, content)
    return abi_static(_word_at(data, at, end), kind.base)


def _parts(data: Column, at: Column, end: Column, kind: Kind) -> list[tuple[str, Column]]:
    """(name, value) of a tuple's parts; the offset of a dynamic part counts from the tuple's begin."""
    found, head = [], 0
    for name, part in kind.parts:
        here = at + 32 * head
        inside = bound(at + small(_word_at(data, here, end)), lambda o: _read(data, o, end, part)) if part.dynamic else _read(data, here, end, part)
        found.append((name, inside))
        head += part.head
    return found


def _elements(data: Column, begin: Column, end: Column, element: Kind, n: Column) -> Column:
    """n elements from byte `begin` on; null if they don't fit."""
    size = 32 * element.head
    fits = (n >= 0) & (begin + n * size <= end)
    places = F.when(fits & (n > 0), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))  # guarded itself: it may be computed before what asks for it
    if not element.dynamic:
        return F.when(fits, F.transform(places, lambda i: _read(data, begin + size * i, end, element)))

    def values_at(offsets: Column) -> Column:
        follows = lambda i: F.when(i + 1 < n, F.get(offsets, (i + 1).cast("int"))).otherwise(end - begin)
        ordered = F.forall(places, lambda i: F.coalesce((F.get(offsets, i.cast("int")) >= n * 32) & (F.get(offsets, i.cast("int")) <= follows(i)), F.lit(False)))
        value = lambda i: bound(begin + F.get(offsets, i.cast("int")), lambda o: bound(begin + follows(i), lambda e: _read(data, o, e, element)))
        return F.when(ordered, F.transform(places, value))

    return bound(F.when(fits, F.transform(places, lambda i: small(_word_at(data, begin + 32 * i, end)))), values_at)


def values(data: Column, kinds: list[tuple[str | Kind, str]], start: int) -> Column:
    """{name: text} of (type, name) in order. Data of static values only is read word by word, without a copy of it."""
    if not kinds:
        return F.create_map().cast("map<string,string>")
    whole = Kind("tuple", tuple((name, kind_of(kind) if isinstance(kind, str) else kind) for kind, name in kinds))
    if not any(kind.nested or kind.dynamic for _, kind in whole.parts):
        return F.create_map(*[x for k, (name, kind) in enumerate(whole.parts) for x in (F.lit(name), abi_static(word(data, k * 32, start), kind.base))]).cast("map<string,string>")
    characters = F.floor((F.length(data) - (start - 1)) / 2).cast("int") * 2
    content = F.unhex(F.when(characters > 0, F.substring(data, F.lit(start), characters)))

    def texts(held: Column) -> Column:
        parts = _parts(held, F.lit(0).cast("long"), F.length(held).cast("long"), whole)
        return F.create_map(*[x for (name, kind), (_, c) in zip(whole.parts, parts) for x in (F.lit(name), F.to_json(c, {"ignoreNullFields": "false"}) if kind.nested else c)]).cast("map<string,string>")

    return bound(content, texts)


def event(logs: DataFrame, signature: str) -> DataFrame:
    """Logs of an event with `decoded`: name, signature, indexed_params, non_indexed_params. Indexed texts, lists and tuples are their hash."""
    canonical, found = checked(signature)
    indexed = [(kind, name) for kind, name, is_indexed in found if is_indexed]
    if len(indexed) > 3:
        raise ValueError(f"more than three indexed parameters: {signature}")
    topics = [x for k, (kind, name) in enumerate(indexed, 1) for x in (F.lit(name), F.lower(F.col(f"topic_{k}")) if kind.nested or kind.dynamic else abi_static(word(F.col(f"topic_{k}"), 0, 3), kind.base))]
    rest = values(F.col("data"), [(kind, name) for kind, name, is_indexed in found if not is_indexed], 3)
    of = F.create_map(*topics).cast("map<string,string>") if topics else F.create_map().cast("map<string,string>")
    decoded = F.struct(F.lit(canonical.partition("(")[0]).alias("name"), F.lit(canonical).alias("signature"), of.alias("indexed_params"), rest.alias("non_indexed_params"))
    return logs.where(F.lower("topic_0") == event_topic(canonical)).withColumn("decoded", decoded)


def call(transactions: DataFrame, signature: str) -> DataFrame:
    """Transactions that call a function, with `decoded`: name, signature, inputs."""
    canonical, found = checked(signature)
    inputs = values(F.col("data"), [(kind, name) for kind, name, _ in found], 11)
    decoded = F.struct(F.lit(canonical.partition("(")[0]).alias("name"), F.lit(canonical).alias("signature"), inputs.alias("inputs"))
    return transactions.where(F.lower(F.substring("data", 1, 10)) == call_selector(canonical)).withColumn("decoded", decoded)
