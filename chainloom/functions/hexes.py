"""Hex quantities, 256-bit numbers and static ABI words, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO256 = "0" * 64
#: An empty logs bloom: 0x and 512 zeros.
EMPTY_BLOOM = "0x" + "0" * 512
MAX_U64 = "18446744073709551615"
LIMBS = 8


def digits(h: Column) -> Column:
    """The hex digits after the two characters of the prefix; null where they aren't hex digits."""
    d = F.lower(F.substring(h, 3, 1 << 20))
    return F.when(d.rlike("^[0-9a-f]+$"), F.regexp_replace(d, "^0+(?=.)", ""))


def to_u64(h: Column) -> Column:
    """decimal(20,0): missing, empty or malformed gives 0, too large the largest value."""
    d = digits(h)
    small = F.conv(F.when(F.length(d) <= 16, d), 16, 10).cast("decimal(20,0)")
    return F.when(F.length(d) > 16, F.lit(MAX_U64).cast("decimal(20,0)")).otherwise(F.coalesce(small, F.lit(0).cast("decimal(20,0)")))


def to_index(h: Column) -> Column:
    """bigint, for block numbers and indexes; like to_u64, but null beyond bigint."""
    d = digits(h)
    fits = (F.length(d) < 16) | ((F.length(d) == 16) & (d < "8"))
    return F.when(d.isNull(), F.lit(0).cast("bigint")).when(fits, F.conv(F.when(fits, d), 16, 10).cast("bigint"))


def to_u256(h: Column) -> Column:
    """64 hex digits: missing or empty gives 0, malformed or over 256 bits null."""
    d = digits(h)
    return F.when(h.isNull() | (h == ""), F.lit(ZERO256)).when(F.length(d) <= 64, F.lpad(d, 64, "0"))


def u256_of(n: Column) -> Column:
    """64 hex digits of a number of at least 0."""
    return F.lpad(F.lower(F.hex(n.cast("bigint"))), 64, "0")


def u256_of_decimal(n: Column) -> Column:
    """64 hex digits of a decimal of at least 0 and up to 38 digits."""
    wide, step = n.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(20,0)")
    parts = []
    for _ in range(4):
        rest = (wide % step).cast("bigint")
        parts.append(F.lpad(F.lower(F.hex(rest)), 8, "0"))
        wide = ((wide - rest.cast("decimal(20,0)")) / step).cast("decimal(38,0)")
    return F.concat(F.lit("0" * 32), *reversed(parts))


def limbs(x: Column) -> list[Column]:
    """Eight 32-bit limbs as bigint, the most significant first."""
    return [F.conv(F.substring(x, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(LIMBS)]


def sum_u256(x: Column) -> list[Column]:
    """Partial sums of the limbs, to be given to carried(); each is exact below 2^31 rows a group."""
    return [F.sum(v) for v in limbs(x)]


def carried(sums: list[Column]) -> Column:
    """64 hex digits of limb sums; null if the total has over 256 bits."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("carry"), F.lit("").alias("out"))
    parts = F.array(*[F.coalesce(s, zero) for s in reversed(sums)])
    low = lambda s, v: s["carry"] + v
    step = lambda s, v: F.struct(F.shiftright(low(s, v), 32).alias("carry"), F.concat(F.lpad(F.lower(F.hex(low(s, v).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), s["out"]).alias("out"))
    done = F.aggregate(parts, start, step)
    return F.when(done["carry"] == 0, done["out"])


def decimal_text(x: Column) -> Column:
    """The decimal digits of 64 hex digits: nine digits of base 10^9, each limb multiplied in."""
    base, zeros = 10**9, F.array(*[F.lit(0).cast("bigint")] * 9)
    empty = F.array().cast("array<bigint>")

    def times(digits_: Column, limb: Column) -> Column:
        start = F.struct(limb.alias("carry"), empty.alias("out"))
        at = lambda s, d: d * F.lit(1 << 32) + s["carry"]
        step = lambda s, d: F.struct(((at(s, d) - at(s, d) % base) / F.lit(base).cast("decimal(20,0)")).cast("bigint").alias("carry"), F.concat(s["out"], F.array(at(s, d) % base)).alias("out"))
        return F.aggregate(digits_, start, step, lambda s: s["out"])

    least_first = F.aggregate(F.array(*limbs(x)), zeros, times)
    text = F.aggregate(least_first, F.lit(""), lambda s, d: F.concat(F.lpad(d.cast("string"), 9, "0"), s))
    return F.when(x.isNotNull(), F.regexp_replace(text, "^0+(?=.)", ""))


def of_literal(number: str) -> str | None:
    """64 hex digits of a decimal or 0x literal; None if it isn't one of up to 256 bits."""
    text = number.strip()
    try:
        value = int(text, 16) if text[:2].lower() == "0x" else int(text)
    except ValueError:
        return None
    return f"{value:064x}" if 0 <= value < 1 << 256 else None


def as_double(sums: list[Column]) -> Column:
    """The sum of limb sums as a double."""
    return sum((s.cast("double") * float(1 << 32 * (LIMBS - 1 - k)) for k, s in enumerate(sums)), F.lit(0.0))


def selector(data: Column) -> Column:
    """The first ten characters of a call's input; shorter input has none."""
    return F.when(F.length(data) >= 10, F.substring(data, 1, 10)).otherwise("")


def topic(topics: Column, i: int) -> Column:
    return F.coalesce(F.get(topics, i), F.lit(""))


def bloom_set(bloom: Column) -> Column:
    """Whether any bit of a bloom is set; a bare prefix counts as zero."""
    return ~bloom.rlike("^0x0*$")


def abi_word(data: Column, i: int, start: int = 3) -> Column:
    """The i-th 32-byte word of ABI data, as 64 hex digits; null where the data ends before it. start: 3 skips 0x, 11 a selector too."""
    word = F.lower(F.substring(data, start + 64 * i, 64))
    return F.when(F.length(word) == 64, word)


def abi_static(word: Column, kind: str) -> Column:
    """A static value of an ABI word: address, bool, intN and uintN up to 256 bits, bytesN."""
    if kind == "address":
        return F.concat(F.lit("0x"), F.substring(word, 25, 40))
    if kind == "bool":
        return F.when(word.isNotNull(), word != ZERO256).cast("string")
    if kind.startswith("bytes") and kind[5:].isdigit():
        return F.concat(F.lit("0x"), F.substring(word, 1, 2 * int(kind[5:])))
    if kind.startswith(("uint", "int")):
        number = F.conv(F.when(F.substring(word, 1, 48) == "0" * 48, F.substring(word, 49, 16)), 16, 10)
        return F.coalesce(number, F.concat(F.lit("0x"), word))
    raise ValueError(f"no static ABI type: {kind}")


def parameters(signature: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """(canonical signature, [(type, name, indexed)]) of "Name(type [indexed] [name], ...)"."""
    name, _, rest = signature.strip().partition("(")
    inside = rest.rpartition(")")[0]
    found = []
    for k, part in enumerate(p.split() for p in inside.split(",") if p.strip()):
        indexed = "indexed" in part[1:]
        names = [x for x in part[1:] if x != "indexed"]
        kind = {"uint": "uint256", "int": "int256"}.get(part[0], part[0])
        found.append((kind, names[0] if names else f"arg{k}", indexed))
    return f"{name}({','.join(t for t, _, _ in found)})", found
