"""Recursive ABI types against an encoder, and data that lies about its offsets."""

import json
import random

import pytest
from chainloom.functions import abi
from pyspark.sql import functions as F

word = lambda n: f"{n % (1 << 256):064x}"


def encoded(kind, value):
    """Hex of a value: heads first, then tails, with offsets from where the heads begin."""
    if kind.base == "list":
        inner = sequence([kind.parts[0][1]] * len(value), value)
        return inner if kind.count is not None else word(len(value)) + inner
    if kind.base == "tuple":
        return sequence([k for _, k in kind.parts], value)
    if kind.base in ("string", "bytes"):
        content = value.encode().hex() if kind.base == "string" else value
        return word(len(content) // 2) + content + "0" * (-len(content) % 64)
    return value.ljust(64, "0") if kind.base.startswith("bytes") else word(int(value))


def sequence(kinds, values):
    heads, tails, at = [], "", 32 * sum(k.head for k in kinds)
    for kind, value in zip(kinds, values):
        if kind.dynamic:
            heads.append(word(at + len(tails) // 2))
            tails += encoded(kind, value)
        else:
            heads.append(encoded(kind, value))
    return "".join(heads) + tails


def shown(kind, value):
    if kind.base == "list":
        return [shown(kind.parts[0][1], v) for v in value]
    if kind.base == "tuple":
        return {name: shown(k, v) for (name, k), v in zip(kind.parts, value)}
    if kind.base.startswith("bytes"):
        return "0x" + value
    return {"address": lambda v: f"0x{v:040x}", "bool": lambda v: str(bool(v)).lower()}.get(kind.base, str)(value)


def some(q, kind):
    if kind.base == "list":
        return [some(q, kind.parts[0][1]) for _ in range(q.randrange(4) if kind.count is None else kind.count)]
    if kind.base == "tuple":
        return [some(q, k) for _, k in kind.parts]
    if kind.base == "string":
        return "".join(q.choice("aé漢 0") for _ in range(q.randrange(45)))
    if kind.base.startswith("bytes"):
        return q.randbytes(int(kind.base[5:] or q.randrange(70))).hex()
    return q.randrange(2) if kind.base == "bool" else q.randrange(1 << 60)


SIGNATURES = [
    "a((uint256 n, bool flag) pair, uint8 last)",
    "b((address to, string memo)[] orders, uint[3][2] grid, string[] names)",
    "c(uint256[][] rows, bytes4[2][] marks, (bytes raw, (string s, int64[] v)[2] twice) deep)",
    "d(tuple(uint a, tuple(bytes[] x, bool y)[] b)[][2] all, bytes tail)",
]


@pytest.mark.parametrize("signature", SIGNATURES)
def test_nested_values(spark, signature):
    q = random.Random(signature)
    canonical, found = abi.checked(signature)
    kinds = [k for k, _, _ in found]
    cases = [[some(q, k) for k in kinds] for _ in range(25)]
    rows = spark.createDataFrame([(i, "0x" + sequence(kinds, v)) for i, v in enumerate(cases)], "id int, data string")
    got = {r.id: r.m for r in rows.select("id", abi.values(F.col("data"), [(k, n) for k, n, _ in found], 3).alias("m")).collect()}
    for i, case in enumerate(cases):
        for (kind, name, _), value in zip(found, case):
            want = shown(kind, value)
            assert (json.loads(got[i][name]) if kind.nested else got[i][name]) == want, (canonical, name)


@pytest.mark.parametrize("signature", SIGNATURES)
def test_any_data_is_survived(spark, signature):
    """Words changed at random, data cut anywhere: no failure, and never more text than a few times the data."""
    q = random.Random(signature + "x")
    _, found = abi.checked(signature)
    kinds = [k for k, _, _ in found]
    cases = ["0x", "", "0xzz", None, "0x" + "f" * 640, "0x" + word(32) * 50, "0x" + "".join(word(32 * k) for k in range(60))]
    for _ in range(60):
        data = sequence(kinds, [some(q, k) for k in kinds])
        at = 64 * q.randrange(len(data) // 64)
        new = q.choice([0, 1, 32, 64, 96, 2**31, 2**32, 2**255, q.randrange(200)])
        data = data[:at] + word(new) + data[at + 64 :]
        cases.append("0x" + (data[: q.randrange(len(data) + 1)] if q.random() < 0.4 else data))
    rows = spark.createDataFrame([(c,) for c in cases], "data string")
    out = rows.select("data", abi.values(F.col("data"), [(k, n) for k, n, _ in found], 3).alias("m")).collect()
    assert len(out) == len(cases)
    assert all(sum(len(v or "") for v in (r.m or {}).values()) <= 40 * (len(r.data or "") + 200) for r in out)


def test_overlapping_elements_are_no_list(spark):
    """A list whose elements all point to one long list would be decoded to its square."""
    n = 300
    bomb = "0x" + word(32) + word(n) + word(32 * n) * n + word(n) + word(7) * n
    fine = "0x" + word(32) + word(2) + word(64) + word(128) + word(1) + word(7) + word(1) + word(8)
    back = "0x" + word(32) + word(2) + word(128) + word(64) + word(1) + word(7) + word(1) + word(8)
    rows = spark.createDataFrame([(0, bomb), (1, fine), (2, back), (3, fine[:-64] + "00")], "id int, data string")
    got = {r.id: r.m["v"] for r in rows.select("id", abi.values(F.col("data"), [("uint256[][]", "v")], 3).alias("m")).collect()}
    assert got[1] == '[["7"],["8"]]' and got[2] is None and got[3] == '[["7"],null]'
    assert json.loads(got[0])[:-1] == [None] * (n - 1)  # all but the last have no room


def test_texts_that_are_no_utf8(spark):
    data = "0x" + word(32) + word(3) + "41ff42".ljust(64, "0")
    assert spark.createDataFrame([(data,)], "data string").select(abi.values(F.col("data"), [("string", "s")], 3).alias("m")).first().m == {"s": "A�B"}


def test_signatures():
    assert abi.checked("f((uint a, string) p, uint[2][] indexed q)")[0] == "f((uint256,string),uint256[2][])"
    assert [(str(k), n, i) for k, n, i in abi.checked("T(address indexed from, address, int v)")[1]] == [("address", "from", True), ("address", "arg1", False), ("int256", "v", False)]
    assert abi.checked("f()") == ("f()", [])
    for bad in ("f", "f(", "f(uint", "f(uint))", "f(uint a b)", "f(uint7 a)", "f(bytes33 a)", "f(uint[0] a)", "f(() a)", "f(uint a, uint a)", "f(word a)", "(uint a)", "f(uint,)", "f(uint264 x)", "f(uint a; uint b)"):
        with pytest.raises(ValueError):
            abi.checked(bad)
