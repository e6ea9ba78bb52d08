"""Keccak-256 (the padding of Ethereum, which hashlib's sha3_256 doesn't have) and the bloom bits that rest on it.

Values such as addresses and topics repeat, and hashing is the slow part: distinct values of a batch are hashed at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MASK, RATE, BLOOM_BITS = (1 << 64) - 1, 136, 2048
HEX = re.compile("0x((?:[0-9a-fA-F]{2})*)")
#: Messages whose lanes are permuted at once.
AT_ONCE = 4096


def _constants() -> tuple[list[int], list[tuple[int, int, int]]]:
    """Round constants from the degree-8 shift register, and (x, y, rotation) in the order of the rho and pi walk."""
    out, register = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if register & 1:
                value |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        out.append(value)
    walk, x, y = [], 1, 0
    for t in range(24):
        walk.append((x, y, (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return out, walk


ROUNDS, WALK = _constants()


def _rotated(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & MASK


def _permuted(a: list[int]) -> list[int]:
    """The permutation of 25 lanes, lane (x, y) at x + 5 y; a lane is a number, or an array of the same lane of many states."""
    for constant in ROUNDS:
        parity = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        change = [parity[x - 1] ^ _rotated(parity[(x + 1) % 5], 1) for x in range(5)]
        a = [v ^ change[k % 5] for k, v in enumerate(a)]
        b = [a[0]] + [0] * 24
        for x, y, n in WALK:
            b[y + 5 * ((2 * x + 3 * y) % 5)] = _rotated(a[x + 5 * y], n)
        a = [b[k] ^ (~b[k - k % 5 + (k + 1) % 5] & MASK & b[k - k % 5 + (k + 2) % 5]) for k in range(25)]
        a[0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    padded = bytearray(data) + bytes(RATE - len(data) % RATE)
    padded[len(data)] ^= 1
    padded[-1] ^= 0x80
    a = [0] * 25
    for at in range(0, len(padded), RATE):
        for k in range(RATE // 8):
            a[k] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        a = _permuted(a)
    return b"".join(v.to_bytes(8, "little") for v in a[:4])


def keccak256_all(messages: Sequence[bytes]) -> np.ndarray:
    """The hashes of many messages, 32 bytes a row; those of as many blocks are permuted together."""
    out = np.zeros((len(messages), 32), np.uint8)
    n_blocks = np.array([len(m) // RATE + 1 for m in messages], np.int64)
    for n in np.unique(n_blocks):
        alike = np.flatnonzero(n_blocks == n)
        step = max(1, AT_ONCE // int(n))
        for at in range(0, len(alike), step):
            own = alike[at : at + step]
            padded = np.frombuffer(bytearray(b"".join(messages[k].ljust(n * RATE, b"\0") for k in own)), np.uint8).reshape(len(own), n * RATE)
            padded[np.arange(len(own)), [len(messages[k]) for k in own]] ^= 1
            padded[:, -1] ^= 0x80
            lanes = np.ascontiguousarray(padded.view("<u8").astype(np.uint64).T)
            a = [np.zeros(len(own), np.uint64) for _ in range(25)]
            for low in range(0, len(lanes), RATE // 8):
                a = _permuted([v ^ lanes[low + k] if k < RATE // 8 else v for k, v in enumerate(a)])
            out[own] = np.stack(a[:4], axis=1).astype("<u8").view(np.uint8)
    return out


def event_topic(signature: str) -> str:
    """topic_0 of a canonical event signature."""
    return "0x" + keccak256(signature.encode()).hex()


def call_selector(signature: str) -> str:
    """The selector of a canonical function signature."""
    return event_topic(signature)[:10]


@F.arrow_udf(ArrayType(IntegerType()))
def _bloom_places(values: pa.Array) -> pa.Array:
    """The places of the bits that lists of hex values set: place p is bit p % 8 of byte p / 8 of a bloom as it is written."""
    coded = values.flatten().dictionary_encode()
    found = [HEX.fullmatch(v) for v in coded.dictionary.to_pylist()]
    whole = np.array([m is not None for m in found] + [False])
    pairs = keccak256_all([bytes.fromhex(m[1]) for m in found if m])[:, :6].reshape(-1, 3, 2).astype(np.int32)
    bits = (pairs[:, :, 0] << 8 | pairs[:, :, 1]) % BLOOM_BITS
    places = np.zeros((len(whole), 3), np.int32)
    places[whole] = (BLOOM_BITS // 8 - 1 - bits // 8) * 8 + bits % 8
    codes = coded.indices.fill_null(len(found)).to_numpy(zero_copy_only=False)
    kept = whole[codes]
    counts = np.bincount(pc.list_parent_indices(values).to_numpy(zero_copy_only=False)[kept], minlength=len(values))
    offsets = np.concatenate([[0], 3 * counts.cumsum()])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places[codes[kept]].ravel(), pa.int32()))


def block_blooms(logs: DataFrame) -> DataFrame:
    """chain_id, block_number and logs_bloom computed from addresses and topics of the logs; what isn't whole hex bytes sets no bit.

    A log goes to its block's task as a row of at most 15 places, and a block's group is one bitmap of fixed size whatever
    the number of logs.
    """
    keys = ["chain_id", "block_number"]
    places = logs.select(*keys, _bloom_places(F.array("address", "topic_0", "topic_1", "topic_2", "topic_3")).alias("places"))
    set_bits = places.repartition(*keys).select(*keys, F.explode("places").alias("place"))
    bitmaps = set_bits.groupBy(*keys).agg(F.bitmap_construct_agg("place").alias("bitmap"))
    return bitmaps.select(*keys, F.concat(F.lit("0x"), F.lower(F.hex(F.substring("bitmap", 1, BLOOM_BITS // 8)))).alias("logs_bloom"))
