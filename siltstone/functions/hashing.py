"""Hashes, Bloom filters and SimHash."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, basis: int = _BASIS) -> int:
    h = basis
    for b in data:
        h = ((h ^ b) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_many(texts: list[str], basis: int = _BASIS) -> np.ndarray:
    """FNV-1a-64 of each string, column by column over all of them."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0, *map(len, data)], dtype=np.int64)
    return fnv1a_flat(np.frombuffer(b"".join(data), dtype=np.uint8), ends, basis)


def fnv1a_flat(flat: np.ndarray, ends: np.ndarray, basis: int = _BASIS) -> np.ndarray:
    """The same of texts whose bytes lie end to end, text i from ``ends[i]`` to ``ends[i + 1]``."""
    size, start = np.diff(ends), ends[:-1]
    h = np.full(len(size), basis, dtype=np.uint64)
    live = np.arange(len(size))
    k = 0
    while len(live := live[size[live] > k]):
        h[live] = (h[live] ^ flat[start[live] + k]) * np.uint64(_PRIME)
        k += 1
    return h


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings without nulls, and where each begins and ends."""
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    ends = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


@F.pandas_udf(T.LongType())
def fnv1a_64(text: pd.Series) -> pd.Series:
    """The hash's 64 bits as a signed number; null for null."""
    ok = text.notna().to_numpy()
    out = pd.Series([None] * len(text), dtype="Int64")
    out[ok] = fnv1a_many(text[ok].tolist()).view(np.int64)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at a false-positive rate of p."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(m / n * math.log(2)))


class Bloom:
    """A Bloom filter over double-hashed FNV; answers for many keys at once."""

    def __init__(self, n: int, p: float):
        self.m, self.k = bloom_size(n, p)
        self.bits = np.zeros((self.m + 7) // 8, dtype=np.uint8)

    def _places(self, keys: list[str]) -> np.ndarray:
        one = fnv1a_many(keys)
        two = fnv1a_many(keys, fnv1a(b"\xff"))
        return (one[:, None] + np.arange(self.k, dtype=np.uint64) * two[:, None]) % np.uint64(self.m)

    def add(self, keys: list[str]) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def contains(self, keys: list[str]) -> np.ndarray:
        at = self._places(keys)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
