"""Vectorised hashes of byte ranges, shared by the operators that compare passages or word sequences.

Ranges are hashed by a polynomial over random byte values, modulo 2^64, taken from prefix sums, so that every
range of a text costs O(1); a mixing step follows. Two different bases give 128 bits where equality of
hashes stands for equality of ranges.
"""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark import TaskContext

U64 = np.uint64


def kept(name: str, make):
    """An object made once per worker process, so that later tasks of the stage find it ready.

    What no task of the stage has asked for goes when a new object is made, so a worker does not go on holding the tables and word caches
    of operators that have ended.
    """
    context = TaskContext.get()
    stage = context.stageId() if context else None
    store = sys.modules.setdefault("_postmill_kept", types.ModuleType("_postmill_kept")).__dict__.setdefault("objects", {})
    if name not in store:
        for other in [n for n, (_, used) in store.items() if used != stage]:
            del store[other]
        store[name] = (make(), stage)
    elif store[name][1] != stage:
        store[name] = (store[name][0], stage)
    return store[name][0]


class Known(dict):
    """What `learn` makes of the keys met lately. A key that is not in here is taken from the generation before, or learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.before = learn, {}

    def __missing__(self, key):
        found = self.before.get(key)
        self[key] = found = self.learn(key) if found is None else found
        return found

    def age(self, most: int) -> None:
        """Lets the older generation go once the younger one has over `most` keys, so that those in steady use stay."""
        if len(self) > most:
            self.before = dict(self)
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class RangeHash:
    """Hashes of ranges of one byte array after another."""

    def __init__(self, seed: int):
        values = mix(np.arange(1, 260, dtype=U64) * U64(2 * seed + 1) + U64(seed << 20))
        self.byte_value = values[:256]
        self.base = values[256] | U64(5)
        self.inverse = U64(pow(int(self.base), -1, 1 << 64))
        self.power = self.back = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 16)
            self.power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, self.base, U64)]))
            self.back = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, self.inverse, U64)]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.byte_value[data] * self.power[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.back[start]

    def grams(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hash of the `size` bytes at each position that has so many."""
        n = len(prefix) - size
        return (prefix[size:] - prefix[:n]) * self.back[:n]


def range_hash(seed: int) -> RangeHash:
    return kept(f"range_hash_{seed}", lambda: RangeHash(seed))
