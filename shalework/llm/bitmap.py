"""Bloom filters over 64-bit hashes for code that runs on arrays, built by Spark and sent to every task.

A hash names one bit by its upper bits, and by its lower ones four more bits of the same 64-bit word. The words are set by an aggregation, so
that the driver holds nothing but the finished map. Its size follows the number of keys up to ``max_bits``; beyond that the map lets
more keys pass but never loses one: whatever passes has to be decided by a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**28 bits are 32 MB: what is sent to each executor at most.
MAX_BITS = 28
BITS_PER_KEY = 24
_SHIFTS = (0, 6, 12, 18)
#: Maps of up to so many bits are spread out, a byte for each bit, while a task uses them.
_FLAT = 24


def log_bits(n_keys: int, max_bits: int = MAX_BITS) -> int:
    """The logarithm of the map's size for so many keys."""
    return max(7, min(max_bits, max(10, (max(1, n_keys) * BITS_PER_KEY - 1).bit_length())))


def build(keys: DataFrame, n_keys: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """``keys`` has one bigint column ``h``, a hash whose bits are all used -> the map as 64-bit words."""
    bits = log_bits(n_keys, max_bits)
    one = F.lit(1).cast("bigint")
    mask = F.lit(0).cast("bigint")
    for s in (64 - bits, *_SHIFTS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned("h", s).bitwiseAND(F.lit(63)).cast("int")))
    word = F.shiftrightunsigned("h", 64 - (bits - 6)).cast("int")
    words = keys.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[np.asarray(words["w"])] = np.asarray(words["m"]).view(np.uint64)
    return out


class Map:
    """A finished map as a task uses it."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.bits = len(words).bit_length() + 5
        self.shift = np.uint64(64 - self.bits)
        self.flat = np.unpackbits(words.view(np.uint8), bitorder="little").view(bool) if self.bits <= _FLAT else None

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes (uint64) may be keys."""
        at = (h >> self.shift).astype(np.int64)
        out = self.flat[at] if self.flat is not None else (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        left = np.flatnonzero(out)  # few pass the first bit
        if len(left):
            some = h[left]
            mask = np.zeros(len(some), np.uint64)
            for s in _SHIFTS:
                mask |= np.uint64(1) << ((some >> np.uint64(s)) & np.uint64(63))
            out[left] = self.words[at[left] >> 6] & mask == mask
        return out

    def passes_one(self, h: int) -> bool:
        at = h >> (64 - self.bits)
        mask = 1 << (at & 63)
        for s in _SHIFTS:
            mask |= 1 << (h >> s & 63)
        return int(self.words[at >> 6]) & mask == mask
