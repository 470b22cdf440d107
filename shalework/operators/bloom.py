"""A Bloom filter of 64-bit words, built and tested by Spark expressions alone.

Each key sets four bits of one word, so that a test reads a single array element. The filter's size follows the number of
keys up to ``max_words``; beyond that it lets more keys pass but never loses one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**22 words are 32 MB, 16 bits for each of 16 million keys: what is sent to each executor at most.
MAX_WORDS = 1 << 22
BITS_PER_KEY = 16
#: Words that are put together at once.
BLOCK = 1 << 12


def words_for(n_keys: int, max_words: int = MAX_WORDS) -> int:
    """A power of two of words with about ``BITS_PER_KEY`` bits for each key."""
    need = max(1, math.ceil(n_keys * BITS_PER_KEY / 64))
    return min(max_words, 1 << (need - 1).bit_length())


def _word(h: Column, n_words: int) -> Column:
    return h.bitwiseAND(F.lit(n_words - 1)).cast("int")


def _mask(h: Column) -> Column:
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")) for at in (40, 46, 52, 58)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def build(keys: DataFrame, n_keys: int, max_words: int = MAX_WORDS) -> tuple[Column, int]:
    """``keys`` has one bigint column ``h``. Gives the filter as a scalar subquery (array<bigint>) and its word count."""
    n = words_for(n_keys, max_words)
    words = keys.select(_word(F.col("h"), n).alias("w"), _mask(F.col("h")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    # put together in two steps, so that no task handles the words one by one
    size = min(n, BLOCK)
    zero = F.lit(0).cast("bigint")
    filled = F.map_from_entries(F.collect_list(F.struct((F.col("w") % size).alias("at"), "m")))
    blocks = words.groupBy((F.col("w") / size).cast("int").alias("block")).agg(filled.alias("f"))
    dense = blocks.select("block", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("f", i), zero)).alias("a"))
    none = F.array_repeat(zero, size)
    held = F.map_from_entries(F.collect_list(F.struct("block", "a")))
    whole = dense.agg(held.alias("f")).select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n // size - 1)), lambda i: F.coalesce(F.try_element_at("f", i), none))).alias("a"))
    return whole.scalar(), n


def might_contain(bloom: Column, n_words: int, h: Column) -> Column:
    """False only where the key is certainly absent."""
    mask = _mask(h)
    return F.get(bloom, _word(h, n_words)).bitwiseAND(mask) == mask
