"""A bitmap of fixed size as a filter ahead of a shuffle: what it lets through is a superset.

It has as many bits at every size of the table, so it may be broadcast; a crowded
bitmap lets more rows through, which costs time and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26     # 2**26 bits are 8 MB


def bitmap(keys: DataFrame, key: Column) -> np.ndarray:
    """64-bit words with the bits of all keys (their low BITS bits) set.

    At most 2**(BITS - 6) rows come to the driver.
    """
    slot = key.bitwiseAND(F.lit((1 << BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    rows = (keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), one.alias("bits"))
            .groupBy("word").agg(F.bit_or("bits").alias("bits"))).toArrow()
    words = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (unsigned 64-bit) may be in the bitmap."""
    slot = keys & np.uint64((1 << BITS) - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
