"""Bloom filters over 64-bit hashes, built by Spark and probed by numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key that it holds, the most bits it has, and the bits that a key sets.
KEY_BITS, MAX_BITS, HASHES = 16, 1 << 28, 4


def key_filter(keys: DataFrame):
    """A broadcast filter over the stored column of hashes: KEY_BITS bits for each up to MAX_BITS.

    It grows with the keys, and its size is bounded. A filter at its limit lets more pass; the join
    with the keys that follows drops those.
    """
    keys = keys.toDF("key")
    n = keys.count()
    size = min(max(1 << math.ceil(math.log2(max(KEY_BITS * n, 1))), 1 << 16), MAX_BITS)
    slots = keys.select(F.explode(F.array(*[F.shiftrightunsigned("key", 8 * i).bitwiseAND(F.lit(size - 1).cast("long")) for i in range(HASHES)])).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size >> 6, np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def held(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indices of the keys (int64) that the filter may hold: all that it does, and few others."""
    mask = np.uint64(64 * len(filter_) - 1)
    at = np.arange(len(keys))
    for i in range(HASHES):
        slot = (keys[at].view(np.uint64) >> np.uint64(8 * i)) & mask
        at = at[(filter_[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
    return at
