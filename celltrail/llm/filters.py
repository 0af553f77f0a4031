"""Bloom filters of a fixed greatest size, for dropping most rows of a scan before an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 16, 26  # powers of two: 8 kB to 8 MB


class Bloom:
    """Two probes a key, taken from two halves of a 64-bit hash."""

    def __init__(self, words: np.ndarray, power: int):
        self.words, self.mask = words, np.uint64((1 << power) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        out = np.ones(len(keys), bool)
        for down in (0, 32):
            at = (keys >> np.uint64(down)) & self.mask
            out &= ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def bloom(keys: DataFrame, column: str) -> Bloom:
    """Of the hashes (long) in `column`: 16 bits a key, but at most 2 ** MOST; beyond that it only lets more through."""
    power = min(max(int(16 * max(keys.count(), 1)).bit_length(), LEAST), MOST)
    mask = (1 << power) - 1
    at = F.explode(F.array(*(F.shiftrightunsigned(column, n).bitwiseAND(F.lit(mask)) for n in (0, 32)))).alias("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2 ** (MOST - 6) at most
    words = np.zeros(1 << (power - 6), np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bloom(words, power)
