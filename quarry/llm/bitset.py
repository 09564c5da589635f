"""A set of 64-bit hashes as bits: a filter of fixed size that tasks get whole, however many members it has.

What is in the set always passes; what is not may pass too, so that whoever asks counts or joins exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Bits of a filter: 4 MB go to each worker.
BITS = 1 << 25


def bitset(hashes: DataFrame, bits: int = BITS) -> Broadcast:
    """The bits of hashes (one column of longs), set by an aggregate to words of 64 bits: at most bits / 64 rows reach the driver."""
    key = F.col(hashes.columns[0])
    words = hashes.select(F.shiftright(key, 6).bitwiseAND(F.lit(bits // 64 - 1)).alias("at"), F.expr(f"shiftleft(1L, cast({hashes.columns[0]} & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each key (64 bits, unsigned) if it may be in the set."""
    u = np.uint64
    at = ((keys >> u(6)) & u(len(bits) - 1)).astype(np.int64)
    return (bits[at] >> (keys & u(63))) & u(1) == 1
