"""A bitmap of 64-bit keys of a size that does not grow with the data; it errs to the safe side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sketch(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits of the keys, gathered as at most 2 ** (bits - 6) words: its size does not grow with the data."""
    b = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("b"))
    words = b.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("v")).toPandas()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def has(words: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    b = keys >> np.uint64(64 - bits)
    return (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
