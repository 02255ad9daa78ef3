"""Counts over a fixed number of buckets, gathered as packed blocks: rows of single counts would take many times the driver's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counts that are gathered as one value.
BLOCK = 1 << 12


def packed(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks with counts of one task as rows (b, n)."""
    blocks = counts.astype(np.int64).reshape(-1, BLOCK)
    at = np.flatnonzero(blocks.any(axis=1))
    for i in range(0, len(at), 64):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 64]), pa.array([x.tobytes() for x in blocks[at[i : i + 64]]], pa.binary())], names=["b", "n"])


PACKED = "b long, n binary"


def gathered(blocks: DataFrame, size: int) -> np.ndarray:
    """The sums of the blocks of all tasks: `size` numbers, a multiple of BLOCK."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BLOCK, np.int64)
        for b in batches:
            for x in b.column("n"):
                n += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([n.tobytes()], pa.binary())], names=["b", "n"])

    out = np.zeros((size // BLOCK, BLOCK), np.int64)
    for r in blocks.groupBy("b").applyInArrow(add, PACKED).collect():
        out[r["b"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(-1)
