"""Sizes of documents in tokens of a public tokenizer, measured once and read often."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokenizers import FOLDER, byte_bpe, count_tokens


def token_counts(documents: DataFrame, text: str = "text", folder: str = FOLDER) -> DataFrame:
    """The columns of `documents` without the text, and n_tokens of the whole text; null and empty texts have 0."""
    keep = [c for c in documents.columns if c not in (text, "n_tokens")]
    schema = ", ".join([f"`c{i}` {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["n bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(folder)
        k = len(keep)
        for b in batches:
            n = [count_tokens(t, enc) if t else 0 for t in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(n, pa.int64())], names=[*(f"c{i}" for i in range(k)), "n"])

    done = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`")).mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias("n_tokens"))
