"""Small helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries whose running sum is built by appending; longer arrays are taken block by block, so the work stays linear.
BLOCK = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used; null values are passed on."""
    return F.transform(F.array(value), use)[0]


def _running(a: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """struct(t, o): the sum, and for each entry the sum before it."""
    zero = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("o"))
    return F.aggregate(a, zero, lambda acc, x: F.struct((acc["t"] + of(x)).alias("t"), F.array_append(acc["o"], acc["t"]).alias("o")))


def sums_before(a: Column) -> Column:
    """For each entry of an array of ints the sum of those before it."""

    def whole(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.greatest(F.lit(0), F.size(a) - 1) / BLOCK).cast("int")), lambda b: _running(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        return bind(blocks, lambda k: F.flatten(F.zip_with(k, _running(k, lambda x: x["t"])["o"], lambda b, at: F.transform(b["o"], lambda v: v + at))))

    return bind(a, whole)
