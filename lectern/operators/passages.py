"""Passages: full windows of sentences, their aggregates, and lexical diversity of their text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrays import bind
from lectern.functions.features import finite
from lectern.functions.text import ratio
from lectern.operators.sentences import sentence_array

# Window of the moving ratio, threshold of a factor, quantiles of the aggregates.
MATTR_WINDOW, FACTOR = 50, 0.72
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def build_passages(sentences: DataFrame, key: str = "doc_id", window: int = 3, stride: int = 1, bounded: bool = True) -> DataFrame:
    """(key, passage_idx, first_idx, sentence_indices, text): full frames only, never across a paragraph segment if bounded.

    A segment shorter than the window gives no passage. `sentences` has key, sent_idx, segment, sentence.
    """
    if window < 1 or stride < 1:
        raise ValueError("window and stride are 1 at least")
    part = [key, "segment"] if bounded else [key]
    w = W.partitionBy(*part).orderBy("sent_idx")
    frame = w.rowsBetween(0, window - 1)
    rows = sentences.select(
        key, "segment", "sent_idx",
        F.collect_list("sent_idx").over(frame).alias("sentence_indices"),
        F.collect_list("sentence").over(frame).alias("__texts"),
        (F.row_number().over(w) - 1).alias("__n"),
    ).where((F.size("sentence_indices") == window) & (F.col("__n") % stride == 0))
    return rows.select(key, (F.row_number().over(W.partitionBy(key).orderBy("sent_idx")) - 1).alias("passage_idx"), F.col("sent_idx").alias("first_idx"), "sentence_indices", F.array_join("__texts", " ").alias("text"))


def passage_array(sentences: Column, window: int = 3, stride: int = 1, bounded: bool = True) -> Column:
    """array<struct<passage_idx, first_idx, sentence_indices, text>> of an array of sentences, within the row of its document."""
    if window < 1 or stride < 1:
        raise ValueError("window and stride are 1 at least")

    def frames(s: Column) -> Column:
        last = F.size(s) - window
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(1))).otherwise(F.array().cast("array<int>"))
        if bounded:
            starts = F.filter(starts, lambda i: s[i]["segment"] == s[i + (window - 1)]["segment"])
        if stride > 1:
            first = (lambda i: F.array_position(F.transform(s, lambda x: x["segment"]), s[i]["segment"]) - 1) if bounded else (lambda i: F.lit(0))
            starts = F.filter(starts, lambda i: (i - first(i)) % stride == 0)
        return F.transform(starts, lambda i, k: F.struct(
            k.alias("passage_idx"), i.alias("first_idx"), F.sequence(i, i + (window - 1)).alias("sentence_indices"),
            F.array_join(F.transform(F.slice(s, i + 1, F.lit(window)), lambda x: x["sentence"]), " ").alias("text"),
        ))

    return bind(sentences, frames)


def document_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 3, stride: int = 1, bounded: bool = True) -> DataFrame:
    """(key, passage_idx, first_idx, sentence_indices, text) of the passages of every document; no shuffle."""
    return docs.where(F.col(text).isNotNull()).select(key, F.inline(passage_array(sentence_array(F.col(text)), window, stride, bounded)))


# Statistics of a passage's features, in their order.
STATISTICS = ("mean", "std", "cv", "min", "max", *(f"p{round(q * 100)}" for q in QUANTILES))


def statistics(values: Column) -> Column:
    """struct of STATISTICS of an array of doubles without nulls; population deviation, null ratio where the mean is 0, linear quantiles."""

    def of(v: Column) -> Column:
        n = F.size(v)

        def quantile(q: float) -> Column:
            at = (n - 1) * q
            lo = F.floor(at).cast("int")
            return v[lo] + (v[F.least(lo + 1, n - 1)] - v[lo]) * (at - lo)

        def with_mean(m: Column) -> Column:
            std = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)
            return F.struct(m.alias("mean"), std.alias("std"), F.when(m != 0, std / m).alias("cv"), v[0].alias("min"), v[n - 1].alias("max"), *[quantile(q).alias(f"p{round(q * 100)}") for q in QUANTILES])

        return bind(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n, with_mean)

    return bind(F.array_sort(values), of)


def member_statistics(indices: Column, vectors: Column, names: Sequence[str]) -> Column:
    """array<struct<feature, s: struct of STATISTICS>> over the vectors of the sentences at `indices`.

    A feature that the first member lacks (null, or no finite value) is left out; members that lack it are passed over.
    """

    def of(rows: Column) -> Column:
        def one(name: Column, k: Column) -> Column:
            return F.struct(name.alias("feature"), F.when(finite(rows[0][k]), statistics(F.filter(F.transform(rows, lambda r: r[k]), finite))).alias("s"))

        return F.filter(F.transform(F.array(*[F.lit(n) for n in names]), one), lambda x: x["s"].isNotNull())

    return bind(F.transform(indices, lambda i: vectors[i]), of)


def passage_values(features: Column | None, mattr_: Column, mtld_: Column) -> Column:
    """array<struct<feature, ordinal, value>> of a passage: <feature>_<statistic> for all, then mattr and mtld."""
    each = F.array().cast("array<struct<feature:string,value:double>>") if features is None else F.flatten(F.transform(features, lambda f: F.array(*[F.struct(F.concat(f["feature"], F.lit(f"_{n}")).alias("feature"), f["s"][n].alias("value")) for n in STATISTICS])))
    both = F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in (("mattr", mattr_), ("mtld", mtld_))])
    return F.transform(F.concat(each, both), lambda x, i: F.struct(x["feature"].alias("feature"), (i + 1).alias("ordinal"), x["value"].alias("value")))


def aggregate_features(members: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation, its ratio to the mean (null if that is 0), extremes and quantiles of `value` by keys and feature."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in QUANTILES]))
    g = members.groupBy(*keys, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("__q"))
    named = [F.col("__q")[i].alias(f"p{round(x * 100)}") for i, x in enumerate(QUANTILES)]
    return g.select(*keys, "feature", "mean", "std", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("cv"), "min", "max", *named)


def mattr(t: Column, window: int = MATTR_WINDOW) -> Column:
    """Mean type-token ratio over all windows of a token array; of the whole if it is shorter."""
    n = F.size(t)
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1), F.lit(1)))
    total = F.aggregate(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(t, i, F.lit(window))))), F.lit(0), lambda a, x: a + x)
    return F.when(n >= window, total / (n - (window - 1)) / float(window)).otherwise(ratio(F.size(F.array_distinct(t)), n))


def factor_count(words: list[str]) -> float:
    """Factors in one direction: one closes where the ratio of kinds falls to the threshold; the rest counts as its ratio over it."""
    done, n, seen = 0.0, 0, set()
    for w in words:
        n += 1
        seen.add(w)
        if len(seen) / n <= FACTOR:
            done, n, seen = done + 1.0, 0, set()
    return done + (len(seen) / n / FACTOR if n else 0.0)


def both_ways(t) -> float:
    """Mean factor count of both directions; 0 without tokens."""
    if t is None or not len(t):
        return 0.0
    words = list(t)
    return (factor_count(words) + factor_count(words[::-1])) / 2


@F.pandas_udf(T.DoubleType())
def mtld(tokens: pd.Series) -> pd.Series:
    """`both_ways` over token arrays; a sequential fold, so it runs on Arrow batches."""
    return pd.Series(np.array([both_ways(t) for t in tokens], dtype=np.float64))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def mtld_of_each(token_lists: pd.Series) -> pd.Series:
    """The same for every token array of an array of them."""
    return pd.Series([[both_ways(t) for t in lists] if lists is not None else None for lists in token_lists])


#: Filters inferred from an explode must not be pushed below it, into expressions that cannot hold Python.
mtld_of_each = mtld_of_each.asNondeterministic()
