"""Token signals of a language model: the aggregation per sentence, and count models that stand in for a neural one.

The count model is a surrogate: an add-one unigram model over the tokens of the corpus, whose signals come from joins and
windows. It makes no claim of equal values with any neural instrument; another provider may deliver the same columns.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import python_tokens, tokens
from lectern.operators.counting import PACKED, gathered, packed


def unigram_model(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, p, rank from 0, top1, entropy) with add-one smoothing; one row for each kind of token."""
    counts = docs.where(F.col(text).isNotNull()).select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("n").alias("top"))
    m = counts.crossJoin(F.broadcast(whole))  # one row
    p = (F.col("n") + 1.0) / (F.col("total") + F.col("kinds"))
    # tokens of one count share a rank, so ranking runs over the distinct counts, which are few
    by_count = counts.groupBy("n").agg(F.count("*").alias("same"))
    rank = by_count.withColumn("rank", F.sum("same").over(W.orderBy(F.col("n").desc())) - F.col("same")).select("n", "rank")
    entropy = m.select((-(p * F.ln(p))).alias("h")).agg(F.sum("h").alias("entropy"))
    return m.withColumn("p", p).join(rank, "n").crossJoin(F.broadcast(entropy)).select("token", "n", "p", "rank", ((F.col("top") + 1.0) / (F.col("total") + F.col("kinds"))).alias("top1"), "entropy")


def token_signals(sentences: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, log_prob, entropy, rank, top1_prob) for every token of every sentence; the first token of a document is unscored."""
    t = sentences.select(*keys, F.posexplode(tokens(F.col("sentence"))).alias("tok_idx", "token"))
    t = t.where(~((F.col("tok_idx") == 0) & (F.col(keys[-1]) == 0)))
    return _with_model(t, model).select(*keys, "tok_idx", F.ln("p").alias("log_prob"), "entropy", F.col("rank").cast("double").alias("rank"), F.col("top1").alias("top1_prob"))


def sentence_signals(sentences: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """The eight model features of every sentence; 0 where it has no scored token."""
    g = signals.groupBy(*keys).agg(
        F.exp(-F.avg("log_prob")).alias("perplexity"), F.avg("entropy").alias("token_entropy_mean"), F.stddev_pop("entropy").alias("token_entropy_std"),
        F.avg("log_prob").alias("log_prob_mean"), F.stddev_pop("log_prob").alias("log_prob_std"), F.avg("rank").alias("rank_mean"), F.stddev_pop("rank").alias("rank_std"), F.avg("top1_prob").alias("prob_curvature"),
    )
    names = [c for c in g.columns if c not in keys]
    return sentences.select(*keys).join(g.hint("merge"), keys, "left").select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


#: Tokens that make up this share of all are joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.002


def _with_model(t: DataFrame, model: DataFrame) -> DataFrame:
    """Tokens with their rows of the model: the frequent ones, a bounded list, by broadcast, the others by shuffle.

    The shuffle is asked for: exploded tokens are sized as the texts that they come from, far too low, and would be broadcast.
    """
    whole = model.agg(F.sum("n").alias("__all"))
    hot = model.crossJoin(F.broadcast(whole)).where(F.col("n") > HOT_SHARE * F.col("__all")).drop("__all")
    names = F.broadcast(hot.select("token"))
    return t.join(F.broadcast(hot), "token").unionByName(t.join(names, "token", "left_anti").hint("merge").join(model.hint("merge"), "token"))


#: Hexadecimal digits of a token's digest that name its bucket.
DIGITS = 5


def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:DIGITS], 16)


class CountModel:
    """An add-one unigram model over 16 ** DIGITS buckets of tokens: fixed size, so every sentence is scored where it is."""

    def __init__(self, counts: np.ndarray):
        self.digits = DIGITS
        n = counts.astype(np.float64)
        kinds = float((n > 0).sum())
        whole = n.sum() + kinds
        order = np.sort(n[n > 0])
        p = (order + 1.0) / whole if kinds else order
        self.log_p = np.log((n + 1.0) / max(whole, 1.0))
        self.rank = len(order) - np.searchsorted(order, n, side="right").astype(np.float64)  # buckets with a greater count
        self.entropy = float(-(p * np.log(p)).sum())
        self.top1 = float((order[-1] + 1.0) / whole) if kinds else 0.0
        self.shared: Broadcast | None = None

    @classmethod
    def learn(cls, docs: DataFrame, text: str = "text") -> CountModel:
        """Counts of all tokens: 16 ** DIGITS numbers reach the driver, as packed blocks, and are broadcast."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, known = np.zeros(16**DIGITS, np.int64), {}
            for b in batches:
                seen: Counter = Counter()
                for t in b.column(0).to_pylist():
                    seen.update(python_tokens(t))
                for t, k in seen.items():
                    if t not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[t] = _bucket(t)
                    n[known[t]] += k
            yield from packed(n)

        m = cls(gathered(docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, PACKED), 16**DIGITS))
        m.shared = docs.sparkSession.sparkContext.broadcast((m.log_p, m.rank, m.entropy, m.top1))
        return m

    def signals(self, token_array: Column, first: Column) -> Column:
        """array<double> of the eight model features of a sentence; the first token of a document's first sentence is unscored, 0 without tokens."""
        shared = self.shared

        @F.pandas_udf("array<double>")
        def run(rows: pd.Series, begins: pd.Series) -> pd.Series:
            one = _scorer(*shared.value)
            return pd.Series([one(t, b) for t, b in zip(rows, begins)])

        return run(token_array, first)

    def document_signals(self, tokens_by_sentence: Column) -> Column:
        """array<array<double>>: the same for all sentences of a document in order."""
        shared = self.shared

        @F.pandas_udf("array<array<double>>")
        def run(rows: pd.Series) -> pd.Series:
            one = _scorer(*shared.value)
            return pd.Series([[one(t, i == 0) for i, t in enumerate(r)] if r is not None else None for r in rows])

        return run.asNondeterministic()(tokens_by_sentence)  # so that no filter is pushed below it, into expressions that cannot hold Python


def _scorer(log_p: np.ndarray, rank: np.ndarray, entropy: float, top1: float):
    """The eight features of a sentence's tokens; buckets of tokens are kept."""
    known: dict[str, int] = {}

    def one(t, begin: bool) -> list[float]:
        b = []
        for x in t[1:] if begin else t:
            k = known.get(x)
            if k is None:
                k = known[x] = _bucket(x)
            b.append(k)
        if not b:
            return [0.0] * 8
        lp, r = log_p[b], rank[b]
        mean = lp.mean()
        return [round(float(np.exp(-mean)), 3), round(entropy, 4), 0.0, round(float(mean), 5), round(float(lp.std()), 5), round(float(r.mean()), 4), round(float(r.std()), 4), round(top1, 5)]

    return one
