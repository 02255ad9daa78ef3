"""The feature vector of a sentence in the order of extraction, as one array within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import bind
from lectern.functions.features import LANGUAGE_MODEL, ORDER, readability, stylometric
from lectern.functions.text import blank_words, tokens
from lectern.operators.language_model import CountModel
from lectern.operators.tagging import syntax, tags

#: Features of the text of a sentence alone, and all of them; dep_depth_mean needs a parser and is null without one.
TEXTUAL = tuple(n for n in ORDER if n not in LANGUAGE_MODEL)
ALL = ORDER


def text_vector(sentence: Column, digits: int | None = None) -> Column:
    """array<double> of TEXTUAL."""

    def of(x: Column) -> Column:
        cols = stylometric(x["s"], x["t"]) | readability(x["s"], x["w"]) | syntax(x["g"])
        found = [cols.get(n, F.lit(None).cast("double")) for n in TEXTUAL]
        return F.array(*[F.round(c, digits) if digits is not None else c for c in found])

    return bind(F.struct(sentence.alias("s"), tokens(sentence).alias("t"), blank_words(sentence).alias("w"), tags(sentence).alias("g")), of)


def with_vectors(sentences: DataFrame, model: CountModel | None = None, digits: int | None = None) -> DataFrame:
    """Adds `vector`, array<double> of ALL (of TEXTUAL without a model), to rows with sent_idx and sentence; no shuffle."""
    v = text_vector(F.col("sentence"), digits)
    if model is None:
        return sentences.withColumn("vector", v)
    return sentences.withColumn("vector", F.concat(v, model.signals(tokens(F.col("sentence")), F.col("sent_idx") == 0)))


def long_values(rows: DataFrame, keys: list[str], names: tuple[str, ...] = ALL) -> DataFrame:
    """(keys, feature, ordinal, value) of every value of `vector` that can be compared."""
    n = F.array(*[F.lit(x) for x in names])
    x = rows.select(*keys, F.inline(F.transform("vector", lambda v, i: F.struct(n[i].alias("feature"), (i + 1).alias("ordinal"), v.alias("value")))))
    return x.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
