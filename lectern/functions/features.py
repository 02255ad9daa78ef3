"""Sentence features as column expressions, their catalog and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import NO_WORD, PUNCTUATION, WS, blank_words, hard_words, ratio, syllables, tokens

# The sentence features in extraction order (ties in rankings follow it).
STYLOMETRIC = ("ttr", "word_length_mean", "sent_len", "lexical_recurrence", "ngram_rep_char_3", "ngram_rep_word_2", "punct_density")
READABILITY = ("flesch_reading_ease", "flesch_kincaid_grade", "ari", "coleman_liau", "gunning_fog")
POS_TAGS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")
SYNTAX = (*(f"pos_{t}" for t in POS_TAGS), "pos_entropy", "dep_depth_mean", "clause_density")
LANGUAGE_MODEL = ("perplexity", "token_entropy_mean", "token_entropy_std", "log_prob_mean", "log_prob_std", "rank_mean", "rank_std", "prob_curvature")
ORDER = (*STYLOMETRIC, *READABILITY, *SYNTAX, *LANGUAGE_MODEL)

# Family and state of every name in the catalog.
CATALOG = {
    **{n: ("lexical", "implemented") for n in ("ttr", "word_length_mean", "sent_len", "mattr", "mtld")},
    **{n: ("repetition", "implemented") for n in ("ngram_rep_char_3", "ngram_rep_word_2", "lexical_recurrence")},
    **{n: ("readability", "implemented") for n in READABILITY},
    **{n: ("rhythm", "implemented") for n in ("punct_density", "sent_len_mean", "sent_len_std", "sent_len_cv", "clause_density_mean")},
    **{n: ("syntax", "implemented") for n in SYNTAX},
    **{n: ("lm", "implemented") for n in LANGUAGE_MODEL},
    **{n: ("lexical", "planned") for n in ("hdd", "rare_word_rate")},
    **{n: ("repetition", "experimental") for n in ("self_similarity",)},
    **{n: ("contextual", "experimental") for n in ("coherence_prev", "coherence_next", "topic_consistency")},
}


def catalog(spark: SparkSession) -> DataFrame:
    """(feature, family, status, ordinal); the ordinal is null for names that are no sentence feature."""
    rows = [(n, f, s, ORDER.index(n) + 1 if n in ORDER else None) for n, (f, s) in sorted(CATALOG.items())]
    return spark.createDataFrame(rows, "feature string, family string, status string, ordinal int")


def status(feature: str) -> str:
    return CATALOG[feature][1]


def family(feature: str) -> str:
    return CATALOG[feature][0]


def _repeated(grams: Column, count: Column) -> Column:
    """1 - distinct / all, and 0 without any."""
    return F.when(count > 0, 1.0 - F.size(F.array_distinct(grams)) / count).otherwise(0.0)


def char_repetition(s: Column, n: int = 3) -> Column:
    """Over the text without white space, which is bound once: inside the inner function it would be computed for every gram."""

    def grams(bare: Column) -> Column:
        size = F.length(bare)
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1), F.lit(1)), lambda i: F.substring(bare, i, F.lit(n))))

    bound = F.transform(F.array(F.regexp_replace(s, f"[{WS}]+", "")), grams)[0]
    return F.transform(F.array(bound), lambda g: _repeated(g, F.coalesce(F.nullif(F.size(g), F.lit(-1)), F.lit(0))))[0]


def word_repetition(t: Column) -> Column:
    size = F.size(t)
    pairs = F.when(size >= 2, F.transform(F.sequence(F.lit(1), size - 1, F.lit(1)), lambda i: F.concat(F.element_at(t, i), F.lit(" "), F.element_at(t, i + 1))))
    return _repeated(pairs, F.when(size >= 2, size - 1).otherwise(0))


def punctuation_density(s: Column) -> Column:
    return ratio(F.length(F.regexp_replace(s, f"[^{PUNCTUATION}]", "")), F.length(F.regexp_replace(s, f"[{WS}]+", "")))


def stylometric(s: Column, t: Column) -> dict[str, Column]:
    """The lexical features of a sentence `s` with tokens `t`."""
    size, kinds = F.size(t), F.size(F.array_distinct(t))
    return {
        "ttr": ratio(kinds, size),
        "word_length_mean": ratio(F.length(F.array_join(t, "")), size),
        "sent_len": size.cast("double"),
        "lexical_recurrence": ratio(size - kinds, size),
        "ngram_rep_char_3": char_repetition(s),
        "ngram_rep_word_2": word_repetition(t),
        "punct_density": punctuation_density(s),
    }


def readability(s: Column, words: Column) -> dict[str, Column]:
    """Five readability grades of one sentence with its words between blanks; 0 where it has none. Syllables are vowel groups."""
    w = F.size(words).cast("double")
    syll, hard = syllables(words).cast("double"), hard_words(words).cast("double")
    chars = F.length(F.regexp_replace(s, f"[{WS}]+", "")).cast("double")
    letters = F.length(F.regexp_replace(s, NO_WORD, "")).cast("double")
    some = lambda x: F.when(w > 0, x).otherwise(0.0)
    per = lambda x: F.try_divide(x, w)
    return {
        "flesch_reading_ease": some(206.835 - 1.015 * w - 84.6 * per(syll)),
        "flesch_kincaid_grade": some(0.39 * w + 11.8 * per(syll) - 15.59),
        "ari": some(4.71 * per(chars) + 0.5 * w - 21.43),
        "coleman_liau": some(0.058 * (100.0 * per(letters)) - 0.296 * per(F.lit(100.0)) - 15.8),
        "gunning_fog": some(0.4 * (w + 100.0 * per(hard))),
    }


def sentence_features(sentences: DataFrame, digits: int | None = None) -> DataFrame:
    """Adds the twelve lexical and readability features to rows with a column `sentence`."""
    withtok = sentences.withColumn("__t", tokens(F.col("sentence"))).withColumn("__w", blank_words(F.col("sentence")))
    cols = stylometric(F.col("sentence"), F.col("__t")) | readability(F.col("sentence"), F.col("__w"))
    return withtok.withColumns({k: F.round(c, digits) if digits is not None else c for k, c in cols.items()}).drop("__t", "__w")


def unpivot(wide: DataFrame, keys: list[str], features: tuple[str, ...]) -> DataFrame:
    """Long form (keys, feature, ordinal, value) without values that cannot be compared (null, NaN, infinite)."""
    structs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(ORDER.index(f) + 1 if f in ORDER else 1000 + i).alias("ordinal"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    long = wide.select(*keys, F.inline(structs))
    return long.where(finite(F.col("value")))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
