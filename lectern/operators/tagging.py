"""Shares of word classes by rules: a stand-in for a parser, with the same columns a parser would deliver."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrays import bind
from lectern.functions.features import POS_TAGS
from lectern.functions.text import PUNCTUATION

# Closed word classes of English, tried in this order.
CLOSED = {
    "DET": "the a an this that these those each every some any no another both all".split(),
    "PRON": "i you he she it we they me him her us them my your his its our their mine who whom what which myself itself".split(),
    "ADP": "of in on at by for with about against between into through during before after above below from up down over under near without behind".split(),
    "AUX": "am is are was were be been being have has had do does did will would can could shall should may might must".split(),
    "CCONJ": "and or but nor yet so".split(),
    "SCONJ": "because although though while if unless since when where whereas until that whether".split(),
    "PART": "not to n't 's".split(),
    "INTJ": "oh wow hey ah well yes please".split(),
    "ADV": "very then there here now never always often too also only once again still soon just".split(),
}
# Endings that mark open classes.
ENDINGS = (("ADV", ".{2,}ly"), ("VERB", ".{2,}(?:ing|ed|ise|ize|ify)"), ("ADJ", ".{2,}(?:ous|ful|able|ible|ive|less|ish|al|ic)"))
UNIT = f"([A-Za-z0-9'À-ɏ]+|[{PUNCTUATION}]|[^\\sA-Za-z0-9'À-ɏ])"
# Words that open a clause, counted beside the main one.
CLAUSE_OPENERS = ("and", "but", "or", "because", "although", "that", "which", "who", "when", "if", "while")


def tag(unit: Column) -> Column:
    """Universal class of one unit of text."""
    low = F.lower(unit)
    out = F.when(unit.rlike("^[0-9]+$"), "NUM").when(unit.rlike(f"^[{PUNCTUATION}]$"), "PUNCT")
    out = reduce(lambda acc, kv: acc.when(low.isin(*kv[1]), kv[0]), CLOSED.items(), out)
    out = out.when(~unit.rlike("[A-Za-zÀ-ɏ]"), "SYM")
    out = reduce(lambda acc, kv: acc.when(low.rlike(f"^{kv[1]}$"), kv[0]), ENDINGS, out)
    return out.when(unit.rlike("^[A-Z]"), "PROPN").otherwise("NOUN")


def tags(sentence: Column) -> Column:
    """struct(units in lower case, tags) of a sentence."""
    return bind(F.regexp_extract_all(sentence, F.lit(UNIT), F.lit(1)), lambda u: F.struct(F.transform(u, F.lower).alias("units"), F.transform(u, tag).alias("tags")))


def _share(tagged: Column, name: str, n: Column) -> Column:
    return F.size(F.filter(tagged["tags"], lambda x: x == name)) / n


def syntax(tagged: Column) -> dict[str, Column]:
    """Shares of the classes, their entropy and the number of clauses of a sentence with its units and tags; null without a unit."""
    n = F.nullif(F.size(tagged["tags"]), F.lit(0))
    out = {f"pos_{t}": _share(tagged, t, n) for t in POS_TAGS}
    kinds = F.transform(F.array_distinct(tagged["tags"]), lambda t: F.size(F.filter(tagged["tags"], lambda x: x == t)) / n)
    out["pos_entropy"] = F.when(n.isNotNull(), F.aggregate(kinds, F.lit(0.0), lambda a, p: a - p * F.log2(p)))
    out["clause_density"] = F.when(n.isNotNull(), (F.size(F.filter(tagged["units"], lambda u: u.isin(*CLAUSE_OPENERS))) + 1).cast("double"))
    return out


def tag_shares(sentences: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """(keys, pos_* shares, pos_entropy, clause_density) of every sentence with a unit, within its row."""
    t = sentences.select(*keys, tags(F.col("sentence")).alias("__t")).where(F.size("__t.tags") > 0)
    return t.select(*keys, *[F.round(c, digits).alias(k) for k, c in syntax(F.col("__t")).items()])


@F.pandas_udf(T.DoubleType())
def dep_depth_mean(heads: pd.Series) -> pd.Series:
    """Mean distance to the root over the tokens of a sentence, from the index of each token's head (a root is its own head).

    For parsers that deliver heads; 0 without tokens. Indexes outside the sentence and circles count as roots.
    """

    def one(h) -> float:
        if h is None or not len(h):
            return 0.0
        depth: dict[int, int] = {}
        for i in range(len(h)):
            path = []
            k = i
            while k not in depth and k not in path and 0 <= h[k] < len(h) and h[k] != k:
                path.append(k)
                k = int(h[k])
            depth.setdefault(k, 0)
            for n, x in enumerate(reversed(path), 1):
                depth.setdefault(x, depth[k] + n)
        return sum(depth[i] for i in range(len(h))) / len(h)

    return pd.Series([one(h) for h in heads])
