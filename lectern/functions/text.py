"""Column functions over text: white space, tokens, counts, buckets, hashes, normal form."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters on which words are split and texts are stripped (Unicode white space and the separators 1C to 1F).
WS_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS = "".join(f"\\x{{{c:X}}}" for c in WS_CODES)
TRIM = f"^[{WS}]+|[{WS}]+\\z"
TOKEN = "[A-Za-z0-9']+"
# Marks that count as punctuation.
PUNCTUATION = ".,!?;:\"'()\\[\\]{}<>\\-"
VOWELS = "[aeiouyà-æè-ïò-öøù-ýÿœ]+"
#: What is no letter and no digit, of any script.
NO_WORD = "[^\\p{L}\\p{N}]"
# Lower bounds of the length buckets, in words.
BUCKETS = (("short", 0), ("standard", 200), ("long", 500), ("xlong", 800))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, TRIM, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def tokens(c: Column) -> Column:
    """Latin letters, digits and apostrophes in runs, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def type_token_ratio(t: Column) -> Column:
    return ratio(F.size(F.array_distinct(t)), F.size(t))


def length_bucket(n: Column) -> Column:
    """Bucket of a word count; a negative count falls through to the last."""
    inner = [(name, lo, hi) for (name, lo), (_, hi) in zip(BUCKETS, BUCKETS[1:])]
    out = reduce(lambda acc, b: acc.when((n >= b[1]) & (n < b[2]), b[0]), inner[1:], F.when((n >= inner[0][1]) & (n < inner[0][2]), inner[0][0]))
    return out.when(n.isNotNull(), BUCKETS[-1][0])


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)


def nfc(c: Column) -> Column:
    """Composed form; only texts with characters beyond ASCII leave the JVM."""
    return F.when(c.rlike("\\A[\\x00-\\x7F]*\\z"), c).otherwise(_composed(c))


# The normalisation steps by name, in their order.
STEPS = ("nfc_normalize", "newline_normalize", "collapse_hspace", "strip")


def clean(composed: Column) -> Column:
    """Line ends as newlines, at most one empty line, single blanks, stripped; of a text in composed form."""
    t = F.regexp_replace(composed, "\\r\\n|\\r", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    return strip(t)


def applied_steps(raw: Column, composed: Column) -> Column:
    """Which steps changed the text, in their order."""
    lines = F.regexp_replace(F.regexp_replace(composed, "\\r\\n|\\r", "\n"), "\\n{3,}", "\n\n")
    blanks = F.regexp_replace(lines, "[ \\t]+", " ")
    flags = (composed != raw, lines != composed, blanks != lines, strip(blanks) != blanks)
    return F.array_compact(F.array(*[F.when(f, s) for f, s in zip(flags, STEPS)]))


def blank_words(c: Column) -> Column:
    """Words between white space in lower case, without their marks; pieces without a letter or digit are none."""
    bare = F.transform(F.split(F.lower(c), f"[{WS}]+"), lambda w: F.regexp_replace(w, NO_WORD, ""))
    return F.filter(bare, lambda w: w != "")


def two_decimals(c: Column) -> Column:
    """A double with two decimals, of its exact value: ties to the even digit. Beyond 10^13 the usual format.

    200 |c| is taken as an unrounded sum of two doubles (the high and low halves of c times 200), so a tie is one only where
    the binary value is.
    """
    a = F.abs(c)
    high = a * 134217729.0 - (a * 134217729.0 - a)
    whole = a * 200.0
    rest = (high * 200.0 - whole) + (a - high) * 200.0
    k = F.floor(whole / 2.0)
    over = (whole - (k * 2 + 1).cast("double")) + rest
    n = (k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)).cast("long")
    text = F.concat(F.when(c.cast("string").startswith("-"), "-").otherwise(""), (n / 100).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(a < 1e13, text).otherwise(F.format_string("%.2f", c))


def syllables(token_array: Column) -> Column:
    """Vowel groups, one at least for every word."""
    return F.aggregate(token_array, F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.regexp_count(w, F.lit(VOWELS))))


def hard_words(token_array: Column) -> Column:
    """Words of three syllables or more."""
    return F.size(F.filter(token_array, lambda w: F.regexp_count(w, F.lit(VOWELS)) >= 3))


def format_prompt(template: Column, topic: Column, words: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{topic}"), topic), F.lit("{word_count}"), words.cast("string"))


def ordinal_id(prefix: str, ordinal: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.when(ordinal < 10**width, F.lpad(ordinal.cast("string"), width, "0")).otherwise(ordinal.cast("string")))


def python_tokens(text: str) -> list[str]:
    """The tokens on the Python side, for providers."""
    return re.findall(TOKEN, text.lower())
