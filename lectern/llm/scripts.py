"""Scripts, readable units and small string helpers shared by the text operators."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

_CLASSES = {
    "thai": "฀-๿",
    "japanese": "぀-ヿｦ-ﾝ",
    "han": "㐀-䶿一-鿿豈-﫿",
    "devanagari": "ऀ-ॿ",
    "arabic": "؀-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ",
    "cyrillic": "Ѐ-ԯ",
    "greek": "Ͱ-Ͽ",
    "hangul": "가-힯",
    "latin": "A-Za-zªºÀ-ÖØ-öø-ɏ",
}
_COUNTERS = {k: re.compile(f"[{v}]") for k, v in _CLASSES.items()}
#: Letters of scripts that put no blanks between words.
UNSPACED = re.compile("[" + _CLASSES["thai"] + _CLASSES["japanese"] + _CLASSES["han"] + "]")
WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ॣॱ-ॿً-ٰ]+[^\W\d_]*)*")
_UNIT = re.compile("[" + _CLASSES["thai"] + _CLASSES["japanese"] + _CLASSES["han"] + "]|" + WORD.pattern)
_LETTER = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=100_000)
def _script(c: str) -> str | None:
    return next((k for k, r in _COUNTERS.items() if r.match(c)), None)


def script_of(text: str | None) -> str:
    """The script most letters of a text belong to; 'none' without letters. Kana decide against Han."""
    if not text:
        return "none"
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "none"
    n = dict.fromkeys(_COUNTERS, 0)
    for c, k in Counter(text).items():
        if script := _script(c):
            n[script] += k
    best = max(n, key=lambda k: n[k])
    if not n[best]:
        return "none"
    if best == "han" and n["japanese"] * 10 >= n["han"]:
        return "japanese"
    return best


def is_unspaced(text: str) -> bool:
    """True where most letters belong to a script without blanks between words."""
    if text.isascii():
        return False
    u = len(UNSPACED.findall(text))
    return u > 0 and 2 * u > len(_LETTER.findall(text))


def units(text: str) -> tuple[list[str], bool]:
    """Readable units in order: words in lower case, or single characters in unspaced scripts; digits and marks fall away."""
    low = text.lower()
    if is_unspaced(low):
        return _UNIT.findall(low), True
    return WORD.findall(low), False


def strip_accents(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
