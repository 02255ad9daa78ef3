"""Problem 7: text decoded with a wrong character encoding.

Characters are mapped back to the bytes of a legacy code page, a byte-structure automaton (UTF-8's grammar, compiled
as a regular expression over those bytes) finds the maximal well-formed multibyte spans, and only these are decoded.
A span counts by what it comes to when it is undone as often as it can be, the page of a round by the damage that is then
left; rounds repeat until nothing changes, which undoes encodings of any number of rounds. What is not UTF-8 under any page (a single-byte or
double-byte page shown through another) is found by characters that cannot stand where they stand, and decoded where
one page removes all such places. U+FFFD marks are found but cannot be undone.

Nulls and empty texts give no finding; other columns pass through; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.scripts import script_of

#: Code pages through which UTF-8 is commonly shown.
SHOWN_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8_r", "cp1250", "cp1253")
#: Pages whose characters for bytes beyond ASCII are letters of words, so that a sequence may be there by chance.
_CYRILLIC_PAGES = ("cp1251", "cp866", "koi8_r")
#: The sentinel for a character that has no byte in the page.
_NONE = "Ā"


def _page(codec: str) -> dict[int, str]:
    """Character to byte, as a table for str.translate over the byte's Latin-1 character."""
    table: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)  # undefined bytes usually pass as C1 controls
        table[ord(c)] = chr(b)
    if codec == "cp1252":  # also Latin-1, which shows 80 to 9F as C1 controls
        for b in range(0x80, 0xA0):
            table.setdefault(b, chr(b))
    return table


#: Marks of ordinary typography: no two of them, nor one beside ASCII, can be a byte sequence or a sign of a wrong page.
TYPOGRAPHY = frozenset("‘’“”–—…\xa0")


def ordinary(text: str) -> bool:
    """Whether a text has no other characters than ASCII and marks of typography, which nothing has to be looked for in."""
    return text.isascii() or all(c <= "\x7f" or c in TYPOGRAPHY for c in set(text))


class _Bytes(dict):
    def __init__(self, codec: str):
        super().__init__(_page(codec))

    def __missing__(self, k: int) -> str:
        v = chr(k) if k < 0x80 else _NONE
        self[k] = v
        return v


_PAGES = {c: _Bytes(c) for c in SHOWN_AS}


def _hint(codec: str) -> re.Pattern:
    """A lead byte and a continuation byte as the page shows them: without such a pair no span can exist."""
    page = [(chr(k), ord(v)) for k, v in _PAGES[codec].items() if v != _NONE]
    lead = "".join(re.escape(c) for c, b in page if 0xC2 <= b <= 0xF4)
    more = "".join(re.escape(c) for c, b in page if 0x80 <= b <= 0xBF)
    return re.compile(f"[{lead}][{more}]")


_HINTS = {c: _hint(c) for c in SHOWN_AS}
#: The automaton of well-formed multibyte sequences (RFC 3629), maximal spans of them.
_SEQ = (
    "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_SPAN = re.compile(f"(?:{_SEQ})+")
#: Ranges that ordinary prose uses, first those that stand alone, then those that come in words.
_ALONE = re.compile("[\uff01-\uff5e\u2000-\u200a -ÿŒœŠšŸŽžƒˆ˜‐-›€™−ﬀ-ﬆ﻿​-‏⁠]")
_LATIN_PROSE = re.compile("[À-ÿ‘-„–—…€™«»¡]+")
_RUN = re.compile("[\x80-\xff]+")
_IN_WORDS = re.compile("[Ā-ſ΄-ώЀ-џҐґא-ת؀-ۿऀ-ॿก-๛　-ヿ一-鿿가-힣！-～｡-ﾟ̀-ͯ]")


def _sequences(text: str, codec: str) -> list[tuple[int, int, str]]:
    """Maximal well-formed spans (start, end, decoded) of a text as the page shows them."""
    mapped = text.translate(_PAGES[codec])
    found = []
    for run in _RUN.finditer(mapped):
        part = list(_SPAN.finditer(mapped, run.start(), run.end()))
        # a chance match leaves most of its run over; a garbled stretch is made of sequences
        if part and sum(m.end() - m.start() for m in part) * 10 >= 7 * (run.end() - run.start()):
            found += part
    return [(m.start(), m.end(), m.group().encode("latin-1").decode("utf-8", "replace")) for m in found]


def _strange(text: str) -> int:
    """Characters that prose does not use."""
    return sum(1 for c in text if c > "\x7f" and not _ALONE.match(c) and not _IN_WORDS.match(c))


@lru_cache(maxsize=50_000)
def _meant(shown: str) -> str:
    """A span undone as often as it can be, through the pages that leave the fewest strange characters."""
    best, least = shown, _strange(shown)
    for codec in SHOWN_AS:
        if _HINTS[codec].search(shown) and (spans := _sequences(shown, codec)):
            m = _meant(_apply(shown, spans))
            if (_strange(m), len(m)) < (least, len(best)) and (codec not in _CYRILLIC_PAGES or _accepted(m, codec, "")):
                best, least = m, _strange(m)
    return best


def _accepted(meant: str, codec: str, others: str) -> bool:
    """Whether a span reads like prose rather than like a chance match."""
    alone = len(_ALONE.findall(meant))
    if _strange(meant):
        return False
    if codec in _CYRILLIC_PAGES:
        # an upper-case letter before a quotation mark, or two look-alike letters, look like a sequence
        native = re.search("[а-я]{3}", others) is not None
        return len(meant) >= 2 and alone < len(meant) or not native and bool(_LATIN_PROSE.fullmatch(meant))
    return alone == len(meant) or len(meant) >= 2


def repair_spans(text: str) -> list[tuple[int, int, str]]:
    """One round: non-overlapping (start, end, replacement) of garbled multibyte spans, through one page."""
    if ordinary(text):
        return []
    found: list[list[tuple[int, int, str]]] = []
    for codec in SHOWN_AS:
        if not _HINTS[codec].search(text):
            continue
        spans = _sequences(text, codec)
        others = ""
        if codec in _CYRILLIC_PAGES:  # natural Cyrillic letters outside the spans, in their own code points
            others = _apply(text, [(s, e, " ") for s, e, _ in spans])
        good = [x for x in spans if _accepted(_meant(x[2]), codec, others)]
        # a word of one letter counts beside longer ones of its script
        scripts = {script_of(m) for x in good if len(m := _meant(x[2])) >= 2} - {"none", "latin"}
        if scripts and len(good) < len(spans):
            good = [x for x in spans if x in good or not _strange(m := _meant(x[2])) and script_of(m) in scripts]
        if good:
            found.append(good)
    if len(found) < 2:
        return found[0] if found else []
    covered = lambda spans: sum(e - s for s, e, _ in spans)
    return min(found, key=lambda spans: (_damage(_apply(text, [(s, e, _meant(r)) for s, e, r in spans])), -covered(spans)))


def _apply(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, r in spans:
        out += [text[at:s], r]
        at = e
    return "".join([*out, text[at:]])


_ACC_UP = "À-ÖØ-ÞŠŽŸŒ"
_LOW = "a-zß-öø-ÿšžœ"
_ODD = "‰ƒˆ˜¤¦§¨©¬®¯±³´µ¶¸¹¼½¾×÷†‡‹›₧⌐∞≤≥≈∆◊ⁿΘ"
_CYR_LIKE = "аеорсухіѕјԁԛԝӏһѵёїАВЕКМНОРСТУХІЅЈЁЇҮЗ"
_CONSONANTS = "бвгджзйклмнпрстфхцчшщъьБВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ"
#: Places where no intended character stands: each is one sign of a wrong page.
SIGNS = {
    "replacement": re.compile("�"),
    "control": re.compile("[\x80-\x84\x86-\x9f]"),
    "upper_in_word": re.compile(f"[{_LOW}][{_ACC_UP}](?![A-Z])|[A-ZÀ-Þ][ÒÓÔÕ][a-z]|[!?.,…][ÒÓÔÕ](?=\\s|$)"),
    "symbol_in_word": re.compile(f"[A-Za-zÀ-ÿЀ-џ][{_ODD}][A-Za-zÀ-ÿЀ-џ]|â€"),
    "box": re.compile("[─-▟][A-Za-zÀ-ɏЀ-џ─-▟ -¿]|[A-Za-zÀ-ɏЀ-џ][─-▟]"),
    "high_run": re.compile("(?<![¡-ÿ])[¢-ª¬-º¼-¾À-ÿ][¡-ÿ]{3,}|(?<![A-Za-zÀ-ÿ])[À-ÿ]{3,}\\s+[À-ÿ]{3,}(?![A-Za-z])"),
    "swapped_case": re.compile("(?<![А-ЯЁ])[а-яё][А-Я]{2,}"),
    "no_vowels": re.compile(f"(?<![А-яЁё])[{_CONSONANTS}]{{3,}}\\s+[{_CONSONANTS}]{{4,}}(?![А-яЁё])"),
    "mixed_script": re.compile(f"[bdf-hk-nq-rt-wz](?![{_CYR_LIKE}])[Ѐ-џҐґ][a-z]|[a-z](?![{_CYR_LIKE}])[Ѐ-џҐґ][bdf-hk-nq-rt-wz]"),
}
_ANY = re.compile("|".join(f"(?:{r.pattern})" for r in SIGNS.values()))
#: Characters beyond ASCII of which a sign needs one; signs whose characters a text lacks are not looked for.
_NEEDS = {
    "replacement": "�", "control": "\x80-\x9f", "upper_in_word": f"{_ACC_UP}ÒÓÔÕ", "symbol_in_word": f"{_ODD}â", "box": "─-▟", "high_run": "¡-ÿ",
    "swapped_case": "А-яЁё", "no_vowels": "А-яЁё", "mixed_script": "Ѐ-џҐґ",
}
_NEEDS = {k: re.compile(f"[{v}]") for k, v in _NEEDS.items()}


@cache
def _any_of(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{SIGNS[n].pattern})" for n in names))


#: (page it was shown through, page it was written in) for texts that are not UTF-8 underneath.
PAIRS = (
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1251"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"),
    ("cp1251", "cp1252"), ("cp1252", "shift_jis"), ("cp1252", "euc_jp"), ("cp1252", "gbk"), ("cp1252", "big5"), ("cp1252", "cp874"), ("cp1252", "cp1256"),
)


def signs(text: str) -> int:
    """How many places of a text show a wrong page."""
    if ordinary(text):
        return 0
    chars = "".join(c for c in set(text) if c > "\x7f")
    names = tuple(n for n, r in _NEEDS.items() if r.search(chars))
    return sum(1 for _ in _any_of(names).finditer(text)) if names else 0


def _stretches(shown: str, double: bool) -> re.Pattern:
    """Maximal runs of characters that the page has; with single bytes ASCII stays outside."""
    page = _PAGES.get(shown) or _PAGES.setdefault(shown, _Bytes(shown))
    high = "".join(re.escape(chr(k)) for k, v in page.items() if v != _NONE and k >= 0x80)
    return re.compile(f"[{high}!-~]*[{high}][{high}!-~]*" if double else f"[{high}]+")


_DOUBLE = ("shift_jis", "euc_jp", "gbk", "big5")


def _through(text: str, shown: str, written: str, every: bool) -> list[tuple[int, int, str]] | None:
    """Stretches (every one, or those that touch a sign) taken as bytes of one page and read in the other; None if not well-formed."""
    page = _PAGES[shown] if shown in _PAGES else _PAGES.setdefault(shown, _Bytes(shown))
    out = []
    for m in _STRETCH[shown, written in _DOUBLE].finditer(text):
        if not every and not _ANY.search(text, max(0, m.start() - 1), min(len(text), m.end() + 1)):
            continue
        raw = m.group().translate(page).encode("latin-1")
        try:
            new = raw.decode(written)
        except UnicodeDecodeError:
            if written not in _DOUBLE:
                return None
            new = raw.decode(written, "replace")
        out.append((m.start(), m.end(), new))
    return out


_STRETCH = {(a, d): _stretches(a, d) for a in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866") for d in (False, True)}


def _damage(text: str) -> int:
    """Signs of a wrong page, and characters that prose does not use."""
    return signs(text) + _strange(text)


def other_page(text: str) -> tuple[list[tuple[int, int, str]], str]:
    """The stretches that another page reads with least damage, and that page; none if no page does better than none."""
    best, page, least = [], "", _damage(text)
    for shown, written in PAIRS:
        for every in (True, False):
            spans = _through(text, shown, written, every)
            if spans:
                n = _damage(_apply(text, spans))
                if n < least:
                    best, page, least = spans, written, n
    return best, page


def rounds(text: str) -> Iterator[tuple[list[tuple[int, int, str]], str]]:
    """(spans, page they were written in) of one repair after another, each of the text the last one left, until none is found.

    Every round shortens the text or leaves it less damaged, so there is a last one.
    """
    while True:
        spans, page = repair_spans(text), "utf-8"
        if not spans and signs(text):
            spans, page = other_page(text)
        if not spans:
            return
        yield spans, page
        text = _apply(text, spans)


def restore(text: str | None) -> tuple[str | None, bool, int]:
    """(text with every recoverable span decoded, whether anything was garbled, signs left that cannot be undone)."""
    if not text or not text.strip() or ordinary(text):
        return text, False, 0
    hit = False
    for spans, _ in rounds(text):
        hit, text = True, _apply(text, spans)
    left = signs(text)
    return text, hit or left > 0, left


def garbling(df: DataFrame, text: str = "text", out: str = "garbling") -> DataFrame:
    """Adds a struct column (restored STRING, garbled BOOLEAN, left INT): see `restore`. Null text gives nulls and false."""

    @F.pandas_udf(T.StructType([T.StructField("restored", T.StringType()), T.StructField("garbled", T.BooleanType()), T.StructField("left", T.IntegerType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([restore(t if isinstance(t, str) else None) for t in s], columns=["restored", "garbled", "left"])

    return df.withColumn(out, run(_col(df, text)))


def restored(text: Column) -> Column:
    """The restored text alone."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: restore(t)[0] if isinstance(t, str) else None)

    return run(text)


def _col(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]
