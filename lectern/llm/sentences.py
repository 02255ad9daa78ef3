"""Problem 5: sentence boundaries across languages and scripts.

A semi-Markov dynamic programme selects whole sentence spans. A span between two candidate positions is scored by its
length (log-normal, as long as the sentences of its kind of script are), its opening words, its closing words, the
quotations and brackets that its ends would cut, and whether it only names the speaker of the quotation before it; the best
chain of spans covers the paragraph. How long sentences are, which words open them and which close them is counted over all
texts with marks (`learn`), in a model of fixed size; texts without marks are divided by these counts alone. Garbled,
invisible and other-width characters are read in their restored form while positions stay those of the stored text.
Positions are Unicode code points, start from 0, end exclusive.

Null, empty and blank texts give no sentence; repeated rows give repeated sentences; texts are read whole. Spans of
any number of inner candidate positions are considered.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.encoding import ordinary, rounds
from lectern.llm.lookalike import BLANKS, INVISIBLE, LOOKALIKES
from lectern.llm.scripts import script_of

# Abbreviations that a name or the rest of the sentence follows.
OPEN_ABBREVIATIONS = set(
    "mr mrs ms dr prof st messrs mme mlle cf vs approx ca e.g i.e z.b d.h bzw u.a s.o s.u inkl evtl ggf vgl sr sra srta dra dña p.ej ee m mm c.-à-d c-à-d av bd ул проф г т.е им акад напр см डॉ श्री प्रो د".split()
)
# Abbreviations that a number follows.
NUMBER_ABBREVIATIONS = set("no nos nr vol vols fig figs ch sec art abs p pp pág núm n ed стр гл ст д кв".split())
# Abbreviations that may also end a sentence.
FINAL_ABBREVIATIONS = set("a.m p.m u.s u.k u.n jr sr etc inc ltd co corp jan feb mar apr jun jul aug sept sep oct nov dec mon tue wed thu fri sat sun usw uu руб коп тыс др пр a.c d.c b.c ph.d m.d st.d e.u min max est dept".split())
# Month names that follow a German ordinal number.
_ORDINAL_AFTER = re.compile(r"\s*(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Kapitel|Stock|Klasse)\b")
# Stems of verbs that tie a quotation to its speaker.
_SPEECH = re.compile(
    r"\b(?:said|says|ask(?:ed|s)?|shout(?:ed|s)?|cried|cries|answer(?:ed|s)?|repl(?:ied|ies)|whisper(?:ed|s)?|call(?:ed|s)|yell(?:ed|s)?|mutter(?:ed|s)?|told|added|explained|insisted|wrote|thought|sagte|fragte|rief|schrie|antwortete|meinte|flüsterte|"
    r"dit|demanda|cria|crié|répondit|dijo|preguntó|gritó|respondió|сказал\w*|крикнул\w*|спросил\w*|ответил\w*|прошептал\w*)\b|[说道问喊叫答嚷]|言っ|叫ん|尋ね|聞い|答え|चिल्ला|कहा|पूछा|बोल|صرخ|قال|سأل|أجاب"
)
_TERMINAL = re.compile(r"(?:[.!?]+|[…]+|[。！？｡．]+|[؟۔]+|[।॥]+)(?:[.!?…。！？؟।]*)[\"”“»«’')\]」』）】〉》]*")
_THAI = "฀-๿"
_CLOSE = "\"”“»«’')]」』）】〉》"
_PAIR = {"(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", "‘": "’"}
_ONE = str.maketrans({**{b: " " for b in BLANKS}, **LOOKALIKES, **{chr(c): chr(c - 0xFEE0) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r)}})
_WIDTH = {k: v for k, v in _ONE.items() if chr(k) not in LOOKALIKES}
_BACK = str.maketrans({v: k for k, v in LOOKALIKES.items() if "Ѐ" <= k <= "ӿ" and v.isascii()})
#: Words that only native Cyrillic or Greek has: a letter that no Latin letter looks like, beside others of its script.
_UNLIKE = "[" + "".join(chr(c) for r in ((0x400, 0x460), (0x3B1, 0x3CA)) for c in range(*r) if chr(c) not in LOOKALIKES) + "]"
_NATIVE = re.compile(f"{_UNLIKE}[Ѐ-џα-ω]{{2}}|[Ѐ-џα-ω]{{2}}{_UNLIKE}")
_MIXED = re.compile("[A-Za-z]*[Ѐ-џ][A-Za-zЀ-џ]*|(?<=[Ѐ-џ] )[aceopxyABCEHKMOPTXY](?= [Ѐ-џ])")
_DROP = re.compile(f"[{INVISIBLE}]")
_BREAK = re.compile(r"[^\S\n]*\n[^\S\n]*(?:\n\s*)+|[ \x0c]+")


def working(text: str) -> tuple[str, list[int] | None]:
    """The text as it is meant, and for each of its positions (and its end) the position in the stored text; None: the same."""
    if ordinary(text):
        return text.replace("\xa0", " "), None
    at: list[int] | None = None
    for spans, page in rounds(text):
        at = at or list(range(len(text) + 1))
        parts, new, k = [], [], 0
        for s, e, r in spans:
            parts += [text[k:s], r]
            new += at[k:s]
            p = s
            for c in r:  # every character comes from as many characters as it has bytes in the page it was written in
                new.append(at[min(p, e - 1)])
                p += len(c.encode(page)) if c != "\ufffd" or page == "utf-8" else 1
            k = e
        parts.append(text[k:])
        new += at[k:]
        text, at = "".join(parts), new
    if _DROP.search(text):
        at = at or list(range(len(text) + 1))
        keep = [i for i, c in enumerate(text) if not _DROP.match(c)]
        at = [at[i] for i in keep] + [at[-1]]
        text = "".join(text[i] for i in keep)
    if not _NATIVE.search(text):
        return (text if _ONE.keys().isdisjoint(map(ord, set(text))) else text.translate(_ONE)), at
    # Latin letters inside words of native Cyrillic or Greek are look-alikes the other way round
    text = text.translate(_WIDTH)
    return _MIXED.sub(lambda m: m.group().translate(_BACK), text), at


def _quotes(t: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Matched quotations and brackets of a paragraph as (open, close) positions, without those inside others."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in re.finditer("[\"()\\[\\]「」『』（）【】《》〈〉«»“”„‘’]", t[lo:hi]):
        c, i = m.group(), lo + m.start()
        before = t[i - 1] if i > lo else " "
        after = t[i + 1] if i + 1 < hi else " "
        if c in "’‘" and before.isalnum() and after.isalnum():
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), -1)
        if k < 0 and c == "”":
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "“"), -1)
        if k >= 0 and (c != '"' or not before.isspace() or after.isspace()):
            found.append((stack[k][1], i))
            del stack[k:]
        elif c == '"':
            if not after.isspace():
                stack.append(('"', i))
        elif c == "’":
            continue
        elif c in _PAIR:
            stack.append((_PAIR[c], i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


_TOKEN = re.compile(r"[^\s\"“„«(\[‘]+$")
_WORD = re.compile(r"[^\W\d_]+")

#: Buckets of the word counts, and the weight and floor of a span's length: beyond the floor all spans are alike.
BUCKETS, LENGTH_WEIGHT, LENGTH_FLOOR = 1 << 16, 0.6, -2.0
#: Sentences of one source may be alike; others are not, so the spread is this at least.
LEAST_SPREAD = 0.75
#: Kinds of script that are divided alike: words between blanks, none, and Thai.
KINDS = ("spaced", "unspaced", "thai")


class Model:
    """What sentences look like: log-odds that a capitalised word opens one and that a word closes one, and lengths by kind of script.

    `counts` has four rows of BUCKETS counts: capitalised words at a start and within, words at an end and within.
    """

    def __init__(self, counts: np.ndarray | None = None, lengths: dict[str, tuple[float, float]] | None = None):
        self.lengths = {"spaced": (4.1, LEAST_SPREAD), "unspaced": (2.8, LEAST_SPREAD), "thai": (3.1, LEAST_SPREAD)} | (lengths or {})
        self.tables = {k: self._table(*v) for k, v in self.lengths.items()}
        self.opens = self.closes = None
        if counts is not None:
            c = counts.astype(np.float64)
            total = np.maximum(c.sum(axis=1), 1.0)
            self.opens = np.log((c[0] + 0.5) / (c[1] + 0.5)).clip(-4, 4)
            self.closes = (np.log((c[2] + 0.5) / (c[3] + 0.5)) - np.log(total[2] / total[3])).clip(-3, 3)

    @staticmethod
    def bucket(word: str) -> int:
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & BUCKETS - 1

    def opening(self, word: str) -> float:
        return 2.0 if self.opens is None else float(self.opens[self.bucket(word)])

    def closing(self, word: str) -> float:
        return 0.0 if self.closes is None else float(self.closes[self.bucket(word)])

    @staticmethod
    def _table(mean: float, spread: float) -> tuple[list[float], int]:
        """(scores of spans of n characters, number of characters from which on they are the floor)."""
        far = int(math.exp(mean + spread * math.sqrt(-2 * LENGTH_FLOOR))) + 1
        table = [LENGTH_FLOOR, *(max(LENGTH_FLOOR, -0.5 * ((math.log(n) - mean) / spread) ** 2) for n in range(1, far))]
        return [LENGTH_WEIGHT * x for x in table], far


def learn(texts: DataFrame, text: str = "text") -> Model:
    """The model of all texts that have marks; expressions and a fixed number of counts (4 x BUCKETS) that reach the driver."""
    t = F.col("__t")
    thai = t.rlike("[ก-๛]")
    marked = texts.select(F.col(f"`{text}`").alias("__t")).where(t.isNotNull() & (thai | (F.regexp_count(t, F.lit("[.!?。！？।؟…]")) * 400 >= F.length(t))))
    words = (
        r"(?:^|[.!?…][\"”»’)]{0,2}\s{1,3}[\"“«‘(]?)(\p{Lu}\p{L}*)", r"[\p{Ll},;:]\s(\p{Lu}\p{L}*)",
        r"(?<!\p{L})(\p{L}++)[.!?…]", r"(\p{L}++)(?=,?\s+\p{L})",
    )

    def bucketed(kind: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda w: F.struct(F.lit(kind).alias("kind"), F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")))

    found = F.inline(F.flatten(F.array(*[bucketed(i, p) for i, p in enumerate(words)])))
    got = marked.select(found).groupBy("kind", "bucket").agg(F.count("*").alias("n")).toPandas()  # at most 4 x BUCKETS rows
    counts = np.zeros((len(words), BUCKETS))
    counts[got["kind"].to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"]
    kind = F.when(t.rlike("[぀-ヿ一-鿿]"), "unspaced").when(thai, "thai").otherwise("spaced")
    pieces = F.when(kind == "thai", F.split(t, "\\s+")).otherwise(F.split(t, "[.!?…।؟][\"”»’)]{0,2}\\s+|[。！？]|\\n\\s*\\n"))
    # the kind of a text is told once, below the explode, not for each of its pieces
    sizes = marked.select(kind.alias("kind"), F.transform(pieces, lambda p: F.length(F.trim(p))).alias("sizes")).select("kind", F.explode_outer("sizes").alias("n")).where("n > 1")
    # abbreviations leave short pieces, so the spread is that above the middle
    rows = sizes.groupBy("kind").agg(F.percentile_approx("n", [0.5, 0.84], 1000).alias("q"), F.count("*").alias("k")).collect()  # three rows
    lengths = {r["kind"]: (math.log(r["q"][0]), max(LEAST_SPREAD, math.log(r["q"][1] / r["q"][0]))) for r in rows if r["k"] >= 30}
    return Model(counts, lengths)


def _closing(t: str, lo: int, end: int, bare: int, script: str) -> float:
    """How well a span may end at `end`; `bare` is the end of its last terminal mark, before closing quotes."""
    last = t[bare - 1]
    if last != ".":
        if last == "…":
            return 0.4 if script in ("latin", "cyrillic", "greek") else -2.0
        return 3.0
    if t[max(lo, bare - 3) : bare] == "...":
        return 0.4 if script in ("latin", "cyrillic", "greek") else -2.0
    head = t[max(lo, bare - 24) : bare - 1]
    m = _TOKEN.search(head)
    word = re.split("['’]", m.group().lower())[-1] if m else ""
    if not word:
        return 1.0
    if word in OPEN_ABBREVIATIONS or word.lstrip("(") in OPEN_ABBREVIATIONS:
        return -9.0
    if word in NUMBER_ABBREVIATIONS and re.compile(r"\s*\d").match(t, bare):
        return -9.0
    if word in FINAL_ABBREVIATIONS:
        return -0.5
    if len(word) == 1 and word.isalpha() and script not in ("han", "japanese"):
        # an initial, or one letter of an abbreviation in several parts (z. B., т. е., p. ej.)
        before = t[max(lo, bare - 6) : bare - 2].rstrip()
        return -9.0 if before.endswith(".") or t[bare - 2].isupper() and not word == "i" or t[bare - 2] in "zудтгpвcnд" else 0.5
    if word.isdigit() and len(word) <= 2 and _ORDINAL_AFTER.match(t, bare):
        return -9.0
    if script == "devanagari":
        return -2.0
    return 2.2


def _opening(t: str, end: int, start: int, hi: int, script: str, lower: bool) -> float:
    """How well the next span may open at `start` after a span that ends at `end`."""
    c = t[start]
    gap = start - end
    if c in ",;:,、，；：)]»”」』%" and not (c == "»" and gap):
        return -9.0
    if not gap:
        p = t[end - 1]
        if p in "。！？」』”’）…।؟" or script in ("han", "japanese"):
            pass
        elif c.isupper() and t[end - 2 : end - 1].islower() and t[start + 1 : start + 2].islower():
            return 0.2
        elif p in "!?" and (c.isupper() or c in "“„«¿¡\"("):
            return 0.5
        elif p in "\"»)" and c.isupper():
            return 0.5
        elif c in "“„«¿¡(" and p == ".":
            return 0.5
        else:
            return -9.0
    if c in "–—-":
        return -5.0
    if c.isupper():
        return 0.3 if lower else 1.0
    if c in "¿¡“„«「『\"'‘([（《":
        return 1.0
    if c.islower():
        if not lower or t[end - 1] in _CLOSE and t[end - 2 : end - 1] in "!?…":
            return -6.0
        m = _TOKEN.search(t, max(0, end - 24), end - 1)
        return -6.0 if t[end - 1] == "." and m and m.group().lower() in FINAL_ABBREVIATIONS else 0.5
    if c.isdigit():
        return -0.4
    return 0.8


def _is_heading(line: str, nxt: str) -> bool:
    """A line of its own that names what follows: short, without a final mark, not cut out of a sentence by a line break."""
    words = line.split()
    return 0 < len(words) <= 9 and len(line) <= 70 and line[-1] not in ".!?,;:…。！？、，؟।-–—" and (line[0].isupper() or not line[0].isascii()) and bool(nxt) and not nxt[0].islower()


def _paragraph(t: str, lo: int, hi: int, script: str, lower: bool, sparse: bool, first: bool, model: Model) -> list[tuple[int, int]]:
    """The best chain of spans over one paragraph."""
    cand: dict[int, tuple[int, float]] = {}  # end -> (start of the next span, score of a boundary there)
    quotes = _quotes(t, lo, hi)
    opens = [a for a, _ in quotes]

    def inside(p: int) -> bool:
        k = bisect_right(opens, p - 1) - 1
        return k >= 0 and quotes[k][0] < p <= quotes[k][1]

    def skip(p: int) -> int:
        while p < hi and t[p].isspace():
            p += 1
        return p

    for m in _TERMINAL.finditer(t, lo, hi):
        end = m.end()
        bare = end
        while bare > m.start() and t[bare - 1] in _CLOSE:
            bare -= 1
        # a quotation mark that opens the next sentence is not this one's
        while end > bare and t[end - 1] in "\"“«'‘" and end < hi and not t[end].isspace() and not any(b == end - 1 for _, b in quotes):
            end -= 1
        start = skip(end)
        if start >= hi:
            continue
        if t[bare - 1] == "." and start == end and (t[start].isdigit() or t[start].islower() or t[start] in "@/_-"):
            continue
        score = _closing(t, lo, end, bare, script) + _opening(t, end, start, hi, script, lower)
        if abs(score) < 1.5 and not lower and t[start].isupper():  # a mark that may stand within a sentence: the word after it tells
            score += 0.4 * max(0.0, model.opening(_WORD.match(t, start).group()))
        if end > bare and inside(end - 1) or end > bare and any(b == end - 1 for _, b in quotes):
            k = bisect_right(opens, end - 1) - 1
            a, b = quotes[k]
            if b == end - 1 and t[a] not in "([（【":
                stop = _TERMINAL.search(t, start, hi)
                tail = t[start : stop.start() if stop else hi]
                whole = not t[lo:a].strip() or t[:a].rstrip()[-1:] in ".!?。！？।؟…\n\"”»」" or t[a - 1 : a] == "\n"
                if script == "japanese" and t[start] in "とっ":
                    score -= 9
                elif whole and t[start] not in "“„«「『\"" and _SPEECH.search(" ".join(tail.split(None, 7)[:7]) if " " in tail else tail):
                    score -= 7
                elif script in ("han", "japanese", "arabic", "devanagari", "thai") and not (script in ("han", "japanese") and not whole):
                    score -= 5
        if inside(end) and not any(b == end - 1 for _, b in quotes):
            score -= 9
        if "\n" in t[end:start]:
            score += 0.3
        cand[end] = (start, score)
    for m in re.finditer(r"[^\S\n]*\n\s*", t[lo:hi]):
        end, start = lo + m.start(), lo + m.end()
        if end in cand or end <= lo or start >= hi:
            continue
        line = t[t.rfind("\n", lo, end) + 1 if t.rfind("\n", lo, end) >= 0 else lo : end]
        at = end - len(line)
        if first and at == lo and not sparse and script != "thai" and _is_heading(line.strip(), t[start : start + 1]) and not inside(end):
            # in a wrapped text the first line is as long as the others
            others = [len(x) for x in t[start:hi].split("\n")]
            score = 2.0 if len(line) * 2 <= max(others) or len(others) == 1 else -1.0
            cand[end] = (start, score)
        elif script == "thai":
            cand[end] = (start, -9.0 if inside(end) else _thai(t, end, start))
    if script == "thai":
        for m in re.finditer(r"[^\S\n]+", t[lo:hi]):
            end, start = lo + m.start(), lo + m.end()
            if end > lo and end not in cand and start < hi and t[end - 1] not in "\n" and t[start] != "\n":
                cand[end] = (start, -9.0 if inside(end) else _thai(t, end, start))
    if sparse:
        for m in re.finditer(r"\s+", t[lo:hi]):
            end, start = lo + m.start(), lo + m.end()
            if end > lo and end not in cand and start < hi and t[end - 1].isalnum() and t[start].isupper() and not inside(end):
                before = re.findall(r"[^\W_]+", t[t.rfind(" ", lo, end) + 1 or lo : end])[-1]
                # an abbreviation without its point, an initial, the number of a day
                if before.lower() in OPEN_ABBREVIATIONS or len(before) <= 2 and before.isupper() and before != "I" or before.isdigit() and _ORDINAL_AFTER.match(t, end):
                    continue
                word = _WORD.match(t, start)
                cand[end] = (start, model.opening(word.group()) + (0.0 if before.isdigit() else model.closing(before)))
    marks = sorted(e for e in cand if lo < e < hi)
    ends = [*marks, hi]
    starts = [lo, *(cand[e][0] for e in marks)]
    n = len(ends)
    lengths, long = model.tables["thai" if script == "thai" else "unspaced" if script in ("han", "japanese") else "spaced"]
    best = [-1e18] * (n + 1)
    back = [0] * (n + 1)
    best[0] = 0.0
    far, top = 0, 0  # spans that begin before far are long, and so alike; the best of them begins at top
    for j in range(1, n + 1):
        e = ends[j - 1]
        gain = cand[e][1] if e != hi else 0.0
        while far < j and e - starts[far] >= long:
            top = far if best[far] > best[top] else top
            far += 1
        if far:
            best[j], back[j] = best[top] + gain + LENGTH_WEIGHT * LENGTH_FLOOR, top
        for i in range(far, j):
            v = best[i] + gain + lengths[e - starts[i]]
            if v > best[j]:
                best[j], back[j] = v, i
    out, j = [], n
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    return out[::-1]


def _thai(t: str, end: int, start: int) -> float:
    """A blank ends a Thai sentence unless it sets off a number or stands between words of another script."""
    a, b = t[end - 1], t[start]
    if a.isdigit() or b.isdigit():
        return -9.0
    thai = re.compile(f"[{_THAI}]")
    if (thai.match(a) or a in "!?.…\"”»)") and (thai.match(b) or b in "\"“«("):
        return 2.5
    return -2.0


def split(text: str | None, model: Model = Model()) -> list[tuple[int, int]]:
    """Sentence spans (start, end) of a text in order."""
    if not text or not text.strip():
        return []
    t, at = working(text)
    script = script_of(t)
    letters = [c for c in t if c.isalpha()]
    ups = sum(c.isupper() for c in letters)
    lower = ups * 200 < len(letters) or (ups * 10 > len(letters) * 9)
    marks = len(re.findall("[.!?。！？।؟…]", t))
    sparse = script in ("latin", "cyrillic") and marks * 60 < len(t.split()) and len(t.split()) > 12
    spans: list[tuple[int, int]] = []
    lo = 0
    first = True
    for m in [*_BREAK.finditer(t), None]:
        a, b = lo, m.start() if m else len(t)
        lo = m.end() if m else b
        while a < b and t[a].isspace():
            a += 1
        while b > a and t[b - 1].isspace():
            b -= 1
        if a < b:
            spans += _paragraph(t, a, b, script, lower, sparse, first, model)
            first = False
    if at is not None:
        spans = [(at[s], at[e]) for s, e in spans]
    out: list[tuple[int, int]] = []
    for s, e in spans:
        while s > (out[-1][1] if out else 0) and _DROP.match(text[s - 1]):  # an invisible character belongs to what it precedes
            s -= 1
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("sentence", T.StringType())]))


def sentences(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """One row for every sentence: the other columns, sent_index from 0, start_char, end_char, sentence.

    `model` is what `learn` gives for the corpus; by default that of the texts themselves.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or learn(df, text))  # 2 x BUCKETS numbers

    @F.pandas_udf(_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[(a, b, t[a:b]) for a, b in split(t, shared.value)] if isinstance(t, str) else [] for t in s])

    keep = [c for c in df.columns if c not in ("sent_index", "start_char", "end_char", "sentence")]
    done = df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(run(df[f"`{text}`"])).alias("sent_index", "__s"))
    return done.select(*[F.col(f"`{c}`") for c in keep], "sent_index", "__s.start_char", "__s.end_char", "__s.sentence")
