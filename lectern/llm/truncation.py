"""Problem 1: text cut off by field limits.

Discrete length hazards: among the texts of one limiter (a source, or a model whose texts are measured against the
tokens they were allowed) that reach a length, the share that ends exactly there. Window functions compare every hazard
with its neighbours; the surplus is tested with false-discovery control. An ending counts as broken off when it carries
a mark of a cut, leaves a quotation open, stops after an abbreviation or a comma, or, without a final stop, where the
corpus shows that sentences go on; at a significant length every ending without a final stop is broken off, but for
closing formulas. Corpus counts (which words end sentences, which lines stand alone) cover all texts.

Null and blank texts are never a case; other columns pass through; ids that come again give one row; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.repetition import SHARE, repeated_share
from lectern.llm.scripts import is_unspaced, script_of
from lectern.llm.sentences import FINAL_ABBREVIATIONS, OPEN_ABBREVIATIONS, working
from lectern.llm.sketch import has, sketch
from lectern.session import cut

#: Neighbouring lengths on each side, false-discovery rate, and the surplus a limit must show at least.
NEIGHBOURS, NEIGHBOURS_PER_TOKEN, FDR, LEAST = 25, 4, 0.01, 3
#: From how many sightings on a context is trusted, and the share of sentence ends below which a text goes on there.
SEEN, GOES_ON = 4, 0.12
#: Tokens of a line of its own that can be a formula (a sign-off, a note).
LINE = 9

# Marks that systems put where they cut a text.
_MARK = re.compile(
    r"\s*(?:(?:\[|\(|<)\s*(?:truncated|cut|snip(?:ped)?|cont(?:inued|'d|\.|d)?|more|read more|see more|\.\.\.|…)\s*(?:\.\.\.|…)?\s*(?:\]|\)|>)?|(?:\.\.\.|…)?\s*(?:read|see|show) more\s*(?:\.\.\.|…|»|>+)?|\(cont)\s*$",
    re.I,
)
#: An end that none of these marks has.
_PLAIN_END = re.compile(r"[!?”\"。！？]$|(?:^|[^.])\.$")
_ELLIPSIS = re.compile(r"\s*(?:\.\.\.+|…+)$")
_STOP = re.compile(r"[.!?。！？।؟۔]+[\"”“»«’')\]」』）]*$|[)\]」』】]$|[!?.]\s*[»”\"]$")
_CLOSERS = ".!?。！？।؟۔\"”“»«’')]」』） \t"
_TOKENS = re.compile(r"\w+(?:['’.\-]\w+)*|[.!?…。！？।؟]+|\n+|[^\w\s]")
_STOPS = re.compile(r"[.!?…。！？।؟]+")
_OPENERS = {"“": "”", "«": "»", "(": ")", "「": "」", "『": "』", "„": "“"}


def _shape(w: str) -> str:
    return "9" if w[0].isdigit() else "X" if w[0].isupper() else "w"


def _norm(w: str) -> str:
    return "9" if w[0].isdigit() else w.lower()


def _contexts(words: list[str], i: int) -> tuple[str, str, str, str]:
    """The last word after two words, one word and a kind of word; names by their kind where they only lead to it."""
    a, b, z = (words[i - 1] if i else "<s>"), words[i], (words[i - 2] if i > 1 else "<s>")
    kind = lambda w: "X" if w[0].isupper() else _norm(w)
    return f"4|{kind(z)}|{kind(a)}|{kind(b)}", f"3|{_norm(a)}|{_norm(b)}", f"2|{_norm(a)}|{_shape(b)}", f"1|{_shape(a)}|{_shape(b)}"


def _chars(t: str, end: int) -> tuple[str, str, str]:
    return f"c5|{t[max(0, end - 5) : end]}", f"c3|{t[max(0, end - 3) : end]}", f"c2|{t[max(0, end - 2) : end]}"


def _kinds(words: list[str]) -> list[str]:
    return ["9" if w[0].isdigit() else w if not w[0].isalnum() else "X" if w[0].isupper() and i else w.lower() for i, w in enumerate(words)]


def _template(kinds: list[str]) -> str:
    """A line with its numbers and names left open; a name of several words is one name."""
    return " ".join(k for i, k in enumerate(kinds) if not (k == "X" and i and kinds[i - 1] == "X"))


class Asked:
    """Which keys are asked for at all, by a sketch of fixed size that errs to the safe side; answers for words are kept."""

    def __init__(self, sketch: np.ndarray | None = None, bits: int = 0):
        self.sketch, self.bits, self.words = sketch, bits, {}

    def has(self, keys: list[str]) -> np.ndarray:
        if self.sketch is None:
            return np.ones(len(keys), bool)
        return has(self.sketch, self.bits, np.array([xxhash.xxh64_intdigest(k.encode(), 42) for k in keys], np.uint64))

    def word(self, w: str) -> tuple[bool, tuple[int, ...], bool]:
        """Whether a word is asked for as a last word, by which of its beginnings it may have been cut, and whether as the word before."""
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 500_000:
                self.words.clear()
            ahead = [f"f|{w[:m]}" for m in range(1, len(w))] if w.isalpha() else []
            y = self.has([f"u|{w}", f"v|{w}", *ahead]).tolist()
            got = self.words[w] = (y[0], tuple(m for m, x in enumerate(y[2:], 1) if x), y[1])
        return got

    def pair(self, c: str) -> bool:
        got = self.words.get("\0" + c)
        if got is None:
            got = self.words["\0" + c] = bool(self.has([f"c2|{c}"])[0])
        return got


class CorpusCounts:
    """How often words (characters in unspaced scripts) stand in a context and how often a sentence ends there; starts of lines.

    Words are counted as they stand, with the two before them; only different ones are turned into contexts, and only into
    those that are asked for.
    """

    def __init__(self, asked: Asked):
        self.asked = asked
        self.words: Counter = Counter()  # (two before, one before, word, a sentence ends)
        self.keys: Counter = Counter()  # (key, ends)

    def __len__(self) -> int:
        return len(self.words) + len(self.keys)

    def add(self, t: str) -> None:
        if is_unspaced(t):
            self._characters(t)
        else:
            self._words(t)
            self._lines(t)

    def _characters(self, t: str) -> None:
        ends = {m.start() for m in re.finditer(r"[。！？…!?]|\s+(?=[^\d\s])" if script_of(t) == "thai" else "[。！？…!?]", t)}
        for i in range(2, len(t)):
            if not t[i - 1].isspace() and self.asked.pair(t[i - 2 : i]):
                for k in _chars(t, i):
                    self.keys[k, i in ends] += 1

    def _words(self, t: str) -> None:
        toks = _TOKENS.findall(t)
        words = self.words
        z = a = "<s>"
        n = len(toks)
        for i, w in enumerate(toks):
            c = w[0]
            if not (c.isalnum() or c == "_"):
                if c in ".!?…。！？।؟\n":
                    z = a = "<s>"
                continue
            if i + 1 == n:
                break  # the text's own end is what is to be judged
            nxt = toks[i + 1]
            stop = False
            if nxt[0] in ".!?…。！？।؟":
                k = i + 2
                while k < n and toks[k] in "\"”»’)“":
                    k += 1
                stop = (k >= n or toks[k][0] == "\n" or not toks[k][0].islower()) and not (nxt[0] == "." and _norm(w) in OPEN_ABBREVIATIONS)
            words[z, a, w, stop] += 1
            z, a = a, w

    def _lines(self, t: str) -> None:
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        for j, line in enumerate(lines):
            ws = _kinds([m.group() for m in islice(_TOKENS.finditer(line), LINE + 3)])
            for k in range(1, min(len(ws), LINE + 1)):
                if not ws[k - 1] == ws[k] == "X":
                    self.keys["l|" + _template(ws[:k]), False] += 1
            if len(ws) <= LINE and j == len(lines) - 1 and j:
                self.keys["l|" + _template(ws), True] += 1

    def flush(self) -> dict[str, list[int]]:
        """key -> [times, times at an end] of the keys asked for; counting begins anew."""
        word = self.asked.word
        keys: list[str] = []
        times: list[int] = []
        ends: list[int] = []

        def put(key: str, v: int, end: int) -> None:
            keys.append(key)
            times.append(v)
            ends.append(end)

        shapes: Counter = Counter()
        for (z, a, w, stop), v in self.words.items():
            low, at = _norm(w), v if stop else 0
            last, cut_, _ = word(low)
            before = word(_norm(a))[2]
            if not (last or cut_ or before):
                continue
            k4, k3, k2, k1 = _contexts([z, a, w], 2)
            if last:
                put(k4, v, at)
                put("u|" + low, v, 0)
            if last or cut_:
                put(k3, v, at)
            for m in cut_:  # what a cut word may have been: beginnings of the words seen after its predecessor
                put(f"p{k3[1 : len(k3) - len(low) + m]}", v, 0)
            if before:
                put(k2, v, at)
            shapes[k1, stop] += v
        for (k, end), v in [*self.keys.items(), *shapes.items()]:
            put(k, v, v if end else 0)
        self.words.clear()
        self.keys.clear()
        both: dict[str, list[int]] = {}
        for i in np.flatnonzero(self.asked.has(keys)).tolist() if keys else ():
            x = both.setdefault(keys[i], [0, 0])
            x[0] += times[i]
            x[1] += ends[i]
        return both


_TAIL = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("line", T.StringType()),
        T.StructField("signature", T.BooleanType()),
        T.StructField("piece", T.BooleanType()),
        T.StructField("length", T.LongType()),
        T.StructField("letters", T.StringType()),
    ]
)
_PARTICLE = re.compile(r"^[—–-]\s*\S")


def _tail(text: str | None) -> tuple:
    """(kind of ending, contexts of its last word, template of a last line of its own, whether that is a signature, length)."""
    if not text or not text.strip():
        return ("blank", [], None, False, False, 0)
    t = working(text)[0].rstrip()
    n = len(text.rstrip())
    if not t:
        return ("blank", [], None, False, False, 0)
    m = None if _PLAIN_END.search(t, len(t) - 2) and not t.lower().endswith("cont.") else _MARK.search(t)
    if m and t[: m.start()].strip():
        return ("mark", [], None, False, False, n)
    lines = [x for x in t.split("\n") if x.strip()]
    own = len(lines) > 1
    last = lines[-1].strip()
    ellipsis = _ELLIPSIS.search(t) if t[-1] in ".…" else None
    stop = None if ellipsis else _STOP.search(t, len(t.rstrip(_CLOSERS)))
    body = t[: ellipsis.start()] if ellipsis else t[: stop.start()] if stop else t
    stops = bool(stop)
    unspaced = is_unspaced(last)
    toks = _TOKENS.findall(body.split("\n")[-1])
    words: list[str] = []
    for w in toks:
        if w[0].isalnum():
            words.append(w)
        elif _STOPS.match(w):
            words = words if w[0] == "." and words and words[-1].lower() in OPEN_ABBREVIATIONS | FINAL_ABBREVIATIONS else []
    if unspaced:
        keys = [*_chars(body, len(body))]
    else:
        keys = [*_contexts(words, len(words) - 1), "u|" + _norm(words[-1])] if words else []
        if words and words[-1].isalpha() and words[-1].islower():
            keys += [f"p|{_norm(words[-2]) if len(words) > 1 else '<s>'}|{words[-1]}", f"f|{words[-1]}"]
        if words:
            keys.append(f"v|{_norm(words[-2]) if len(words) > 1 else '<s>'}")
    line_tokens = _TOKENS.findall(last)
    line = "l|" + _template(_kinds(line_tokens)) if own and len(line_tokens) <= LINE else None
    names = [w for w in line_tokens if w[0].isalnum()]
    signature = bool(own and names and len(names) <= 5 and all(w[0].isupper() for w in names) and ("," in last or _PARTICLE.match(last)))
    # the beginning of a name that the text has in full, or a single capital letter
    piece = False
    if words and words[-1][0].isupper() and not stops:
        w = words[-1]
        known = set(_TOKENS.findall(t[: len(body) - len(w)]))
        piece = len(w) == 1 and w != "I" or w not in known and any(len(x) > len(w) and x.startswith(w) for x in known)
    if stops:
        # an open quotation in the last paragraph, or a stop that belongs to an abbreviation
        counts = {a: last.count(a) - last.count(b) for a, b in _OPENERS.items() if a in last}
        if counts.get("“", 0) > 0 and "„" in last:
            counts.pop("“")
        straight = len(re.findall(r'(?:(?<=\s)|^)"(?=\S)', last)) > len(re.findall(r'(?<=\S)"(?=\s|$|[,.;:!?)])', last))
        if any(v > 0 for v in counts.values()) or straight:
            return ("open", keys, line, signature, piece, n)
        w = re.search(r"([^\s\"“„«(\[‘'’]+)\.$", t)
        if w:
            word = w.group(1).lower()
            if word in OPEN_ABBREVIATIONS or word in ("no", "nr", "art", "vol", "д", "núm") and word != "no" or word == "no" and w.group(1)[0] == "N":
                return ("abbreviation", keys, line, signature, piece, n)
            if word in FINAL_ABBREVIATIONS or word[-1].isdigit() or len(word) == 1 and word.isalpha() and script_of(t) not in ("han", "japanese"):
                return ("doubtful", keys, line, signature, piece, n)
        return ("stop", [], line, signature, piece, n)
    if re.search(r"[,;:–—-]$", body):
        return ("comma", keys, line, signature, piece, n)
    return ("ellipsis" if ellipsis else "none", keys, line, signature, piece, n)


def tail(text: str | None) -> tuple:
    """`_tail` with texts that repeat themselves set apart, and a digest of all letters, by which copies of one text are one ending."""
    found = _tail(text)
    if found[0] not in ("blank", "stop") and repeated_share(working(text)[0]) >= SHARE:
        found = ("repeats", [], None, False, False, found[-1])
    return (*found, xxhash.xxh64_hexdigest(re.sub(r"\W", "", text or "").lower()))


_COUNTS = T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ends", T.LongType())])


def context_counts(texts: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """(key, n, ends) over all texts for the keys asked (a column key), counted within each partition before the shuffle."""
    n = keys.count()
    bits = int(min(26, max(16, (64 * n + 1).bit_length())))
    shared = texts.sparkSession.sparkContext.broadcast(sketch(keys.select(F.xxhash64("key").alias("key")), bits))  # 2 ** bits bits, at most 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = CorpusCounts(Asked(shared.value, bits))

        def flush() -> pa.RecordBatch:
            both = c.flush()
            return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([v[0] for v in both.values()], pa.int64()), pa.array([v[1] for v in both.values()], pa.int64())], names=_COUNTS.names)

        for b in batches:
            for t in b.column(0).to_pylist():
                if t and t.strip():
                    c.add(working(t)[0].rstrip())
                    if len(c) > 300_000:
                        yield flush()
        yield flush()

    parts = texts.select(F.col(f"`{text}`")).mapInArrow(run, _COUNTS)
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


@F.pandas_udf(T.DoubleType())
def _surplus_p(d: pd.Series, at_risk: pd.Series, hazard: pd.Series) -> pd.Series:
    """P(at least d of at_risk end here | the neighbours' hazard), Poisson tail."""

    def one(k: int, n: int, h: float) -> float:
        mean = max(n * h, 1e-12)
        if k <= 0:
            return 1.0
        term = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        total, j = 0.0, k
        while term > total * 1e-12 and j < k + 2000:
            total += term
            j += 1
            term *= mean / j
        return min(1.0, total) if mean < k else 1.0

    return pd.Series([one(int(a), int(b), float(c)) for a, b, c in zip(d, at_risk, hazard)])


def length_hazards(lengths: DataFrame) -> DataFrame:
    """From (limiter, unit): for every limiter and length d, at_risk, hazard, neighbours' hazard, p and whether it is significant.

    Aggregated before any window; the Benjamini-Hochberg threshold is read off a histogram of log p of bounded size.
    """
    d = lengths.where("limiter IS NOT NULL AND unit IS NOT NULL").select("limiter", "per_token", "unit", "letters").distinct().groupBy("limiter", "per_token", "unit").agg(F.count("*").alias("d"))
    down = W.partitionBy("limiter").orderBy(F.col("unit").desc()).rowsBetween(W.unboundedPreceding, 0)
    h = d.withColumn("at_risk", F.sum("d").over(down))

    def around(c: str):
        near = W.partitionBy("limiter").orderBy("unit")
        wide, narrow = (F.sum(c).over(near.rangeBetween(-k, k)) - F.col(c) for k in (NEIGHBOURS, NEIGHBOURS_PER_TOKEN))
        return F.when(F.col("per_token"), narrow).otherwise(wide)

    span = F.when(F.col("per_token"), 2 * NEIGHBOURS_PER_TOKEN).otherwise(2 * NEIGHBOURS)
    h = h.withColumn("expected", (around("d") + 0.5) / F.greatest(span * F.col("at_risk"), around("at_risk")))
    h = h.withColumn("hazard", F.col("d") / F.col("at_risk"))
    h = h.withColumn("p", F.when(F.col("d") >= LEAST, _surplus_p("d", "at_risk", "expected")).otherwise(F.lit(1.0)))
    h = cut(h.withColumn("bin", F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(3000)).cast("int")))
    bins = h.groupBy("bin").agg(F.count("*").alias("k"))
    w = W.orderBy(F.col("bin").desc())  # at most 3001 rows
    bh = bins.withColumn("rank", F.sum("k").over(w)).withColumn("m", F.sum("k").over(W.partitionBy(F.lit(1))))
    level = bh.where(F.pow(F.lit(10.0), -F.col("bin") / 10.0) <= FDR * F.col("rank") / F.col("m")).agg(F.coalesce(F.min("bin"), F.lit(100000)).alias("level"))
    return h.crossJoin(F.broadcast(level)).withColumn("significant", (F.col("bin") >= F.col("level")) & (F.col("d") >= LEAST)).drop("bin", "level")


def endings(essays: DataFrame) -> DataFrame:
    """One row for every essay_id: limiter, unit, kind of ending, at_limit, cause (null: not broken off), broken.

    At a significant length of its limiter every ending without a final stop is broken off ('limit'). Cuts in transfer stand at
    no length of their own; they are told by a mark of the cut, an open quotation, an abbreviation or a comma at the end, a
    word that is cut ('fragment') or a place where the corpus goes on ('context').
    """
    limiter = F.coalesce(F.lower(F.trim("source")), F.lower(F.trim("model")))
    allowed = F.when(F.col("source").isNull() & (F.col("generation_config.max_tokens") > 0), F.col("generation_config.max_tokens"))

    @F.pandas_udf(_TAIL)
    def tails(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([tail(t if isinstance(t, str) else None) for t in s], columns=_TAIL.names)

    e = essays.where("essay_id IS NOT NULL").select("essay_id", "text", "source", "model", "generation_config")
    e = cut(e.select("essay_id", F.coalesce("source", "model").alias("origin"), limiter.alias("limiter"), allowed.alias("allowed"), tails("text").alias("t")))
    e = e.select("essay_id", "origin", F.concat("limiter", F.when(F.col("allowed").isNotNull(), F.lit(" per token")).otherwise(F.lit(""))).alias("limiter"), F.col("allowed").isNotNull().alias("per_token"), F.when(F.col("allowed").isNotNull(), F.round(F.col("t.length") * 10 / F.col("allowed"))).otherwise(F.col("t.length")).cast("long").alias("unit"), "t.*")
    # a repeated delivery is one text
    e = e.groupBy("essay_id").agg(*[F.min_by(c, F.struct(F.col("length").isNull(), -F.col("length"), "kind")).alias(c) for c in ("origin", "limiter", "unit", "kind", "keys", "line", "signature", "piece", "length", "per_token", "letters")])
    e = cut(e)
    limits = length_hazards(e.where("kind NOT IN ('blank', 'repeats')")).where("significant").select("limiter", "unit", F.lit(True).alias("at_limit"))
    e = e.join(limits, ["limiter", "unit"], "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))

    asked = cut(e.where("kind IN ('none', 'ellipsis', 'comma', 'doubtful')").select("essay_id", F.posexplode(F.array_compact(F.concat("keys", F.array("line")))).alias("i", "key")))
    counts = context_counts(essays.where("essay_id IS NOT NULL"), asked.select("key").distinct())
    seen = asked.join(counts, "key", "left")
    level = lambda p: F.max(F.when(F.col("key").startswith(p), F.struct("n", "ends")))
    known = seen.groupBy("essay_id").agg(level("4|").alias("k4"), level("3|").alias("k3"), level("2|").alias("k2"), level("1|").alias("k1"), level("c5|").alias("c5"), level("c3|").alias("c3"), level("c2|").alias("c2"), level("u|").alias("u"), level("l|").alias("l"), level("p|").alias("longer"))
    e = e.join(known, "essay_id", "left")
    share = lambda k: F.when(F.col(k)["n"] >= SEEN, F.col(k)["ends"] / F.col(k)["n"])
    rate = F.coalesce(share("k4"), share("k3"), share("k2"), share("c5"), share("c3"), share("k1"), share("c2"))
    # a lower-case word that the corpus hardly knows was cut
    cut_word = (F.col("longer")["n"] >= 3) & (F.coalesce(F.col("k3")["n"], F.lit(0)) * 10 < F.col("longer")["n"])
    fragment = F.coalesce(cut_word, F.lit(False)) | F.col("piece") | F.exists("keys", lambda k: k.startswith("2|") & k.endswith("|w")) & (F.coalesce(F.col("u")["n"], F.lit(0)) < 2)
    formula = F.col("line").isNotNull() & ((F.coalesce(F.col("l")["ends"], F.lit(0)) >= 3) & (F.col("l")["ends"] * 2 >= F.col("l")["n"]))
    cause = (
        F.when(F.col("kind").isin("blank", "repeats", "stop"), None)
        .when(F.col("at_limit") & ~formula & (F.col("kind") != "doubtful"), "limit")
        .when(F.col("kind").isin("mark", "open", "abbreviation"), F.col("kind"))
        .when(formula, None)
        .when(F.col("kind") == "comma", "comma")
        .when(F.col("kind") == "doubtful", F.when(F.coalesce(rate, F.lit(1.0)) < 0.1, "context"))
        .when(F.col("signature"), None)
        .when(fragment, "fragment")
        .when(F.coalesce(rate, F.lit(0.0)) < GOES_ON, "context")
    )
    return e.withColumn("rate", rate).withColumn("fragment", fragment).withColumn("formula", formula).withColumn("cause", cause).withColumn("broken", cause.isNotNull())
