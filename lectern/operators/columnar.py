"""Sentences, features and evidence of whole batches of documents: what the expressions of `sentences`, `vectors`, `baselines`
and `scoring` say, over arrays.

Expressions over arrays are interpreted value by value. Here every text is read once, words are looked up once, and a
feature is one array over all sentences of a batch. Values are rounded as SQL rounds: halves of the scaled value away from zero.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lectern.functions.features import LANGUAGE_MODEL, ORDER, POS_TAGS
from lectern.functions.text import BUCKETS, PUNCTUATION, TOKEN, VOWELS
from lectern.operators.sentences import PIECE
from lectern.operators.scoring import FALLBACK, HIGH, MEDIUM
from lectern.operators.tagging import CLAUSE_OPENERS, CLOSED, ENDINGS

#: Documents taken at a time, and words that are kept.
DOCUMENTS, KEPT = 200, 200_000
TEXTUAL = len(ORDER) - len(LANGUAGE_MODEL)
NAMES = tuple(n for n, _ in BUCKETS)
LEVELS, DIRECTIONS = ("uncertain", "low", "medium", "high"), ("unknown", "lower", "higher")

_PIECE, _TOKEN, _VOWELS, _NO_WORD, _MARK = re.compile(PIECE), re.compile(TOKEN), re.compile(VOWELS), re.compile(r"[\W_]"), re.compile(f"[{PUNCTUATION}]")
_UNIT = re.compile(f"[A-Za-z0-9'À-ɏ]+|[{PUNCTUATION}]|[^ \\t\\n\\x0b\\f\\rA-Za-z0-9'À-ɏ]")
_DIGITS, _LETTER, _CAPITAL = re.compile("[0-9]+"), re.compile("[A-Za-zÀ-ɏ]"), re.compile("[A-Z]")
_CLOSED = {w: k for k, ws in reversed(CLOSED.items()) for w in ws}
_ENDINGS = tuple((k, re.compile(e)) for k, e in ENDINGS)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves of the scaled value away from zero; no negative zeros."""
    scale = 10.0**digits
    a = np.abs(x) * scale
    whole = np.trunc(a)
    r = np.copysign((whole + (a - whole >= 0.5)) / scale, x)
    return np.where(np.isfinite(r), r, x) + 0.0


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """The non-empty sentences of a text, and whether two newlines at least lie in the white space just before."""
    for raw in _PIECE.findall(text):
        s = raw.strip()  # Python's white space is that of the rule
        if s:
            yield s, raw[0].isspace() and raw[: len(raw) - len(raw.lstrip())].count("\n") >= 2


class _Known(dict):
    """What is known of a word, found out once; `fresh` drops all when there are too many."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        self[word] = v = self.of(word)
        return v

    def fresh(self) -> None:
        if len(self) > KEPT:
            self.clear()


def _tag(unit: str) -> str:
    if _DIGITS.fullmatch(unit):
        return "NUM"
    if len(unit) == 1 and _MARK.match(unit):
        return "PUNCT"
    low = unit.lower()
    if low in _CLOSED:
        return _CLOSED[low]
    if not _LETTER.search(unit):
        return "SYM"
    return next((k for k, e in _ENDINGS if e.fullmatch(low)), "PROPN" if _CAPITAL.match(unit) else "NOUN")


def _unit(unit: str) -> int:
    """Class of a unit, and 32 more if it opens a clause."""
    return POS_TAGS.index(_tag(unit)) + 32 * (unit.lower() in CLAUSE_OPENERS)


def _word(piece: str) -> int:
    """Vowel groups of a piece between white space, 0 if it has no letter or digit."""
    w = _NO_WORD.sub("", piece)
    return max(1, len(_VOWELS.findall(w))) + 1_000_000 * (len(_VOWELS.findall(w)) >= 3) if w else 0


def bucket_of_token(token: str, digits: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:digits], 16)


class Vectors:
    """The vectors of the sentences of a batch; one for a task."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float, float], digits: int):
        self.log_p, self.rank, self.entropy, self.top1 = model
        self.units, self.words, self.tokens = _Known(_unit), _Known(_word), _Known(lambda t: bucket_of_token(t, digits))

    def of(self, sentences: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a row of ORDER for each sentence, NaN where it has no value; numbers of tokens). `first`: begins a document."""
        for k in (self.units, self.words, self.tokens):
            k.fresh()
        n = len(sentences)
        counts = np.empty((10, n))
        tags: list[int] = []
        syllables: list[int] = []
        buckets: list[int] = []
        n_units, n_words = np.empty(n, np.int64), np.empty(n, np.int64)
        units, words, tokens = self.units, self.words, self.tokens
        for i, s in enumerate(sentences):
            low = s.lower()
            t = _TOKEN.findall(low)
            w = low.split()
            u = _UNIT.findall(s)
            bare = "".join(s.split())
            grams = len(set(zip(bare, bare[1:], bare[2:]))) if len(bare) >= 3 else 0
            counts[:, i] = (len(t), len(set(t)), len("".join(t)), len(set(zip(t, t[1:]))), len(bare), grams, len(_MARK.findall(s)), len(bare) if bare.isalnum() else len(_NO_WORD.sub("", bare)), len(w), len(u))
            tags += [units[x] for x in u]
            syllables += [words[x] for x in w]
            buckets += [tokens[x] for x in t]
            n_units[i], n_words[i] = len(u), len(w)
        size, kinds, letters_t, pairs, chars, grams, marks, letters, _, _ = counts
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = lambda a, b: np.where(b == 0, 0.0, a / b)
            found = {
                "ttr": ratio(kinds, size), "word_length_mean": ratio(letters_t, size), "sent_len": size, "lexical_recurrence": ratio(size - kinds, size),
                "ngram_rep_char_3": np.where(chars >= 3, 1.0 - grams / (chars - 2), 0.0), "ngram_rep_word_2": np.where(size >= 2, 1.0 - pairs / (size - 1), 0.0), "punct_density": ratio(marks, chars),
            }
            at = np.repeat(np.arange(n), n_words)
            y = np.array(syllables, np.int64)
            w = np.bincount(at, y > 0, n)
            syll, hard = np.bincount(at, y % 1_000_000, n), np.bincount(at, y >= 1_000_000, n)
            some = lambda x: np.where(w > 0, x, 0.0)
            found |= {
                "flesch_reading_ease": some(206.835 - 1.015 * w - 84.6 * (syll / w)), "flesch_kincaid_grade": some(0.39 * w + 11.8 * (syll / w) - 15.59), "ari": some(4.71 * (chars / w) + 0.5 * w - 21.43),
                "coleman_liau": some(0.058 * (100.0 * (letters / w)) - 0.296 * (100.0 / w) - 15.8), "gunning_fog": some(0.4 * (w + 100.0 * (hard / w))),
            }
            at = np.repeat(np.arange(n), n_units)
            g = np.array(tags, np.int64)
            share = np.bincount(at * len(POS_TAGS) + g % 32, minlength=n * len(POS_TAGS)).reshape(n, -1) / np.where(n_units > 0, n_units, np.nan)[:, None]
            found |= {f"pos_{k}": share[:, i] for i, k in enumerate(POS_TAGS)}
            found["pos_entropy"] = 0.0 - np.where(share > 0, share * np.log2(share), np.where(np.isnan(share), np.nan, 0.0)).sum(axis=1)
            found["clause_density"] = np.where(n_units > 0, np.bincount(at, g >= 32, n) + 1.0, np.nan)
        out = np.full((n, len(ORDER)), np.nan)
        for i, k in enumerate(ORDER[:TEXTUAL]):
            if k in found:
                out[:, i] = rounded(found[k], 6)
        self._signals(out[:, TEXTUAL:], np.array(buckets, np.int64), size.astype(np.int64), first)
        return out, size.astype(np.int64)

    def _signals(self, out: np.ndarray, buckets: np.ndarray, size: np.ndarray, first: np.ndarray) -> None:
        """The features of the count model: the first token of a document is unscored, 0 without tokens."""
        n = len(size)
        start = np.cumsum(size) - size
        unscored = first & (size > 0)
        use = np.ones(len(buckets), bool)
        use[start[unscored]] = False
        at = np.repeat(np.arange(n), size)[use]
        m = np.bincount(at, minlength=n)

        def mean_std(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mean = np.bincount(at, x, n) / np.maximum(m, 1)
            return mean, np.sqrt(np.bincount(at, (x - mean[at]) ** 2, n) / np.maximum(m, 1))

        lp, lp_std = mean_std(self.log_p[buckets[use]])
        rk, rk_std = mean_std(self.rank[buckets[use]])
        one = np.ones(n)
        columns = (rounded(np.exp(-lp), 3), rounded(one * self.entropy, 4), one * 0.0, rounded(lp, 5), rounded(lp_std, 5), rounded(rk, 4), rounded(rk_std, 4), rounded(one * self.top1, 5))
        for i, c in enumerate(columns):
            out[:, i] = np.where(m > 0, c, 0.0)


class Batch:
    """The sentences of some texts with their vectors: `doc` and `idx` say where a sentence stands, `words` counts a document's tokens."""

    def __init__(self, texts: list[str | None], vectors: Vectors):
        self.texts = texts
        sentences: list[str] = []
        gaps: list[bool] = []
        n = []
        for t in texts:
            before = len(sentences)
            for s, gap in pieces(t) if t else ():
                sentences.append(s)
                gaps.append(gap)
            n.append(len(sentences) - before)
        self.count = np.array(n, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.idx = np.arange(len(sentences)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.segment = np.cumsum((self.idx == 0) | np.array(gaps, bool))
        self.values, tokens = vectors.of(sentences, self.idx == 0)
        self.words = self.sums(tokens)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums by document of numbers of sentences."""
        return np.bincount(self.doc, x, len(self.count)).astype(np.int64)

    def passages(self) -> np.ndarray:
        """By document, how many runs of three sentences stay within a segment."""
        same = np.zeros(len(self.doc), bool)
        same[:-2] = (self.segment[2:] == self.segment[:-2]) & (self.doc[2:] == self.doc[:-2])
        return self.sums(same)


def each(docs: DataFrame, model, schema: str, use: Callable[[pa.RecordBatch, Batch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What `use` makes of every few documents, whose last column is the text; `model` is a CountModel."""
    shared: Broadcast = model.shared
    digits = model.digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(shared.value, digits)
        for b in batches:
            for i in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(i, DOCUMENTS)
                yield from use(part, Batch(part.column(part.num_columns - 1).to_pylist(), vectors))

    return docs.mapInArrow(run, schema)


# --- reference distributions --------------------------------------------------------------------------------------------


class Moments:
    """Numbers, means and squared deviations by bucket, of which parts can be added; a constant has no deviation at all."""

    def __init__(self):
        shape = (len(NAMES), len(ORDER))
        self.essays, self.n, self.mean, self.m2 = np.zeros(len(NAMES), np.int64), np.zeros(shape), np.zeros(shape), np.zeros(shape)

    def add(self, k: int, values: np.ndarray) -> None:
        there = np.isfinite(values)
        n = there.sum(axis=0).astype(float)
        if not len(values):
            return
        origin = values[there.argmax(axis=0), np.arange(values.shape[1])]
        x = np.where(there, values - origin, 0.0)
        off = x.sum(axis=0) / np.maximum(n, 1)
        d = np.where(there, x - off, 0.0)
        self.merge(k, n, np.where(n > 0, origin + off, 0.0), (d * d).sum(axis=0))

    def merge(self, k: int, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        whole = np.maximum(self.n[k] + n, 1)
        delta = np.where(self.n[k] > 0, mean - self.mean[k], 0.0)
        self.m2[k] += m2 + delta * delta * self.n[k] * n / whole
        self.mean[k] = np.where(n > 0, np.where(self.n[k] > 0, self.mean[k] + delta * n / whole, mean), self.mean[k])
        self.n[k] += n


def moments(essays: DataFrame, model) -> Moments:
    """Over the features of all sentences of essays (bucket, text); a task sends one row for each of four buckets."""
    shared: Broadcast = model.shared
    digits = model.digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, m = Vectors(shared.value, digits), Moments()
        for b in batches:
            for i in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(i, DOCUMENTS)
                of = np.array([NAMES.index(x) for x in part.column(0).to_pylist()], np.int64)
                batch = Batch(part.column(1).to_pylist(), vectors)
                m.essays += np.bincount(of, minlength=len(NAMES))
                for k in range(len(NAMES)):
                    m.add(k, batch.values[of[batch.doc] == k])
        rows = [[k, int(m.essays[k]), np.stack([m.n[k], m.mean[k], m.m2[k]]).tobytes()] for k in range(len(NAMES))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k", "essays", "moments"])

    out = Moments()
    for r in essays.select("bucket", "text").mapInArrow(run, "k long, essays long, moments binary").collect():
        out.essays[r["k"]] += r["essays"]
        out.merge(r["k"], *np.frombuffer(r["moments"]).reshape(3, -1))
    return out


# --- evidence -----------------------------------------------------------------------------------------------------------


class Scores:
    """z-scores against the distributions of a document's bucket: `stats` has (bucket, feature, mean, deviation)."""

    def __init__(self, stats: list[tuple[str, str, float, float | None]]):
        self.mean, self.std = (np.full((len(NAMES), len(ORDER)), np.nan) for _ in range(2))
        for bucket, feature, mean, std in stats:
            if feature in ORDER:
                self.mean[NAMES.index(bucket), ORDER.index(feature)] = mean
                self.std[NAMES.index(bucket), ORDER.index(feature)] = std if std is not None else np.nan
        have = {b for b, *_ in stats}
        other = next((NAMES.index(b) for b in FALLBACK if b in have), -1)
        self.resolved = np.array([i if b in have or other < 0 else other for i, b in enumerate(NAMES)])
        self.low = np.array([lo for _, lo in BUCKETS])

    def of(self, batch: Batch) -> None:
        """Adds to a batch: bucket and the one that is used by document; there, z, level and direction by sentence and feature."""
        batch.bucket = np.searchsorted(self.low, batch.words, side="right") - 1
        batch.used = self.resolved[batch.bucket]
        k = batch.used[batch.doc]
        mean, std = self.mean[k], self.std[k]
        batch.there = np.isfinite(batch.values) & ~np.isnan(mean) & (batch.words > 0)[batch.doc][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            batch.z = np.where(batch.there & (std > 0), (batch.values - mean) / std, np.nan)
        a = np.abs(batch.z)
        batch.level = np.where(np.isnan(a), 0, np.where(a >= HIGH, 3, np.where(a >= MEDIUM, 2, 1)))
        batch.direction = np.where(np.isnan(a), 0, np.where(batch.z < 0, 1, 2))
        batch.scored = batch.there.sum(axis=1)
        batch.high = (batch.there & (batch.level == 3)).sum(axis=1)
        batch.medium = (batch.there & (batch.level == 2)).sum(axis=1)

    @staticmethod
    def top(batch: Batch) -> np.ndarray:
        """The first feature by |z| to nine decimals, ties in the order of extraction."""
        a = np.where(batch.there, rounded(np.where(np.isnan(batch.z), 0.0, np.abs(batch.z)), 9), -1.0)
        return a.argmax(axis=1) if len(a) else np.zeros(0, np.int64)


def _names(names: tuple[str, ...], at: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(names).take(pa.array(at, mask=null))


def signal_rows(docs: DataFrame, model, stats: list[tuple], digits: int | None = None) -> DataFrame:
    """(doc_id, sent_idx, feature, value, z_score, evidence) of every signal of documents (doc_id, text); z + 1e-9 to some digits."""
    scores = Scores(stats)
    kind = docs.schema[0].dataType.simpleString()

    def use(part: pa.RecordBatch, batch: Batch) -> Iterator[pa.RecordBatch]:
        scores.of(batch)
        shown = batch.z if digits is None else rounded(batch.z + 1e-9, digits)
        for lo in range(0, len(batch.doc), 500):
            s, f = np.nonzero(batch.there[lo : lo + 500])
            s += lo
            z = shown[s, f]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(batch.doc[s])), pa.array(batch.idx[s].astype(np.int32)), _names(ORDER, f), pa.array(batch.values[s, f]), pa.array(z, mask=np.isnan(z)), _names(LEVELS, batch.level[s, f])],
                names=["doc_id", "sent_idx", "feature", "value", "z_score", "evidence"],
            )

    return each(docs, model, f"doc_id {kind}, sent_idx int, feature string, value double, z_score double, evidence string", use)


def signal_counts(docs: DataFrame, model, stats: list[tuple]) -> DataFrame:
    """(feature, direction, evidence, n): parts that are still to be summed, some for each few documents."""
    scores = Scores(stats)
    n_d, n_l = len(DIRECTIONS), len(LEVELS)

    def use(part: pa.RecordBatch, batch: Batch) -> Iterator[pa.RecordBatch]:
        scores.of(batch)
        s, f = np.nonzero(batch.there)
        n = np.bincount((f * n_d + batch.direction[s, f]) * n_l + batch.level[s, f], minlength=1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([_names(ORDER, at // (n_d * n_l)), _names(DIRECTIONS, at // n_l % n_d), _names(LEVELS, at % n_l), pa.array(n[at])], names=["feature", "direction", "evidence", "n"])

    return each(docs, model, "feature string, direction string, evidence string, n long", use)


def unit_rows(docs: DataFrame, model, stats: list[tuple]) -> DataFrame:
    """(doc_id, sent_idx, scored, high, medium, top_feature, top_direction) of every sentence of documents with words."""
    scores = Scores(stats)
    kind = docs.schema[0].dataType.simpleString()

    def use(part: pa.RecordBatch, batch: Batch) -> Iterator[pa.RecordBatch]:
        scores.of(batch)
        top = scores.top(batch)
        none = batch.scored == 0
        keep = pa.array(batch.words[batch.doc] > 0)
        rows = [part.column(0).take(pa.array(batch.doc)), pa.array(batch.idx.astype(np.int32)), *(pa.array(x) for x in (batch.scored, batch.high, batch.medium)), _names(ORDER, top, none), _names(DIRECTIONS, batch.direction[np.arange(len(top)), top], none)]
        yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "sent_idx", "scored", "high", "medium", "top_feature", "top_direction"]).filter(keep)

    return each(docs, model, f"doc_id {kind}, sent_idx int, scored long, high long, medium long, top_feature string, top_direction string", use)


#: Counts of a document's sentences.
COUNTS = ("units", "high", "medium", "low", "uncertain", "flagged", "passages")


def document_rows(docs: DataFrame, model, stats: list[tuple]) -> DataFrame:
    """(doc_id, chars, blank, n_words, bucket, baseline_bucket, COUNTS) of every document; null and blank texts have no sentence."""
    scores = Scores(stats)
    kind = docs.schema[0].dataType.simpleString()

    def use(part: pa.RecordBatch, batch: Batch) -> Iterator[pa.RecordBatch]:
        scores.of(batch)
        high, medium = batch.high > 0, (batch.high == 0) & (batch.medium > 0)
        none = batch.scored == 0
        numbers = (batch.count, batch.sums(high), batch.sums(medium), batch.sums(~(high | medium | none)), batch.sums(none), batch.sums(batch.high + batch.medium), batch.passages())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else len(t) for t in batch.texts], pa.int64()), pa.array([not t or t.isspace() for t in batch.texts]), pa.array(batch.words), _names(NAMES, batch.bucket), _names(NAMES, batch.used), *map(pa.array, numbers)], names=["doc_id", "chars", "blank", "n_words", "bucket", "baseline_bucket", *COUNTS])

    return each(docs, model, f"doc_id {kind}, chars long, blank boolean, n_words long, bucket string, baseline_bucket string, " + ", ".join(f"{c} long" for c in COUNTS), use)
