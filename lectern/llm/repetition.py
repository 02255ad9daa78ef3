"""Problem 2: repetition inside a single document.

A public tokenizer with byte fallback measures every text: characters per token (fertility), share of tokens that fall
back to bytes, entropy of the tokens, and the redundancy of their runs, how many bits the entropy of runs of tokens (of
three words; of eight characters in unspaced scripts) stays below that of as many different runs, every run weighted by
its characters. A text below the rejection band of the redundancy is rejected. The band has a floor that holds for every
text: a run that comes m times adds (m/W) w log2 m >= 2 (m-1) w / W bits, and the w's of the runs said before cover the
repeated characters, so a text that repeats a share s of its N characters has 2 s N / W bits at least (W: the characters of
all runs, each run on its own). The others are measured exactly: the readable units that lie in a run seen earlier in the
text. Whether an essay is a case does not depend on the other essays. Where a text lies among those of its script (bands of
fertility, byte share and redundancy over length) is reported beside it.

Null and blank texts have no tokens, null measures and a share of 0; other columns pass through; texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.encoding import restore
from lectern.llm.scripts import script_of, units
from lectern.llm.tokenizers import FOLDER, piece_bpe
from lectern.session import cut

#: Length of a run that counts as said before: words, and characters of scripts without blanks.
RUN_WORDS, RUN_CHARS = 3, 8
#: The share of readable text from which a document repeats itself.
SHARE = 0.4
#: Texts from this share on do not count for the line of their script's redundancy.
PLAIN = 0.2

_SCHEMA = T.StructType(
    [
        T.StructField("script", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("chars_per_token", T.DoubleType()),
        T.StructField("byte_share", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("redundancy", T.DoubleType()),
        T.StructField("run_redundancy", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
        T.StructField("repeated_share", T.DoubleType()),
    ]
)


def repeated_share(text: str | None) -> float:
    """Share of the readable characters that lie in runs of units seen earlier in the same text (loops included)."""
    return Runs(*units(text)).share() if text else 0.0


class Runs:
    """The runs of units of one text, as numbers; `w` may be any numbers that are equal for equal units."""

    def __init__(self, seq: list[str], single: bool, w: list[int] | None = None):
        self.k = RUN_CHARS if single else RUN_WORDS
        self.sizes = [1] * len(seq) if single else [*map(len, seq)]
        if w is None:
            ids: dict[str, int] = {}
            w = [ids.setdefault(x, len(ids)) for x in seq]
        self.runs = [*zip(*(w[i:] for i in range(self.k)))]

    def redundancy(self) -> tuple[float, float]:
        """Bits that the entropy of the runs stays below that of different ones, and the share of characters that as many bits may repeat at most."""
        n, k = len(self.sizes), self.k
        if not self.runs:
            return 0.0, 1.0
        counts = Counter(self.runs)
        if len(counts) == len(self.runs):
            return 0.0, 0.0
        sums = [0, *accumulate(self.sizes)]
        whole = sum(sums[k:]) - sum(sums[: n - k + 1])
        first = {r: i for i, r in reversed([*enumerate(self.runs)]) if counts[r] > 1}
        bits = sum(counts[r] * (sums[i + k] - sums[i]) * math.log2(counts[r]) for r, i in first.items()) / whole
        return bits, bits * whole / (2 * sums[n])

    def share(self) -> float:
        """Share of the characters that lie in runs seen earlier."""
        n, k = len(self.sizes), self.k
        if n < 2:
            return 0.0
        said = bytearray(n)
        seen: set[tuple] = set()
        for i, r in enumerate(self.runs):
            if r in seen:
                said[i : i + k] = b"\1" * k
            else:
                seen.add(r)
        return sum(x for x, s in zip(self.sizes, said) if s) / sum(self.sizes)


class Tokens:
    """Tokens of single words, asked of the tokenizer once; a text's tokens are those of its words, which no token crosses."""

    def __init__(self, folder: str = FOLDER):
        self.model, self.byte_ids = piece_bpe(folder)
        self.kept: dict[str, tuple[int, ...]] = {}
        self.numbers: dict[tuple[int, ...], int] = {}

    def of(self, words: list[str]) -> list[tuple[int, ...]]:
        kept = self.kept
        new = [w for w in dict.fromkeys(words) if w not in kept]
        if new:
            if len(kept) > 300_000:
                kept.clear()
                self.numbers.clear()
                new = [*dict.fromkeys(words)]
            kept.update(zip(new, map(tuple, self.model.encode(new, num_threads=1))))
        return [kept[w] for w in words]

    def measure(self, text: str, every: bool) -> tuple:
        """A row of _SCHEMA for one text, letters only, lower case; the share of what the band rejects only if every."""
        seq, single = units(text)
        script = script_of(text)
        if not seq:
            return (script, 0, None, None, None, None, None, True, 0.0)
        # in unspaced scripts tokens run over the units, so whole stretches are tokenised, and the unit is the character
        parts = self.of(seq) if not single else self.model.encode(["".join(seq)], num_threads=1)
        ids = [*chain.from_iterable(parts)]
        n = len(ids)
        chars = sum(map(len, seq))
        h = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        runs = Runs(seq, single, None if single else [self.numbers.setdefault(p, len(self.numbers)) for p in parts])
        bits, most = runs.redundancy()
        rejected = most < SHARE - 1e-9
        return (script, n, chars / n, sum(i in self.byte_ids for i in ids) / n, h, math.log2(n) - h, bits, rejected, runs.share() if every or not rejected else None)


def measures(df: DataFrame, text: str = "text", out: str = "repetition", folder: str = FOLDER, every: bool = True) -> DataFrame:
    """Adds the struct column `out` with the tokenizer's measures; if not every, the share of what the band rejects is null."""

    @F.pandas_udf(_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(folder)
        for s in batches:
            yield pd.DataFrame([tokens.measure(restore(t)[0] if isinstance(t, str) else "", every) for t in s], columns=_SCHEMA.names)

    return df.withColumn(out, run(df[f"`{text}`"]))


def bands(measured: DataFrame, out: str = "repetition") -> DataFrame:
    """Per script: the line of redundancy over log2(tokens) of texts that hardly repeat (null if there is none), and the bands of fertility and byte share (1 %, middle, 99 %) of all texts."""
    m = measured.select(f"{out}.*").where("n_tokens > 1")
    plain = F.col("repeated_share") < PLAIN
    x, redundancy = F.when(plain, F.log2("n_tokens")), F.when(plain, F.col("redundancy"))
    return m.groupBy("script").agg(
        F.count("*").alias("texts"),
        F.coalesce(F.regr_slope(redundancy, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(redundancy, x), F.avg(redundancy)).alias("intercept"),
        F.percentile_approx("chars_per_token", [0.01, 0.5, 0.99], 1000).alias("fertility"),
        F.percentile_approx("byte_share", [0.01, 0.5, 0.99], 1000).alias("bytes"),
    )


def repeating(essays: DataFrame, folder: str = FOLDER) -> DataFrame:
    """essay_id of every essay that the band does not reject and of whose readable characters two fifths lie in repeated runs."""
    m = measures(essays.where("essay_id IS NOT NULL").select("essay_id", "text"), folder=folder, every=False)
    return m.where(f"NOT repetition.rejected AND repetition.repeated_share >= {SHARE}").select("essay_id").distinct()


def judged(essays: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Measures and repeated share of every essay, where it lies in its script's bands, and whether it repeats itself."""
    m = cut(measures(essays.where("essay_id IS NOT NULL").select("essay_id", "label", "model", "text"), folder=folder).drop("text"))
    b = F.broadcast(bands(m).withColumnRenamed("script", "band_script"))  # one row for each script
    j = m.join(b, F.col("repetition.script") == F.col("band_script"), "left").drop("band_script")
    surplus = F.col("repetition.redundancy") - (F.col("intercept") + F.col("slope") * F.log2("repetition.n_tokens"))
    j = j.withColumn("surplus", F.when(F.col("repetition.n_tokens") > 1, surplus))
    return j.select(
        "essay_id", "label", "model", "repetition.*", "surplus",
        (~F.col("repetition.chars_per_token").between(F.col("fertility")[0], F.col("fertility")[2])).alias("odd_fertility"),
        (~F.col("repetition.byte_share").between(F.col("bytes")[0], F.col("bytes")[2])).alias("odd_bytes"),
        (~F.col("repetition.rejected") & (F.col("repetition.repeated_share") >= SHARE)).alias("repeats"),
    )
