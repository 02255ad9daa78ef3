"""Problem 10: long exact spans shared between records.

Compressed full-text indexes answer, shard by shard, which positions of the streamed documents start a run of at least
`LEAST` characters that another document has too: backward search over a wavelet matrix computes matching statistics,
and the positions above the threshold give the intervals.

Which text has to meet in which shard is settled by winnowing: every window of LEAST characters picks its smallest
K-gram, so equal windows pick the same one. A shared window holds that K-gram and LEAST - K more characters, half of
them on one side at least; only anchors whose longer gram to the left or right occurs in two different texts (a sketch of
fixed size, which errs to the safe side) send their windows, as one segment, to the shard of their K-gram. So every
shared window meets its partner, and text that shares nothing is not indexed at all. Equal segments are collapsed before
they move. Anchors with very many different segments send short blocks of windows instead, by the core that all windows
of a block share, so no shard grows with a hot passage.

Whole copies are found by their digest: each of them is shared from end to end. Null texts and texts shorter than LEAST
share nothing; a passage repeated only within one document does not count; rows with the same text and id are one
document; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import lookup
from lectern.llm.fm_index import SharedIndex
from lectern.llm.sketch import has, sketch
from lectern.session import cut

LEAST, K = 150, 20
#: Characters of a shard, bits of the sketch, segments of one anchor that are one too many, and windows of a block.
SHARD_CHARS, SKETCH_BITS, HOT, BLOCK = 600_000, 27, 1500, 16

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _B, np.uint64)
        up[0] = 1
        down = np.full(n, _B_INV, np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over every window of w entries."""
    done, out = 1, a
    while done * 2 <= w:
        out = op(out[:-done], out[done:])
        done *= 2
    if done < w:
        out = op(out[: len(out) - (w - done)], out[w - done :])
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Grams:
    """Hashes of all grams of one text by prefix sums."""

    def __init__(self, x: np.ndarray):
        size = 1 << max(12, int(len(x) + 1).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


#: Bits of a gram's hash that rank it within a window; the others hold its position, so that the leftmost of equals wins.
_RANK = ~np.uint64((1 << 30) - 1)


class Anchors:
    """Anchors of a batch of texts of at least `least` characters, all texts at once.

    text: which text; pos, first, last: the anchor and its first and last window in the batch; start, end: its text's bounds.
    """

    def __init__(self, texts: list[str], least: int = LEAST, k: int = K):
        x = codes("".join(texts))
        lens = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lens)
        self.grams = Grams(x)
        h = self.grams.all(k)
        low = _sliding((h & _RANK) | np.arange(len(h), dtype=np.uint64), least - k + 1, np.minimum)
        of = np.repeat(np.arange(len(texts)), lens)[: len(low)]
        s = np.flatnonzero(np.arange(least, len(low) + least) <= ends[of])
        pick = (low[s] & ~_RANK).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        self.first, self.last, self.pos = s[head], s[np.concatenate([head[1:], [len(s)]]) - 1], pick[head]
        self.text = of[self.first]
        self.end, self.start = ends[self.text], (ends - lens)[self.text]
        self.hash = h[self.pos]
        self.half, self.k = (least - k) // 2, k

    def side_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The longer grams to the left and right of every anchor, where its text has them: (which, key) twice."""
        left = np.flatnonzero(self.pos - self.half >= self.start)
        right = np.flatnonzero(self.pos + self.k + self.half <= self.end)
        size = self.half + self.k
        return left, self.grams.at(self.pos[left] - self.half, size) ^ np.uint64(0x55), right, self.grams.at(self.pos[right], size)


#: Characters that are worked on at once.
BATCH_CHARS = 120_000


def _batches(b: pa.RecordBatch, k: int, least: int) -> Iterator[tuple[list[int], list[str]]]:
    rows, texts, size = [], [], 0
    for i, t in enumerate(b.column(k).to_pylist()):
        if t is not None and len(t) >= least:
            rows.append(i)
            texts.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def _digest(t: str) -> int:
    return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)


def _repeated_grams(docs: DataFrame, least: int, k: int) -> DataFrame:
    """Keys of longer grams that occur in two different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in _batches(b, 0, least):
                a = Anchors(texts, least, k)
                left, kl, right, kr = a.side_keys()
                digests = np.array([_digest(t) for t in texts], np.int64)
                keys, owners = np.concatenate([kl, kr]).view(np.int64), digests[a.text[np.concatenate([left, right])]]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], names=["key", "text"])

    seen = docs.select("text").mapInArrow(run, "key bigint, text bigint")
    return seen.groupBy("key").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("key")


def _segments(docs: DataFrame, shared, bits: int, least: int, k: int) -> DataFrame:
    """(route, anchor offset, segment, text digest, doc_id, start) of the windows of every anchor that may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_bits = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[tuple] = []
            for rows, texts in _batches(b, 1, least):
                a = Anchors(texts, least, k)
                left, kl, right, kr = a.side_keys()
                may = np.zeros(len(a.pos), bool)
                may[left[has(shared_bits, bits, kl)]] = True
                may[right[has(shared_bits, bits, kr)]] = True
                if not may.any():
                    continue
                at = a.start[may]
                first, last, pos = a.first[may] - at, a.last[may] - at, a.pos[may] - at
                digests: dict[int, int] = {}
                for n, s, e, p, r in zip(a.text[may].tolist(), first.tolist(), last.tolist(), pos.tolist(), a.hash[may].view(np.int64).tolist()):
                    d = digests.get(n)
                    if d is None:
                        d = digests[n] = _digest(texts[n])
                    out.append((r, p - s, texts[n][s : e + least], d, ids[rows[n]], s))
            if out:
                types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], names=["route", "back", "segment", "text", "doc_id", "start"])

    return docs.select("doc_id", "text").mapInArrow(run, "route bigint, back int, segment string, text bigint, doc_id bigint, start bigint")


def _blocks(segments: DataFrame, least: int) -> DataFrame:
    """Segments of hot anchors cut into blocks of windows, routed by the core that all windows of a block have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r, back, seg, d, doc, start in zip(*(c.to_pylist() for c in b.columns)):
                n = len(seg) - least + 1
                a = 0
                while a < n:
                    # blocks lie at fixed distances from the anchor, so equal windows fall into equal blocks
                    e = min(n, a + BLOCK - (a - back) % BLOCK)
                    f = a - (a - back) % BLOCK
                    # every window of the block has these characters, those of a block that is cut short as well
                    core = seg[f + BLOCK - 1 : f + least]
                    key = xxhash.xxh64_intdigest(f"{r}:{f - back}:{core}".encode("utf-8", "surrogatepass")) - (1 << 63)
                    out.append((key, back - a, seg[a : e - 1 + least], d, doc, start + a))
                    a = e
            if out:
                types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], names=["route", "back", "segment", "text", "doc_id", "start"])

    return segments.mapInArrow(run, segments.schema)


def shared_intervals(documents: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """(doc_id, text digest, start, end) of runs of at least `least` characters that another text has too; runs may overlap."""
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select("doc_id", "text")
    spark = documents.sparkSession
    keys = cut(_repeated_grams(docs, least, k))
    n = keys.count()
    bits = int(min(SKETCH_BITS, max(16, (64 * n + 1).bit_length())))
    shared = spark.sparkContext.broadcast(sketch(keys, bits))  # 2 ** bits bits, at most 16 MB
    segs = cut(_segments(docs, shared, bits, least, k))
    hot = cut(segs.groupBy("route").agg(F.approx_count_distinct("segment").alias("n")).where(F.col("n") > HOT).select("route"))
    if not hot.isEmpty():
        segs = cut(segs.join(hot, "route", "left_anti").unionByName(_blocks(segs.join(hot, "route", "left_semi").select(*segs.columns), least)))
    segs = segs.withColumn("name", F.xxhash64("segment"))
    # equal segments of one route are one, and shared from end to end if two texts have them; a route is searched if it
    # holds a segment that is not and another one that may hold parts of it
    one = segs.groupBy("route", "name").agg(F.first("segment").alias("segment"), F.min("text").alias("a"), F.max("text").alias("b"))
    one = cut(one)
    open_ = one.groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("single"), F.sum(F.length("segment")).alias("c")).where("n > 1 AND single > 0")
    open_ = cut(open_)
    chars = open_.agg(F.sum("c").alias("c")).first()["c"] or 0
    shards = max(1, round(chars / SHARD_CHARS))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [codes(s) for s in pdf["segment"]]
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        index = SharedIndex(parts, a, a != b, least)
        hit = np.concatenate([[False], index.matching(a == b) >= least, [False]])
        up = np.flatnonzero(hit[1:] & ~hit[:-1])
        down = np.flatnonzero(~hit[1:] & hit[:-1])
        seg = np.searchsorted(index.starts, up, side="right") - 1
        base = index.starts[seg]
        return pd.DataFrame({"route": pdf["route"].to_numpy()[seg], "name": pdf["name"].to_numpy()[seg], "lo": up - base, "hi": down - base - 1 + least})

    asked = one.join(open_.select("route"), "route", "left_semi").withColumn("shard", F.pmod(F.col("route"), F.lit(shards)))
    found = asked.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(search, "route bigint, name bigint, lo bigint, hi bigint")
    equal = one.where("a <> b").select("route", "name", F.lit(0).cast("bigint").alias("lo"), F.length("segment").cast("bigint").alias("hi"))
    found = found.unionByName(equal)
    where = segs.select("route", "name", "doc_id", "text", "start")
    return where.join(found, ["route", "name"]).select("doc_id", "text", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("end"))


def shared_text(documents: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """One row for every doc_id: n_chars, passages, shared_chars, shared_share (of passages of `least` characters or more)."""
    base = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    digest = base.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.md5("text")).alias("digest")).distinct()
    digest = cut(digest)
    copies = digest.where(F.col("n_chars") >= least).groupBy("digest").agg((F.min("doc_id") != F.max("doc_id")).alias("copied")).where("copied")
    digest = lookup(digest, copies, "digest", "left")
    spans = shared_intervals(documents, least, k).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # at most one span per character of a document

    @F.pandas_udf("passages bigint, shared_chars bigint")
    def cover(col: pd.Series) -> pd.DataFrame:
        rows = []
        for spans in col:
            n = chars = 0
            at = -1
            for s, e in sorted((x["start"], x["end"]) for x in spans) if spans is not None else ():
                if s > at:
                    n += 1
                    chars += e - s
                    at = e
                elif e > at:
                    chars += e - at
                    at = e
            rows.append((n, chars))
        return pd.DataFrame(rows, columns=["passages", "shared_chars"])

    out = digest.groupBy("doc_id").agg(F.max(F.coalesce("n_chars", F.lit(0))).alias("n_chars"), F.max(F.coalesce("copied", F.lit(False))).alias("copied"))
    out = out.join(spans.select("doc_id", cover("spans").alias("c")), "doc_id", "left")
    chars = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("c.shared_chars", F.lit(0)))
    return out.select("doc_id", "n_chars", F.when(F.col("copied"), 1).otherwise(F.coalesce("c.passages", F.lit(0))).cast("long").alias("passages"), chars.alias("shared_chars"), F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
