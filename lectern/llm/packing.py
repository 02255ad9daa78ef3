"""Problem 8: filling fixed-capacity containers with items.

Documents are dealt by hash into shards of bounded size; what a shard loses at its end is part of one container. In a
shard first fit, in the order of ids, fills containers and leaves room in them; then swap-based local search runs over the
underfull ones, emptiest first: one or two documents move into a fuller container, against none, one or two of its own,
with the partner it fills most tightly, wherever that raises the sum of squared fills, until the emptiest containers have disappeared and no such step is left
anywhere. Partners are found in an index of every underfull container by what it can take (room plus the documents it
would give), so none is passed over. A document larger than the capacity is cut into full pieces at token boundaries and
its rest is an item like any other; nothing else is ever divided.

Null and empty texts have no tokens and need no container; repeated ids are separate items; settings without a capacity of
at least one token are left out; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.sizes import token_counts
from lectern.llm.tokenizers import FOLDER
from lectern.session import cut

SHARD = 4000


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (by index) in their order, each into the first container that holds it; a tree over the containers finds it."""
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [capacity] * (2 * width)  # of a node: the most room below it
    bins: list[list[int]] = []
    for i, s in enumerate(sizes):
        at = 1
        while at < width:
            at = 2 * at if room[2 * at] >= s else 2 * at + 1
        if at - width == len(bins):
            bins.append([])
        bins[at - width].append(i)
        room[at] -= s
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


class LocalSearch:
    """Exchanges between underfull containers that raise the sum of squared fills, until none is left.

    A container with room r that gives away sizes of sum z can take r + z, and is then full. `offers` holds, for every such
    sum, who can take it and against what; `bits` marks the sums there are, so the tightest partner of a size is the next
    mark above it. Offers are made of distinct sizes, of which a container has at most the root of twice its capacity.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.capacity = capacity
        self.bins: list[dict[int, list[int]]] = []
        for b in bins:
            by_size: dict[int, list[int]] = {}
            for i in b:
                by_size.setdefault(sizes[i], []).append(i)
            self.bins.append(by_size)
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.offers: list[dict[tuple[int, tuple[int, ...]], int]] = [{} for _ in range(capacity + 1)]
        self.bits = 0
        #: Steps taken by (documents in, documents out).
        self.steps: Counter = Counter()
        for k in range(len(bins)):
            self._enter(k)

    def _some(self, k: int, none: bool):
        """None (if allowed), one or two sizes of a container, and their sum."""
        b = self.bins[k]
        if none:
            yield (), 0
        for s in b:
            yield (s,), s
        for s, t in combinations_with_replacement(b, 2):
            if s != t or len(b[s]) > 1:
                yield (s, t), s + t

    def _enter(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if room and self.bins[k]:
            for out, z in self._some(k, True):
                self.offers[room + z][k, out] = z
                self.bits |= 1 << room + z

    def _leave(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if room and self.bins[k]:
            for out, z in self._some(k, True):
                at = self.offers[room + z]
                del at[k, out]
                if not at:
                    self.bits &= ~(1 << room + z)

    def _partner(self, size: int, fill: int) -> tuple | None:
        """(gain, documents' sum moved, container, sizes it gives) of the tightest offer that takes `size` and ends fuller than `fill`."""
        marks, v = self.bits >> size, size - 1
        while marks:
            skip = (marks & -marks).bit_length()
            v += skip
            marks >>= skip
            full = self.capacity - (v - size)
            if full <= fill:
                return None
            best = min(((z, j, out) for (j, out), z in self.offers[v].items() if z < size), default=None)
            if best:
                moved = size - best[0]
                return moved * (full - fill), moved, best[1], best[2]
        return None

    def _put(self, k: int, sizes: tuple[int, ...], j: int) -> None:
        """The sizes go from container k to container j."""
        for s in sizes:
            own = self.bins[k][s]
            self.bins[j].setdefault(s, []).append(own.pop())
            if not own:
                del self.bins[k][s]

    def drain(self, k: int) -> bool:
        """Takes the best step out of container k until it is empty or has none; whether there was one."""
        self._leave(k)
        did = False
        while self.bins[k]:
            best = None
            for ins, size in self._some(k, False):
                if size <= self.capacity:
                    p = self._partner(size, self.fill[k])
                    if p and (best is None or p > best[0]):
                        best = (p, ins)
            if best is None:
                break
            (_, moved, j, outs), ins = best
            self._leave(j)
            self._put(k, ins, j)
            self._put(j, outs, k)
            self.fill[k] -= moved
            self.fill[j] += moved
            self._enter(j)
            self.steps[len(ins), len(outs)] += 1
            did = True
        self._enter(k)
        return did

    def run(self) -> list[list[int]]:
        """Every step raises the sum of squared fills, which is bounded, so the passes end."""
        did = True
        while did:
            under = sorted((f, k) for k, f in enumerate(self.fill) if 0 < f < self.capacity)
            did = False
            for _, k in under:
                if 0 < self.fill[k] < self.capacity and self.drain(k):
                    did = True
        return [[i for items in b.values() for i in items] for b in self.bins if b]


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    return LocalSearch(sizes, bins, capacity).run()


def pack(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[list[int]]]:
    """(containers, those of the first fit that the search began with)."""
    first = first_fit(sizes, capacity)
    return local_search(sizes, first, capacity), first


def containers(documents: DataFrame, settings: DataFrame, folder: str = FOLDER, shard: int = SHARD) -> DataFrame:
    """(setting_id, container, first_container, doc_id, piece, start_token, n_tokens): the container of every document or piece of one.

    Container names are shard:number within a setting, first_container is where the first fit had put it; positions count
    tokens of the document.
    """
    d = cut(token_counts(documents.select("doc_id", "text"), folder=folder).where("n_tokens > 0"))
    n = d.count()
    shards = max(1, round(n / shard))
    caps = [(r["setting_id"], r["capacity_tokens"]) for r in settings.where("capacity_tokens >= 1").select("setting_id", "capacity_tokens").distinct().orderBy("setting_id").collect()]  # the settings are a short list
    schema = "setting_id int, container string, first_container string, doc_id bigint, piece int, start_token bigint, n_tokens bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids, tokens, name = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), int(pdf["shard"].iloc[0])
        out = []
        for setting, cap in caps:
            full = tokens // cap
            rest = tokens - full * cap
            whole = np.repeat(np.arange(len(ids)), full)
            piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
            has = np.flatnonzero(rest)
            where, begun = np.empty(len(has), np.int64), np.empty(len(has), np.int64)
            bins, first = pack(rest[has].tolist(), int(cap))
            for number_of, found in ((where, bins), (begun, first)):
                for b, items in enumerate(found):
                    number_of[items] = b
            index = np.concatenate([whole, has])
            named = [[f"{name}:{k}" for k in np.concatenate([np.arange(len(whole)) + len(found), number_of])] for number_of, found in ((where, bins), (begun, first))]
            part = np.concatenate([piece, full[has]])
            out.append(pd.DataFrame({"setting_id": setting, "container": named[0], "first_container": named[1], "doc_id": ids[index], "piece": part.astype("int32"), "start_token": part * cap, "n_tokens": np.concatenate([np.full(len(whole), cap), rest[has]])}))
        return pd.concat(out)[schema_names] if out else pd.DataFrame({c: [] for c in schema_names})

    schema_names = [c.split()[0] for c in schema.split(", ")]
    return d.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(2 * shards, "shard").groupBy("shard").applyInPandas(run, schema)  # few rows with much work: not for adaptive merging


def fill_report(packed: DataFrame, settings: DataFrame) -> DataFrame:
    """Per setting: containers before and after the search, tokens, items, share of the space that is used."""
    one = packed.groupBy("setting_id", "container").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("items"))
    per = one.groupBy("setting_id").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.sum("items").alias("items"), F.max("fill").alias("fullest"))
    begun = packed.select("setting_id", "first_container").distinct().groupBy("setting_id").agg(F.count("*").alias("first_containers"))
    per = per.join(begun, "setting_id").join(F.broadcast(settings.select("setting_id", "capacity_tokens").distinct()), "setting_id")  # the settings are a short list
    return per.withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
