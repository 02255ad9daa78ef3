"""Sliding-window admission per key: as a fold over sorted hits in batch, as keyed state in a stream.

A hit is admitted if fewer than `limit` admitted hits of its key lie within the last `window` seconds; a denied hit is not
recorded. The decision depends on earlier decisions, so hits of one key are taken in order. A key may hold a third of all
hits: its history is cut where no hit falls for a whole window, as no state survives such a gap, and every stretch
between two gaps is folded on its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Admitted hits per window, and the window in seconds.
LIMIT, WINDOW_S = 60, 60.0


def fold(times: list[float], limit: int, window: float, live: list[float] | None = None) -> tuple[list[tuple[bool, int]], list[float]]:
    """(allowed, remaining) of hits in order, and the hits still recorded."""
    if limit < 1 or window <= 0:
        raise ValueError("limit is 1 at least, the window positive")
    live = list(live or [])
    lo = 0
    out = []
    for t in times:
        lo = bisect_right(live, t - window, lo)
        n = len(live) - lo
        if n >= limit:
            out.append((False, 0))
        else:
            live.append(t)
            out.append((True, limit - n - 1))
    return out, live[lo:]


def admit(hits: DataFrame, key: str = "client_key", time: str = "now_s", order: str = "hit_id", limit: int = LIMIT, window: float = WINDOW_S, epoch: Column | None = None) -> DataFrame:
    """(order, key, time, allowed, remaining, reset_s) of every hit with a key and a time; repeated deliveries count once.

    All state is forgotten where `epoch` changes: hits of different epochs share none.
    """
    if limit < 1 or window <= 0:
        raise ValueError("limit is 1 at least, the window positive")
    h = hits.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(order, key, time, (epoch if epoch is not None else F.lit(0)).cast("long").alias("__epoch")).dropDuplicates([order])
    h = _quiet_runs(h, key, time, order, window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, live, lo = None, [], 0
        for pdf in batches:
            allowed, remaining = [], []
            for name, t in zip(zip(pdf[key], pdf["__run"]), pdf[time].tolist()):
                if name != at:
                    at, live, lo = name, [], 0
                lo = bisect_right(live, t - window, lo)
                n = len(live) - lo
                allowed.append(n < limit)
                remaining.append(max(0, limit - n - 1))
                if n < limit:
                    live.append(t)
                    if lo > limit:  # what has left the window goes
                        del live[:lo]
                        lo = 0
            yield pd.DataFrame({order: pdf[order], key: pdf[key], time: pdf[time], "allowed": np.array(allowed, bool), "remaining": np.array(remaining, np.int32), "reset_s": np.floor(pdf[time]).astype("int64") + int(window)})

    kinds = dict(hits.dtypes)
    schema = f"{order} {kinds[order]}, {key} {kinds[key]}, {time} {kinds[time]}, allowed boolean, remaining int, reset_s bigint"
    # sorted partitions are streamed: the state is the recorded hits of one window, however many hits a key has
    return h.repartition(key, "__run").sortWithinPartitions(key, "__run", time, order).mapInPandas(run, schema)


def _quiet_runs(h: DataFrame, key: str, time: str, order: str, window: float, slice_s: float = 3600.0) -> DataFrame:
    """Adds __run, the time of the first hit after the last gap of a whole window; hours of a key are worked on apart."""
    h = h.withColumn("__slice", F.floor(F.col(time) / slice_s))
    at = [key, "__epoch", "__slice"]
    w, over = W.partitionBy(*at).orderBy(time, order), W.partitionBy(key, "__epoch").orderBy("__slice")
    ends = h.groupBy(*at).agg(F.max(time).alias("__hi")).withColumn("__before", F.lag("__hi").over(over)).drop("__hi")
    h = h.withColumn("__prev", F.lag(time).over(w)).join(ends, at)
    fresh = F.coalesce(F.col(time) - F.coalesce("__prev", "__before") >= window, F.lit(True))
    h = h.withColumn("__start", F.when(fresh, F.col(time))).withColumn("__own", F.max("__start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    carried = h.groupBy(*at).agg(F.max("__start").alias("__last")).withColumn("__carry", F.max("__last").over(over.rowsBetween(W.unboundedPreceding, -1))).select(*at, "__carry")
    run = F.concat_ws("/", "__epoch", F.coalesce("__own", "__carry"))
    return h.join(carried, at).select(order, key, time, run.alias("__run"))


# Version named in every answer, and the message of a refusal.
API_VERSION, REFUSED = "1.0", "Rate limit exceeded, please retry later."


def respond(admitted: DataFrame, time: str = "now_s", limit: int = LIMIT) -> DataFrame:
    """Adds status (200 or 429), the map of headers and, for refused hits, the body of the answer."""
    refused = ~F.col("allowed")
    retry = F.greatest(F.col("reset_s") - F.floor(time), F.lit(0)).cast("string")
    common = [("X-API-Version", F.lit(API_VERSION)), ("X-RateLimit-Limit", F.lit(str(limit))), ("X-RateLimit-Remaining", F.col("remaining").cast("string")), ("X-RateLimit-Reset", F.col("reset_s").cast("string"))]
    names = F.create_map(*[x for k, v in common for x in (F.lit(k), v)])
    headers = F.when(refused, F.map_concat(names, F.create_map(F.lit("Retry-After"), retry))).otherwise(names)
    body = F.when(refused, F.to_json(F.struct(F.struct(F.lit("RATE_LIMITED").alias("code"), F.lit(REFUSED).alias("message")).alias("error"))))
    return admitted.withColumns({"status": F.when(refused, 429).otherwise(200), "headers": headers, "body": body})


def admit_stream(hits: DataFrame, key: str = "client_key", time: str = "now_s", order: str = "hit_id", limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """The same over a stream: state per key is the list of hits recorded in the last window, at most `limit` of them."""
    kinds = dict(hits.dtypes)
    out = f"{order} {kinds[order]}, {key} {kinds[key]}, {time} {kinds[time]}, allowed boolean, remaining int"

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values([time, order], kind="stable")
        live = list(state.get[0]) if state.exists else []
        done, live = fold(pdf[time].tolist(), limit, window, live)
        state.update((live,))
        yield pd.DataFrame({order: pdf[order], key: name[0], time: pdf[time], "allowed": [a for a, _ in done], "remaining": np.array([r for _, r in done], np.int32)})

    return hits.where(F.col(key).isNotNull()).select(order, key, time).groupBy(key).applyInPandasWithState(run, out, "live array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(hits: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Hits per route and tumbling window with a watermark, for batches and streams (an extension)."""
    return hits.withWatermark("hit_at", late).groupBy(F.window("hit_at", width).alias("w"), "route").agg(F.count("*").alias("hits"), F.count_if("allowed").alias("allowed")).select(F.col("w.start").alias("window_start"), "route", "hits", "allowed")
