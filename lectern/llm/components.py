"""Connected components by alternating large and small stars, and joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut

#: A key with more than this share of the rows is hot; there are at most 1 / HOT_SHARE of them, so they may be broadcast.
HOT_SHARE = 0.002


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined to small (one row for a key): hot keys of `big` by broadcast, the others by shuffle."""
    counts = big.groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = F.broadcast(counts.crossJoin(F.broadcast(total)).where((F.col("__n") > 10000) & (F.col("__n") > HOT_SHARE * F.col("__all"))).select(key, F.lit(True).alias("__hot")))
    marked = big.join(hot, key, "left")
    cold = marked.where("__hot IS NULL").drop("__hot").join(small, key, how)
    warm = marked.where("__hot").drop("__hot").join(F.broadcast(small.join(hot, key, "left_semi")), key, how)
    return cold.unionByName(warm)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. Loops and repeated edges do no harm.

    Every round is cut off in the shared folder; only two sums reach the driver. Neighbour minima are aggregated before
    the shuffle; where one node has a great part of all edges, the sort-merge join with its minimum is split by the adaptive
    skew join, which a round's single row for each node allows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node points to its smallest neighbour, and so do its other smaller neighbours
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    return stars.unionByName(loops.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
