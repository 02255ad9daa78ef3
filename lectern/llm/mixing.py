"""Problem 9: mixing sources to target weights.

Every document gets a key that is a hash of its id and the seed, so the order within a source is random and repeatable.
Ranges of keys are the buckets of the range sort: token sums are taken per (source, bucket), prefix sums over the
buckets give each bucket its offset, and a window inside the bucket finishes the prefix sum, so a source that holds a
third of all rows is cut into as many tasks as its size asks for. Each source is cut at its exact budget, share x total;
where the budget exceeds the source, whole epochs come first, up to `max_repeats`, and the rest is a shortfall that the
report shows. By default the total is the size of all documents of the sources named.

Sources compare without case and surrounding blanks. Documents without text (no tokens) add nothing and are not chosen;
documents of other sources and without a source are not chosen; a source named twice in the targets counts once with the
sum of its shares; null shares and repeats count as 0; repeated ids are separate documents. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.sizes import token_counts
from lectern.llm.tokenizers import FOLDER
from lectern.session import cut

ROWS_PER_BUCKET = 4000


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _plan(documents: DataFrame, targets: DataFrame, total: int | None, seed: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents with prefix sums, sources with budgets)."""
    t = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("long").alias("max_repeats"))
    t = t.where("source IS NOT NULL")
    named = documents.withColumn("source", source_key(F.col("source"))).join(F.broadcast(t.select("source")), "source", "left_semi")  # the targets are a list of sources, not data
    d = token_counts(named.select("doc_id", "source", "text"), folder=folder).where("n_tokens > 0")
    d = cut(d.withColumn("key", F.xxhash64("doc_id", F.lit(seed))))
    per = d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available"))
    per = cut(t.join(per, "source", "left").fillna(0, ["n_docs", "available"]))
    whole = per.agg(F.sum("available").alias("total")) if total is None else per.sparkSession.range(1).select(F.lit(int(total)).alias("total"))
    per = per.crossJoin(F.broadcast(whole))  # one row
    per = per.withColumn("budget", F.least(F.round(F.col("target_share") * F.coalesce("total", F.lit(0))).cast("long"), F.col("available") * F.col("max_repeats")))
    per = per.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    buckets = per.select("source", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_BUCKET)).alias("n_buckets"))
    span = F.lit(float(2**64))
    d = d.join(F.broadcast(buckets), "source").withColumn("bucket", F.least(F.col("n_buckets") - 1, F.floor((F.col("key").cast("double") + F.lit(float(2**63))) / span * F.col("n_buckets"))))
    sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket of thousands of documents
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.join(offsets, ["source", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return d.select("doc_id", "source", "n_tokens", "start"), per


def _chosen(d: DataFrame, per: DataFrame) -> DataFrame:
    d = d.join(F.broadcast(per.select("source", "epochs", "rest", "max_repeats")), "source")
    # a document is taken whole where more than half of it lies before the cut, so the expected error is nil
    more = (F.col("start") + F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    return d.withColumn("repeats", (F.col("epochs") + F.when(more, 1).otherwise(0)).cast("int")).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, folder: str = FOLDER) -> DataFrame:
    """The chosen documents: doc_id, source, n_tokens, repeats (how often it is used)."""
    return _chosen(*_plan(documents, targets, total, seed, folder))


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, folder: str = FOLDER) -> DataFrame:
    """For every source named: target_share, tokens available, budget, tokens taken, actual_share, documents and most repeats."""
    d, per = _plan(documents, targets, total, seed, folder)
    got = _chosen(d, per).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    out = cut(per.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"]))
    whole = out.agg(F.sum("tokens").alias("all_tokens"))
    out = out.crossJoin(F.broadcast(whole))
    return out.select(
        "source", "target_share", "max_repeats", "n_docs", "available", "budget", "tokens", "documents", "most_repeats",
        F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
    )
