"""Reference distributions by length bucket, the merge of thin buckets, and their artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import BUCKETS
from lectern.operators.passages import QUANTILES

# Fixed value: sentences a bucket needs to stand alone.
MIN_N = 30


def bucket_stats(values: DataFrame, approximate: bool = False) -> DataFrame:
    """(bucket, feature, n, mean_value, std_value, p5..p95) of long rows (bucket, feature, value).

    Exact linear quantiles keep a count of distinct values for each group in memory; `approximate` bounds that.
    """
    levels = F.array(*[F.lit(x) for x in QUANTILES])
    q = F.percentile_approx("value", levels, 10000) if approximate else F.percentile("value", levels)
    g = values.groupBy("bucket", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("std_value"), q.alias("__q"))
    return g.select("bucket", "feature", "n", "mean_value", "std_value", *[F.col("__q")[i].alias(f"p{round(x * 100)}") for i, x in enumerate(QUANTILES)])


def bucket_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, lo) for i, (name, lo) in enumerate(BUCKETS)], "ord int, bucket string, lo int")


def bucket_counts(essays: DataFrame, sentences: DataFrame) -> DataFrame:
    """(bucket, n_essays, n_sentences) of all buckets, 0 where one is empty."""
    e = essays.groupBy("bucket").agg(F.count("*").alias("n_essays"))
    s = sentences.groupBy("bucket").agg(F.count("*").alias("n_sentences"))
    return bucket_frame(essays.sparkSession).join(F.broadcast(e), "bucket", "left").join(F.broadcast(s), "bucket", "left").select("ord", "bucket", F.coalesce("n_essays", F.lit(0)).alias("n_essays"), F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"))  # four rows each


def merge_plan(counts: list[tuple[str, int]], min_n: int = MIN_N) -> tuple[dict[str, str], list[str]]:
    """Where every present bucket goes, and the log: a thin bucket pours into the next one, else into the last kept."""
    kept: list[tuple[list[str], int]] = []
    carry: tuple[list[str], int] = ([], 0)
    log: list[str] = []
    present = [(b, n) for b, n in counts if n > 0]
    for i, (b, n) in enumerate(present):
        names, total = [*carry[0], b], carry[1] + n
        carry = ([], 0)
        if total >= min_n:
            kept.append((names, total))
        elif i + 1 < len(present):
            log.append(f"{b}+{present[i + 1][0]} merged (N={total} < min_n={min_n})")
            carry = (names, total)
        elif kept:
            log.append(f"{b}+{kept[-1][0][-1]} merged (N={total} < min_n={min_n})")
            kept[-1] = ([*names, *kept[-1][0]], kept[-1][1] + total)
        else:
            log.append(f"{b} kept with N={total} < min_n={min_n} (no neighbors)")
            kept.append((names, total))
    return {x: names[-1] for names, _ in kept for x in names}, log


def merged(counts: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """(bucket, n_sentences, target, merged_n) of the buckets with sentences; the plan is made of four rows."""
    rows = [(r["bucket"], r["n_sentences"]) for r in counts.orderBy("ord").select("bucket", "n_sentences").limit(len(BUCKETS)).collect()]
    plan, _ = merge_plan(rows, min_n)
    sums: dict[str, int] = {}
    for b, n in rows:
        if b in plan:
            sums[plan[b]] = sums.get(plan[b], 0) + n
    spark = counts.sparkSession
    return spark.createDataFrame([(b, n, plan[b], sums[plan[b]]) for b, n in rows if b in plan], "bucket string, n_sentences long, target string, merged_n long")


def compute(values: DataFrame, counts: DataFrame, min_n: int = MIN_N, approximate: bool = False) -> DataFrame:
    """Statistics after the merge of thin buckets; an empty input is an error."""
    plan = merged(counts, min_n)
    if plan.isEmpty():
        raise ValueError("no essays to compute baselines from")
    moved = values.join(F.broadcast(plan.select("bucket", "target")), "bucket").drop("bucket").withColumnRenamed("target", "bucket")  # four rows
    return bucket_stats(moved, approximate)
