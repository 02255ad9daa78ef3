"""Building a dataset version: validity, exact deduplication, leakage-aware splits, sampling, manifest."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import STEPS, applied_steps, clean, content_hash, is_blank, length_bucket, nfc, word_count

# Domains of labels, splits and generation settings.
LABELS = ("human", "ai_generated", "ai_polished")
SPLITS = ("train", "val", "test", "test_cross_model", "test_secondary")
GENERATION_WORDS = (50, 700)
MAX_TOKENS = 2048
REQUEST_CHARS = 10000
REQUIRED = {
    "human": ("source", "license", "collection_date"),
    "ai_generated": ("model", "model_revision", "prompt_template", "prompt_variables", "generation_config", "generation_date"),
    "ai_polished": ("original_essay_id", "polish_prompt", "model", "generation_config", "generation_date"),
}


def bad_config(c: str = "generation_config") -> Column:
    """Whether sampling settings lie outside their ranges; null settings are not."""
    g = lambda f: F.col(f"{c}.{f}")
    ok = (g("temperature") > 0) & (g("temperature") <= 2) & (g("top_p") > 0) & (g("top_p") <= 1) & (g("top_k") >= 1) & (g("max_tokens") >= 1) & (g("max_tokens") <= MAX_TOKENS)
    return F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False))


def bad_encoding(c: Column) -> Column:
    """NUL characters; lone surrogates cannot occur in strings that came from UTF-8."""
    return F.coalesce(F.contains(c, F.lit("\0")), F.lit(False))


def violation() -> Column:
    """The first rule that a record breaks, or null."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    out = (
        F.when(blank("essay_id"), "essay_id")
        .when(is_blank(F.col("text")), "text")
        .when(bad_encoding(F.col("text")), "encoding")
        .when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label")
        .when(~F.coalesce(F.col("split").isin(*SPLITS, ""), F.lit(False)), "split")
        .when(~F.coalesce(F.col("length_words") >= 0, F.lit(False)), "length_words")
        .when(F.size(F.array_except(F.coalesce("preprocessing", F.array().cast("array<string>")), F.array(*[F.lit(s) for s in STEPS]))) > 0, "preprocessing")
    )
    for label, fields in REQUIRED.items():
        for f in fields:
            missing = F.col(f).isNull() if f in ("prompt_variables", "generation_config") else blank(f)
            out = out.when((F.col("label") == label) & missing, f)
    return out.when(bad_config(), "generation_config_range")


def quarantine(essays: DataFrame) -> DataFrame:
    return essays.withColumn("violation", violation())


def preprocess(essays: DataFrame) -> DataFrame:
    """Texts in normal form with the steps that changed them and their length; blank results drop out."""
    e = essays.withColumn("__c", nfc(F.col("text")))
    e = e.withColumn("preprocessing", applied_steps(F.col("text"), F.col("__c"))).withColumn("text", clean(F.col("__c"))).drop("__c")
    return e.where(~is_blank(F.col("text"))).withColumn("length_words", word_count(F.col("text")))


def first_wins(records: DataFrame, order: str = "input_ord", text: str = "text") -> DataFrame:
    """Keeps the first record of every text. Only hashes and ordinals are aggregated, so a text that a third of all rows share costs no more."""
    hashed = records.withColumn("content_hash", content_hash(F.col(text)))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("__first"))
    return hashed.join(first, (hashed[order] == first["__first"]) & hashed["content_hash"].eqNullSafe(first["content_hash"]), "left_semi").drop("content_hash")


def not_in(records: DataFrame, existing: DataFrame, text: str = "text") -> DataFrame:
    """Records whose text is not among existing hashes (a column content_hash)."""
    return records.withColumn("content_hash", content_hash(F.col(text))).join(existing.select("content_hash").distinct(), "content_hash", "left_anti").drop("content_hash")


def strata(e: DataFrame) -> DataFrame:
    return e.withColumn("origin", F.coalesce("source", "model", F.lit("unknown"))).withColumn("bucket", length_bucket(F.col("length_words")))


#: Rows of a stratum that one range of hashes holds about.
RANGE_ROWS = 4000


def ranked(e: DataFrame, keys: list[str], seed: int, id_col: str = "essay_id") -> DataFrame:
    """Adds __r, the rank from 1 by a seeded hash of the id within `keys`, and __n, how many rows there are.

    A stratum may hold a third of all rows, so it is cut into ranges of the hash: counts of the ranges are summed up, and rows
    are sorted within their range only.
    """
    e = e.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col)), 256))
    named = [F.col(k).alias(f"__s_{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]
    drop = [f"__s_{k}" for k in keys]
    sizes = e.groupBy(*named).agg(F.count("*").alias("__n"))
    e = e.join(F.broadcast(sizes), reduce(and_, same)).drop(*drop)  # one row for each stratum, of which there are few
    e = e.withColumn("__b", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.ceil(F.col("__n") / RANGE_ROWS)).cast("int"))
    counts = e.groupBy(*keys, "__b").agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*named, F.col("__b").alias("__ob"), before.alias("__o"))
    e = e.join(offsets, reduce(and_, [*same, F.col("__b") == F.col("__ob")])).drop(*drop)
    rank = F.col("__o") + F.row_number().over(W.partitionBy(*keys, "__b").orderBy("__h", id_col))
    return e.withColumn("__r", rank).drop("__h", "__b", "__ob", "__o")


def assign_splits(essays: DataFrame, seed: int = 42, holdout_models: tuple[str, ...] = (), train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(essay_id, origin, bucket, new_split): polished and their originals to test_secondary, held-out models to
    test_cross_model, the others 70 / 15 / 15 within each stratum by a seeded hash of the id.
    """
    e = strata(essays.select("essay_id", "label", "source", "model", "length_words", "original_essay_id"))
    leaked = e.where((F.col("label") == "ai_polished") & F.col("original_essay_id").isNotNull()).select(F.col("original_essay_id").alias("essay_id")).distinct().withColumn("__leak", F.lit(True))
    e = e.join(leaked, "essay_id", "left")
    fixed = (
        F.when(F.col("label") == "ai_polished", "test_secondary")
        .when(F.col("__leak"), "test_secondary")
        .when((F.col("label") != "human") & F.coalesce(F.col("model").isin(*holdout_models), F.lit(False)), "test_cross_model")
    )
    e = e.withColumn("fixed", fixed).withColumn("pool", F.col("fixed").isNull())
    e = ranked(e, ["origin", "bucket", "pool"], seed)
    n_train, n_val = F.bround(F.col("__n") * train), F.bround(F.col("__n") * val)
    drawn = F.when(F.col("__r") <= n_train, "train").when(F.col("__r") <= n_train + n_val, "val").otherwise("test")
    return e.select("essay_id", "origin", "bucket", F.coalesce("fixed", drawn).alias("new_split"))


def sample_quotas(counts: DataFrame, most: int) -> DataFrame:
    """(origin, bucket, n, quota): proportional with one at least, then corrected one by one in the order of the strata.

    There is one row for each stratum (a source and a length bucket); the windows run over these.
    """
    total = counts.agg(F.sum("n").alias("total"))
    q = counts.crossJoin(F.broadcast(total)).withColumn("q", F.greatest(F.lit(1), F.bround(F.col("n") * float(most) / F.col("total")).cast("long")))
    w = W.orderBy("origin", "bucket")
    q = q.withColumn("d", F.sum("q").over(W.partitionBy(F.lit(1))) - most).withColumn("rank", F.row_number().over(w))
    q = q.withColumn("can_gain", F.sum((F.col("n") > F.col("q")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    gain = (F.col("d") < 0) & (F.col("n") > F.col("q")) & (F.col("can_gain") <= -F.col("d"))
    quota = F.when(F.col("total") <= most, F.col("n")).when((F.col("d") > 0) & (F.col("rank") <= F.col("d")), F.col("q") - 1).when(gain, F.col("q") + 1).otherwise(F.col("q"))
    return q.select("origin", "bucket", "n", quota.alias("quota"))


def stratified_sample(essays: DataFrame, most: int = 500, seed: int = 42) -> DataFrame:
    """A sample of `most` essays, proportional over (origin, bucket); all of them if there are no more."""
    e = strata(essays.select("essay_id", "source", "model", "length_words"))
    quotas = sample_quotas(e.groupBy("origin", "bucket").agg(F.count("*").alias("n")), most)
    e = ranked(e, ["origin", "bucket"], seed)
    q = F.broadcast(quotas.select(F.col("origin").alias("qo"), F.col("bucket").alias("qb"), "quota"))  # one row for each stratum
    return e.join(q, e["origin"].eqNullSafe(F.col("qo")) & e["bucket"].eqNullSafe(F.col("qb"))).where(F.col("__r") <= F.col("quota")).select("essay_id", "origin", "bucket")


def manifest_counts(essays: DataFrame) -> DataFrame:
    """(kind, name, n): records by split and by label, and by preprocessing step."""
    by = lambda c: essays.groupBy(F.coalesce(F.col(c), F.lit("none")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "name", "n")
    steps = essays.select(F.explode(F.array_distinct("preprocessing")).alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("step").alias("kind"), "name", "n")
    return by("split").unionByName(by("label")).unionByName(steps)


def eligible(essays: DataFrame) -> tuple[Column, Column, Column]:
    """Counters of the baseline run in their order: not human, human but not in training, kept."""
    human = F.col("label").eqNullSafe("human")
    train = F.col("split").eqNullSafe("train")
    return ~human, human & ~train, human & train
