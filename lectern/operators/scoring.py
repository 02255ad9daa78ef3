"""Evidence: values against the reference distribution of their bucket, levels, rankings and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import bind
from lectern.functions.features import ORDER, finite
from lectern.functions.text import two_decimals

# Levels of |z|, and the order in which a missing bucket is replaced.
HIGH, MEDIUM = 2.0, 1.0
FALLBACK = ("long", "standard", "short")
# The limitations stated with every analysis.
LIMITATIONS = (
    "This analysis measures machine-like writing signals using statistical and language-model measurements; it is evidence, not a claim of authorship.",
    "The language model is an instrument for measurable token signals only; it never judges whether text was written by an AI.",
    "Human baselines come from the training split of dataset {version} ({n} human admissions essays); behavior on other populations is unknown and may differ.",
    "Features without a baseline distribution are not scored; evidence covers only features comparable to the human sample.",
    "Short, heavily edited, or second-language essays can produce unusual signals for reasons unrelated to AI writing.",
)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Null where the baseline does not vary."""
    return F.when(std > 0, (value - mean) / std)


def level(z: Column) -> Column:
    return F.when(z.isNull(), "uncertain").when(F.abs(z) >= HIGH, "high").when(F.abs(z) >= MEDIUM, "medium").otherwise("low")


def direction(z: Column) -> Column:
    return F.when(z.isNull(), "unknown").when(z < 0, "lower").otherwise("higher")


def resolve_buckets(essays: DataFrame, baselines: DataFrame) -> DataFrame:
    """Adds baseline_bucket: the own bucket if it has baselines, else the first of the fallback order that has, else the own."""
    have = baselines.agg(F.collect_set("bucket").alias("__have"))  # the names of at most four buckets
    steps = reduce(lambda acc, b: acc.when(F.array_contains("__have", b), b), FALLBACK, F.when(F.array_contains("__have", F.col("bucket")), F.col("bucket")))
    return essays.crossJoin(F.broadcast(have)).withColumn("baseline_bucket", F.coalesce(steps, F.col("bucket"))).drop("__have")


def score(values: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Signals (keys, feature, ordinal, value, baseline_mean, baseline_std, z_score, direction, evidence).

    `values` is long: keys, baseline_bucket, feature, ordinal, value. Features without a baseline are dropped. Baselines are
    one row for each of four buckets and each feature name, a bound that does not grow with the data.
    """
    stats = F.broadcast(baselines.select(F.col("bucket").alias("baseline_bucket"), "feature", F.col("mean_value").alias("baseline_mean"), F.col("std_value").alias("baseline_std")))
    s = values.where(finite(F.col("value"))).join(stats, ["baseline_bucket", "feature"])
    z = z_score(F.col("value"), F.col("baseline_mean"), F.col("baseline_std"))
    return s.withColumn("z_score", z).withColumn("direction", direction(F.col("z_score"))).withColumn("evidence", level(F.col("z_score"))).select(*keys, "feature", "ordinal", "value", "baseline_mean", "baseline_std", "z_score", "direction", "evidence")


def signal_summary(feature: Column, value: Column, mean: Column, std: Column, z: Column) -> Column:
    head = F.concat(feature, F.lit(": "), two_decimals(value), F.lit(" (human baseline: "), two_decimals(mean), F.lit(" ± "), two_decimals(std), F.lit(") — "))
    tail = (
        F.when(z.isNull(), "uncertain because baseline variance unavailable")
        .when(F.abs(z) < MEDIUM, "within the typical human baseline range")
        .when(z < 0, "unusually lower than the human baseline")
        .otherwise("unusually higher than the human baseline")
    )
    return F.concat(head, tail)


def stats_by_bucket(baselines: DataFrame) -> DataFrame:
    """(baseline_bucket, stats) with stats a map from feature to its mean and deviation: one row for each of four buckets."""
    entry = F.struct(F.col("feature"), F.struct(F.col("mean_value").alias("mean"), F.col("std_value").alias("std")))
    return baselines.groupBy(F.col("bucket").alias("baseline_bucket")).agg(F.map_from_entries(F.collect_list(entry)).alias("stats"))


def score_values(values: Column, stats: Column) -> Column:
    """Signals of an array of struct(feature, ordinal, value) against a map of distributions, ranked by |z| to nine decimals (ties in the order of extraction).

    Features without a distribution and values that are not finite drop out.
    """

    def scored(x: Column) -> Column:
        return bind(z_score(x["value"], x["st"]["mean"], x["st"]["std"]), lambda z: F.struct(
            (-F.round(F.abs(F.coalesce(z, F.lit(0.0))), 9)).alias("rank"), x["ordinal"].alias("ordinal"), x["feature"].alias("feature"), x["value"].alias("value"),
            x["st"]["mean"].alias("baseline_mean"), x["st"]["std"].alias("baseline_std"), z.alias("z_score"), direction(z).alias("direction"), level(z).alias("evidence"),
        ))

    known = F.transform(values, lambda x: F.struct(x["feature"].alias("feature"), x["ordinal"].alias("ordinal"), x["value"].alias("value"), F.element_at(stats, x["feature"]).alias("st")))
    return F.array_sort(F.transform(F.filter(known, lambda x: finite(x["value"]) & x["st"].isNotNull()), scored))


def named_values(vector: Column, names: tuple[str, ...] = ORDER) -> Column:
    """array<struct<feature, ordinal, value>> of a vector in the order of `names`."""
    n = F.array(*[F.lit(x) for x in names])
    return F.transform(vector, lambda v, i: F.struct(n[i].alias("feature"), (i + 1).alias("ordinal"), v.alias("value")))


def score_rows(rows: DataFrame, baselines: DataFrame, values: Column) -> DataFrame:
    """Adds `signals` to rows with baseline_bucket, in place: the distributions are four rows and are broadcast."""
    j = rows.join(F.broadcast(stats_by_bucket(baselines)), "baseline_bucket", "left")
    none = F.create_map().cast("map<string,struct<mean:double,std:double>>")
    return j.withColumn("stats", F.coalesce("stats", none)).withColumn("signals", score_values(values, F.col("stats"))).drop("stats")


def unit_columns(signals: Column, kind: str, index: Column) -> dict[str, Column]:
    """signal_count (flagged), scored_count, evidence_strength, summary and top_feature of a unit with its ranked signals."""
    n = F.size(signals)
    of = lambda x: F.size(F.filter(signals, lambda s: s["evidence"] == x))
    high, medium = of("high"), of("medium")
    return counted_columns(n, high, medium, F.get(signals, F.lit(0)), kind, index)


def counted_columns(n: Column, high: Column, medium: Column, top: Column, kind: str, index: Column) -> dict[str, Column]:
    """The same of a unit with the numbers of its signals, the high and the medium ones, and the first of them."""
    flagged = high + medium
    at = F.concat(F.lit(f"{kind} "), index.cast("string"), F.lit(": "))
    text = (
        F.when(n == 0, F.concat(at, F.lit("no features could be compared (baseline distribution unavailable)")))
        .when(flagged == 0, F.concat(at, F.lit("all "), n.cast("string"), F.lit(" scored features fall within the typical human baseline range")))
        .otherwise(F.concat(at, flagged.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" scored features show machine-like signals (top: "), top["feature"], F.lit(" "), top["direction"], F.lit(" than the human baseline)")))
    )
    return {"signal_count": flagged.cast("long"), "scored_count": n.cast("long"), "evidence_strength": unit_level(n, high, medium), "summary": text, "top_feature": F.when(n > 0, top["feature"])}


def signal_dicts(signals: Column) -> Column:
    """The signals as they are delivered: without ranks, each with its summary."""
    return F.transform(signals, lambda s: F.struct(
        s["feature"].alias("feature"), s["value"].alias("value"), s["baseline_mean"].alias("baseline_mean"), s["baseline_std"].alias("baseline_std"), s["z_score"].alias("z_score"),
        s["direction"].alias("direction"), s["evidence"].alias("evidence"), signal_summary(s["feature"], s["value"], s["baseline_mean"], s["baseline_std"], s["z_score"]).alias("summary"),
    ))


def unit_level(n: Column, high: Column, medium: Column) -> Column:
    """The most severe signal decides; a unit with only uncertain signals is low, one without signals uncertain."""
    return F.when(n == 0, "uncertain").when(high > 0, "high").when(medium > 0, "medium").otherwise("low")


def display_signals(units_: DataFrame, keys: list[str], flagged: int = 5, typical: int = 3) -> DataFrame:
    """The signals a unit shows first: up to five that are not low, else up to three."""
    loud = F.filter("signals", lambda s: s["evidence"] != "low")
    shown = F.when(F.size(loud) > 0, F.slice(loud, 1, flagged)).otherwise(F.slice("signals", 1, typical))
    return units_.where("scored_count > 0").select(*keys, F.posexplode(shown).alias("position", "s")).select(*keys, F.col("position"), "s.feature", "s.evidence", "s.z_score")


def level_counts(units_: DataFrame, key: str) -> DataFrame:
    n = lambda x: F.count_if(F.col("evidence_strength") == x)
    return units_.groupBy(key).agg(F.count("*").alias("units"), n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), n("uncertain").alias("uncertain"), F.count_if(F.col("evidence_strength").isin("high", "medium")).alias("signal_units"))


def limitations(n_essays: Column, version: Column, own: Column, used: Column, uncertain: Column, total: Column) -> Column:
    fixed = [F.replace(F.replace(F.lit(x), F.lit("{n}"), n_essays.cast("string")), F.lit("{version}"), version) for x in LIMITATIONS]
    moved = F.when(own != used, F.concat(F.lit("Essays in the '"), own, F.lit("' length range have no baseline bucket; signals were compared to the '"), used, F.lit("' distribution instead.")))
    open_ = F.when(uncertain > 0, F.concat(uncertain.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" sentences could not be compared to any baseline and are reported as uncertain.")))
    return F.array_compact(F.array(*fixed, moved, open_))


def ordinal_of(feature: str) -> int:
    return ORDER.index(feature) + 1
