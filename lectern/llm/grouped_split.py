"""Problem 4: splits that keep related records together.

Families are the connected components over `original_essay_id`. Every family carries the vector of its labels, and
iterative stratification places families: of the outstanding labels the rarest comes first, the family goes to the split
that needs that label most. Families of a thousandth of all records or more are placed one by one for the whole corpus
(there are at most a thousand); the others are dealt by hash into shards of bounded size that aim at their part of what
is left, so no task sees more than its shard and the proportions hold within the rounding of the shards.

Ids compare without surrounding blanks and letter case; values not of the form of an id, null ids and references of a
record to itself connect nothing. Repeated rows of one id are one record. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import components, lookup
from lectern.session import cut

#: Form of an essay id.
ID_FORM = r"^(hum|gen|pol)-[0-9]{9}$"
SPLITS = {"train": 0.7, "val": 0.15, "test": 0.15}
SHARD = 20000


def canonical_id(c: Column) -> Column:
    """The id in the form in which ids compare, or null."""
    x = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(x.rlike(ID_FORM), x)


def families(essays: DataFrame) -> DataFrame:
    """One row for every essay_id: node, family_id, split, label, blank (whether every text of it is blank)."""
    rows = essays.where("essay_id IS NOT NULL").select(
        "essay_id",
        F.coalesce(canonical_id(F.col("essay_id")), F.col("essay_id")).alias("node"),
        canonical_id(F.col("original_essay_id")).alias("original"),
        F.coalesce(F.trim("split"), F.lit("")).alias("split"),
        F.coalesce(F.trim("label"), F.lit("")).alias("label"),
        (F.col("text").isNull() | F.col("text").rlike(r"(?U)^\s*$")).alias("blank"),
    )
    rows = cut(rows)
    edges = rows.where("original IS NOT NULL AND original <> node").select(F.col("node").alias("a"), F.col("original").alias("b"))
    comp = components(edges)
    one = rows.groupBy("essay_id", "node").agg(F.max("split").alias("split"), F.max("label").alias("label"), F.min("blank").alias("blank"))
    tied = one.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tied = cut(tied)
    names = tied.groupBy("component").agg(F.min("essay_id").alias("family_id"), F.count("*").alias("family_size"), F.count_distinct(F.when(F.col("split") != "", F.col("split"))).alias("family_splits"))
    return lookup(tied, names, "component").drop("component")


def broken_families(essays: DataFrame) -> DataFrame:
    """(essay_id, family_id) of every record of a family whose stored splits differ; records without text are left out."""
    return families(essays).where("family_size > 1 AND family_splits > 1 AND NOT blank").select("essay_id", "family_id").distinct()


def stratify(families: list[tuple], targets: dict[str, dict[str, float]]) -> dict:
    """Iterative stratification of (name, {label: n}) under targets {split: {label: n}}, in a fixed order."""
    need = {s: defaultdict(float, t) for s, t in targets.items()}
    room = {s: sum(t.values()) for s, t in targets.items()}
    left: dict[str, int] = defaultdict(int)
    by_label: dict[str, list[int]] = defaultdict(list)
    for i, (_, v) in enumerate(families):
        for k, n in v.items():
            left[k] += n
            by_label[k].append(i)
    for k in by_label:  # large families first, then by name
        by_label[k].sort(key=lambda i: (-families[i][1][k], families[i][0]))
    where: dict = {}
    done = bytearray(len(families))
    while left:
        label = min(left, key=lambda k: (left[k], k))
        for i in by_label[label]:
            if done[i]:
                continue
            done[i] = 1
            name, v = families[i]
            size = sum(v.values())
            # a split that is full takes no more, however rare the label
            split = max(need, key=lambda s: (2 * room[s] >= size, need[s][label], room[s], s == "train", s))
            where[name] = split
            for k, n in v.items():
                need[split][k] -= n
                room[split] -= n
                if k in left:
                    left[k] -= n
        del left[label]
    return where


def assign(essays: DataFrame, splits: dict[str, float] | None = None, shard: int = SHARD) -> DataFrame:
    """Every essay_id with family_id, its new split, the stored split and whether its family was torn."""
    splits = splits or SPLITS
    fam = cut(families(essays))
    vectors = fam.groupBy("family_id", "label").agg(F.count("*").alias("n")).groupBy("family_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("v"), F.sum("n").alias("size"))
    vectors = cut(vectors)
    total = fam.count()
    big = [(r["family_id"], dict(r["v"])) for r in vectors.where(F.col("size") > max(1, total // 1000)).orderBy(F.desc("size"), "family_id").collect()] if total else []  # fewer than 1000 rows
    # only labels of large families are no longer outstanding in the given proportions
    held = sorted({k for _, v in big for k in v})
    labels = {r["label"]: r["n"] for r in fam.where(F.col("label").isin(held)).groupBy("label").agg(F.count("*").alias("n")).collect()} if held else {}
    goal = {s: {k: share * n for k, n in labels.items()} for s, share in splits.items()}
    placed = stratify(big, goal)
    for name, v in big:
        for k, n in v.items():
            goal[placed[name]][k] -= n
    shards = max(1, round(total / shard))
    rest = total - sum(sum(v.values()) for _, v in big)
    need = {s: {k: max(0.0, x) for k, x in t.items()} for s, t in goal.items()}
    schema = T.StructType([T.StructField("family_id", T.StringType()), T.StructField("new_split", T.StringType())])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [(f, dict(v)) for f, v in zip(pdf["family_id"], pdf["v"])]
        own: dict[str, int] = defaultdict(int)
        for _, v in items:
            for k, n in v.items():
                own[k] += n
        # the shard's own labels, divided as the corpus still needs them
        targets = {s: {k: n * (need[s].get(k, 0.0) / (sum(need[x].get(k, 0.0) for x in need) or 1.0) if k in labels else splits[s]) for k, n in own.items()} for s in splits}
        where = stratify(items, targets)
        return pd.DataFrame({"family_id": [f for f, _ in items], "new_split": [where[f] for f, _ in items]})

    spark = essays.sparkSession
    small = vectors.where(F.col("size") <= max(1, total // 1000))
    dealt = small.withColumn("shard", F.pmod(F.xxhash64("family_id"), F.lit(shards))).repartition(2 * shards, "shard").groupBy("shard").applyInPandas(place, schema) if rest or not big else spark.createDataFrame([], schema)
    first = spark.createDataFrame([(k, s) for k, s in placed.items()], schema)
    out = lookup(fam, dealt.unionByName(first), "family_id")
    return out.select("essay_id", "family_id", F.col("new_split"), F.col("split").alias("stored_split"), "family_size", (F.col("family_splits") > 1).alias("torn"))
