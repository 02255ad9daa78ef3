"""Scans of raw sources and of built datasets into one record layout, and the sinks that write it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import STEPS, is_blank, ordinal_id, word_count
from lectern.operators.dataset import LABELS, SPLITS
from lectern.sources import files

GENERATION_CONFIG = T.StructType([T.StructField("temperature", T.DoubleType()), T.StructField("top_p", T.DoubleType()), T.StructField("top_k", T.IntegerType()), T.StructField("max_tokens", T.IntegerType()), T.StructField("seed", T.LongType())])
_MAP = T.MapType(T.StringType(), T.StringType())
#: Fields of a record in their order.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("essay_id", "text", "label", "split")]
    + [T.StructField("length_words", T.IntegerType()), T.StructField("topic", T.StringType()), T.StructField("preprocessing", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("source", "license", "collection_date")]
    + [T.StructField("writer_demographics", _MAP)]
    + [T.StructField(n, T.StringType()) for n in ("model", "model_revision", "prompt_template")]
    + [T.StructField("prompt_variables", _MAP), T.StructField("generation_config", GENERATION_CONFIG)]
    + [T.StructField(n, T.StringType()) for n in ("generation_date", "original_essay_id", "polish_prompt")]
)


def as_records(df: DataFrame) -> DataFrame:
    """The record layout: missing fields null, others dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD])


def _human(df: DataFrame) -> DataFrame:
    return df.where(~is_blank(F.col("text"))).withColumn("label", F.lit("human")).withColumn("split", F.lit("")).withColumn("length_words", word_count(F.col("text")).cast("int"))


def read_json_array(spark: SparkSession, path: str, prefix: str = "viorra", topic: str = "unspecified_topic", license_: str = "unknown", date: str = "1970-01-01") -> DataFrame:
    """A file that is one JSON array, parsed as a stream; the position numbers the records, blank essays included.

    Such a file cannot be split, so its rows come in one partition and their running number is their position.
    """
    rows = spark.read.schema("Essay string, Source string").option("multiLine", True).json(path).select(F.monotonically_increasing_id().alias("pos"), "Essay", "Source")
    df = rows.select(
        ordinal_id(f"{prefix}-", F.col("pos") + 1, 4).alias("essay_id"), F.col("Essay").alias("text"),
        F.coalesce(F.nullif(F.col("Source"), F.lit("")), F.lit("unknown")).alias("source"), F.lit(topic).alias("topic"), F.lit(license_).alias("license"), F.lit(date).alias("collection_date"), F.col("pos").cast("long").alias("input_ord"),
    )
    return _human(df)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos from 0, line) of a text file, whose splits are read apart: lines of earlier splits are counted, then added; no line is shuffled."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # one row for each split
    blocks = lines.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", (before - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(blocks), "block").select((F.col("at") + F.col("shift")).alias("pos"), "line")


def read_json_lines(spark: SparkSession, path: str, prefix: str = "leaf", source: str = "leaf", license_: str = "unknown", date: str = "1970-01-01") -> DataFrame:
    """One object per line; the line number names the record, so blank lines use up a number."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    r = lines.select("pos", F.from_json("line", "essay_title string, essay_text string, source_url string, split string").alias("r"))
    df = r.select(
        ordinal_id(f"{prefix}-", F.col("pos") + 1, 5).alias("essay_id"), F.col("r.essay_text").alias("text"), F.lit(source).alias("source"),
        F.coalesce(F.nullif(F.col("r.essay_title"), F.lit("")), F.lit("unspecified_topic")).alias("topic"), F.lit(license_).alias("license"), F.lit(date).alias("collection_date"),
        F.create_map(F.lit("source_url"), F.coalesce("r.source_url", F.lit("")), F.lit("source_split"), F.coalesce("r.split", F.lit(""))).alias("writer_demographics"), F.col("pos").cast("long").alias("input_ord"),
    )
    return _human(df)


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.txt$", 1).alias("stem"))
    return found.select(F.expr("try_cast(stem AS int)").alias("n"), "value").where("n IS NOT NULL")


def read_text_folders(spark: SparkSession, root: str, prefix: str = "ghostbuster", source: str = "ghostbuster", license_: str = "unknown", date: str = "1970-01-01") -> DataFrame:
    """essays/human/N.txt with the prompts of prompts/N.txt where there are any, numbered by N."""
    essays = _numbered(spark, files.join(root, "human"))
    prompts = files.join(root, "prompts")
    p = _numbered(spark, prompts).select("n", F.trim("value").alias("prompt")) if files.exists(spark, prompts) else spark.createDataFrame([], "n int, prompt string")
    df = essays.join(p, "n", "left").select(
        ordinal_id(f"{prefix}-", F.col("n"), 5).alias("essay_id"), F.col("value").alias("text"), F.lit(source).alias("source"),
        F.coalesce(F.nullif("prompt", F.lit("")), F.lit("unspecified_prompt")).alias("topic"), F.lit(license_).alias("license"), F.lit(date).alias("collection_date"), F.col("n").cast("long").alias("input_ord"),
    )
    return _human(df)


def concatenate(parts: Iterable[DataFrame]) -> DataFrame:
    """All sources in the order given; input_ord goes on counting by source, then by its own order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("input_ord", F.col("input_ord") + F.lit(i).cast("long") * (1 << 40))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A built dataset; only line feeds separate records, so other line separators may stand inside texts."""
    return spark.read.schema(RECORD).option("lineSep", "\n").json(files.join(folder, "records.jsonl"))


def read_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Records persisted so far, or none."""
    return spark.read.schema(RECORD).option("lineSep", "\n").json(path) if files.exists(spark, path) else spark.createDataFrame([], RECORD)


def dataset_version(spark: SparkSession, folder: str) -> str:
    """The version its manifest names, else the folder's name."""
    path = files.join(folder, "manifest.json")
    if not files.exists(spark, path):
        return folder.rstrip("/").rsplit("/", 1)[-1]
    row = spark.read.option("multiLine", True).json(path).select("version").first()
    return row["version"]


def newest(spark: SparkSession, pattern_folder: str, glob: str) -> str | None:
    """Path of the file changed last among those that match; only file metadata is read."""
    if not files.exists(spark, pattern_folder):
        return None
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(pattern_folder).select("path", "modificationTime")
    row = found.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).first()
    return row["path"] if row else None


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """The artifact as rows (bucket, feature, n, mean_value, std_value, p5..p95)."""
    inner = "struct<n: bigint, mean: double, std: double, p5: double, p25: double, p50: double, p75: double, p95: double>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"buckets map<string, map<string, {inner}>>").alias("d"))
    rows = doc.select(F.explode("d.buckets").alias("bucket", "f")).select("bucket", F.explode("f").alias("feature", "s"))
    return rows.select("bucket", "feature", "s.n", F.col("s.mean").alias("mean_value"), F.col("s.std").alias("std_value"), "s.p5", "s.p25", "s.p50", "s.p75", "s.p95")


def write_dataset(records: DataFrame, folder: str) -> None:
    """Records in the order of their ids, one JSON object a line with nulls kept; parts of a folder at scale."""
    out = as_records(records).orderBy("essay_id").select(F.to_json(F.struct(*RECORD.names), {"ignoreNullFields": "false"}).alias("value"))
    out.write.mode("overwrite").text(files.join(folder, "records.jsonl"))


def write_manifest(folder: str, version: str, counts: DataFrame, extra: dict) -> None:
    """Counts by split, label and step with what the caller adds, keys in order; names outside the domains are counted together."""
    known = [F.lit(x) for x in (*LABELS, *SPLITS, *STEPS, "", "none")]
    rows = counts.groupBy("kind", F.when(F.col("name").isin(known), F.col("name")).otherwise("other").alias("name")).agg(F.sum("n").alias("n")).collect()  # as many as there are names in the domains
    doc: dict = {"version": version, "counts_by_split": {}, "counts_by_label": {}, "steps": {}, **extra}
    for r in rows:
        doc[{"split": "counts_by_split", "label": "counts_by_label", "step": "steps"}[r["kind"]]][r["name"]] = r["n"]
    files.write_json(counts.sparkSession, files.join(folder, "manifest.json"), doc)


def write_baselines(folder: str, feature_version: str, stats: DataFrame, counts: DataFrame, log: list[str]) -> str:
    """The artifact of four buckets and a fixed list of features, keys in order."""
    buckets: dict = {}
    for r in stats.collect():  # at most four buckets times the features
        buckets.setdefault(r["bucket"], {})[r["feature"]] = {"n": r["n"], "mean": r["mean_value"], "std": r["std_value"], **{k: r[k] for k in ("p5", "p25", "p50", "p75", "p95")}}
    c = counts.collect()  # four rows
    path = files.join(folder, f"baselines_{feature_version}.json")
    files.write_json(stats.sparkSession, path, {"schema_version": "1.0", "feature_version": feature_version, "n_essays": {r["bucket"]: r["n_essays"] for r in c}, "n_sentences": {r["bucket"]: r["n_sentences"] for r in c}, "merge_log": log, "buckets": buckets})
    return path


def write_report(spark: SparkSession, folder: str, doc: dict) -> None:
    """The counters of a baseline run, keys in order."""
    files.write_json(spark, files.join(folder, "report.json"), doc)


def cache_split(essays: DataFrame, cache: DataFrame, feature_version: str) -> tuple[DataFrame, DataFrame]:
    """(essays whose vectors are cached, those still to be computed)."""
    have = cache.where(F.col("feature_version") == feature_version).select("essay_id").distinct()
    return essays.join(have, "essay_id", "left_semi"), essays.join(have, "essay_id", "left_anti")


def cache_append(vectors: DataFrame, folder: str, feature_version: str) -> None:
    vectors.withColumn("feature_version", F.lit(feature_version)).write.mode("append").partitionBy("feature_version").parquet(folder)
