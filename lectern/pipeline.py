"""The compositions: features of documents, their analysis, building a dataset version and its reference distributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.arrays import bind
from lectern.operators import baselines as bl
from lectern.operators import columnar as col
from lectern.operators import dataset as ds
from lectern.operators import scoring as sc
from lectern.operators.language_model import CountModel
from lectern.operators.passages import STATISTICS, mattr, member_statistics, mtld_of_each, passage_array, passage_values
from lectern.operators.sentences import Splitter, sentence_array, split_sentences
from lectern.operators.vectors import ALL, TEXTUAL, long_values, text_vector, with_vectors
from lectern.session import cut
from lectern.sources import ingest as ig

FEATURE_VERSION, MODEL_VERSION, WINDOW_TOKENS = "f0.3.0", "0.1.0", 1024
#: Features of the text of a sentence that exist without a parser.
FEATURES = tuple(n for n in TEXTUAL if n != "dep_depth_mean")


def sentence_matrix(docs: DataFrame, key: str = "doc_id", splitter: Splitter = split_sentences, model: CountModel | None = None, digits: int | None = None) -> DataFrame:
    """Sentences with their `vector`: features of their text, and those of the count model if one is given."""
    return with_vectors(splitter(docs, key, "text"), model, digits)


def _document(docs: DataFrame, key: str, keep: Sequence[str], model: CountModel | None, digits: int | None, window: int, stride: int, known: set[str] | None = None) -> DataFrame:
    """(key, columns to keep, s: sentences, v: their vectors, p: passages with their values), all within the row of a document.

    With `known`, only statistics of features that one of these names belongs to are made.
    """
    d = docs.select(key, *keep, sentence_array(F.col("text")).alias("s"))
    d = d.withColumn("p", passage_array(F.col("s"), window, stride))
    d = d.withColumn("lists", F.transform("p", lambda p: tx.tokens(p["text"])))
    d = d.withColumn("mtld", mtld_of_each("lists"))
    v = F.transform("s", lambda x: text_vector(x["sentence"], digits))
    if model is not None:
        d = d.withColumn("lm", model.document_signals(F.transform("s", lambda x: tx.tokens(x["sentence"]))))
        v = F.zip_with(v, "lm", lambda a, b: F.concat(a, b))
    d = d.withColumn("v", v)
    names = ALL if model is not None else TEXTUAL
    wanted = [(n, i) for i, n in enumerate(names) if known is None or any(f"{n}_{x}" in known for x in STATISTICS)]

    def passages(x: Column) -> Column:  # bound once: inside the inner function a column would be computed for every passage
        vectors = F.transform(x["v"], lambda v: F.array(*[v[i] for _, i in wanted])) if known is not None and wanted else x["v"]
        own = [n for n, _ in wanted]

        def with_vectors_(vs: Column) -> Column:
            return F.transform(x["p"], lambda p, i: F.struct(
                p["passage_idx"].alias("passage_idx"), p["sentence_indices"].alias("sentence_indices"), p["text"].alias("text"),
                passage_values(member_statistics(p["sentence_indices"], vs, own) if own else None, mattr(x["lists"][i]), x["mtld"][i]).alias("values"),
            ))

        return bind(vectors, with_vectors_)

    return d.select(key, *keep, "s", "v", bind(F.struct("p", "v", "lists", "mtld"), passages).alias("p"))


def passage_rows(docs: DataFrame, key: str = "doc_id", keep: Sequence[str] = (), model: CountModel | None = None, digits: int | None = None, window: int = 3, stride: int = 1, known: set[str] | None = None) -> DataFrame:
    """(key, columns to keep, passage_idx, sentence_indices, text, values) of the passages of every document; no shuffle."""
    p = _document(docs, key, keep, model, digits, window, stride, known)
    return p.select(key, *keep, F.inline_outer("p")).where("passage_idx IS NOT NULL")  # the inner form would make them twice, to look for empty arrays


# What is said of a text that cannot be analysed.
EMPTY, LONG, NO_WORDS, NO_SENTENCES, WINDOW = "text must not be empty", "text is too long", "text contains no words", "text contains no sentences", "text exceeds the token window of the instrument"


def guard(docs: DataFrame, most_chars: int = ds.REQUEST_CHARS, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Adds `error`: why a text cannot be analysed, or null. Tokens are those of the count model."""
    t = F.col("text")
    n = F.size(tx.tokens(t))
    none = F.size(F.regexp_extract_all(t, F.lit("([^\\s.!?])"), F.lit(1))) == 0
    return docs.withColumn("error", F.when(tx.is_blank(t), EMPTY).when(F.length(t) > most_chars, LONG).when(n == 0, NO_WORDS).when(none, NO_SENTENCES).when(n > window_tokens, WINDOW))


def error_envelope(status: Column, message: Column, details: Column | None = None) -> Column:
    """struct(status, code, message, details) of an answer that is an error; null where the status is 200."""
    code = F.when(status == 422, "VALIDATION_ERROR").when(status == 429, "RATE_LIMITED").when(status == 503, "MODEL_UNAVAILABLE").otherwise("INTERNAL_ERROR")
    shown = F.when((code == "INTERNAL_ERROR"), "An unexpected error occurred.").otherwise(message)
    return F.when(status != 200, F.struct(status.alias("status"), code.alias("code"), shown.alias("message"), (details if details is not None else F.lit(None).cast("string")).alias("details")))


def analyze(
    docs: DataFrame, baselines: DataFrame, model: CountModel | None = None, key: str = "doc_id", version: str = "v0.1.0", essays_behind: int = 0,
    most_chars: int = ds.REQUEST_CHARS, window_tokens: int = WINDOW_TOKENS, window: int = 3, stride: int = 1, digits: int | None = None,
) -> DataFrame:
    """One row for every document: error, counts, buckets, summary, sentences and passages with their evidence, limitations.

    Everything is computed within the row of a document; only the distributions, a few rows, are broadcast.
    """
    g = guard(docs.select(key, "text"), most_chars, window_tokens)
    text = F.when(F.col("error").isNull(), F.col("text"))
    g = g.withColumn("text", text).withColumn("word_count", F.size(tx.tokens(text)).cast("long")).withColumn("bucket", tx.length_bucket(F.col("word_count")))
    g = sc.resolve_buckets(g.withColumn("word_count", F.when(F.col("error").isNull(), F.col("word_count"))).withColumn("bucket", F.when(F.col("error").isNull(), F.col("bucket"))), baselines)
    g = g.withColumn("baseline_bucket", F.when(F.col("error").isNull(), F.col("baseline_bucket")))
    known = {r["feature"] for r in baselines.select("feature").distinct().collect()}  # names of features
    d = _document(g, key, ["error", "word_count", "bucket", "baseline_bucket"], model, digits, window, stride, known)
    none = F.create_map().cast("map<string,struct<mean:double,std:double>>")
    d = d.join(F.broadcast(sc.stats_by_bucket(baselines)), "baseline_bucket", "left").withColumn("stats", F.coalesce("stats", none))
    names = ALL if model is not None else TEXTUAL

    def unit(head: list[Column], values: Column, kind: str, index: Column) -> Column:
        def with_signals(x: Column) -> Column:
            u = sc.unit_columns(x, kind, index)
            return F.struct(*head, sc.signal_dicts(x).alias("signals"), *[u[k].alias(k) for k in ("signal_count", "scored_count", "evidence_strength", "summary")])

        return bind(sc.score_values(values, F.col("stats")), with_signals)

    sentences = F.zip_with("s", "v", lambda s, v: unit([s["sent_idx"].alias("index"), s["start"].alias("start"), s["end"].alias("end"), s["sentence"].alias("text")], sc.named_values(v, names), "sentence", s["sent_idx"]))
    passages = F.transform("p", lambda p: unit([p["sentence_indices"].alias("sentence_indices")], p["values"], "passage", p["passage_idx"]))
    d = d.select(key, "error", "word_count", "bucket", "baseline_bucket", *[F.when(F.col("error").isNull(), c).alias(n) for n, c in (("sentences", sentences), ("passages", passages))])
    n = lambda x: F.size(F.filter("sentences", lambda s: s["evidence_strength"] == x)).cast("long")
    counts = [n(x).alias(x) for x in ("high", "medium", "low", "uncertain")]
    summary = F.struct(F.size("sentences").cast("long").alias("sentence_count"), (n("high") + n("medium")).alias("signal_sentences"), *counts)
    d = d.withColumn("summary", F.when(F.col("error").isNull(), summary))
    lim = sc.limitations(F.lit(essays_behind), F.lit(version), F.col("bucket"), F.col("baseline_bucket"), F.col("summary.uncertain"), F.col("summary.sentence_count"))
    return d.withColumn("limitations", F.when(F.col("error").isNull(), lim)).withColumn("feature_version", F.lit(FEATURE_VERSION))


def analysis_counts(docs: DataFrame, model: CountModel, stats: list[tuple], most_chars: int = ds.REQUEST_CHARS, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """The counts of `analyze` for documents (doc_id, text) without their sentences and passages; a token is neither white space nor a stop, so a text with one has a sentence."""
    r = col.document_rows(docs, model, stats)
    error = F.when(F.col("blank"), EMPTY).when(F.col("chars") > most_chars, LONG).when(F.col("n_words") == 0, NO_WORDS).when(F.col("n_words") > window_tokens, WINDOW)
    r = r.withColumn("error", error)
    limits = F.lit(len(sc.LIMITATIONS)) + (F.col("bucket") != F.col("baseline_bucket")).cast("int") + (F.col("uncertain") > 0).cast("int")
    shown = {"word_count": F.col("n_words"), "baseline_bucket": F.col("baseline_bucket"), "sentence_count": F.col("units"), "high": F.col("high"), "medium": F.col("medium"), "flagged": F.col("flagged"), "passages": F.col("passages"), "limitations": limits}
    return r.select("doc_id", "error", *[F.when(F.col("error").isNull(), c).alias(k) for k, c in shown.items()])


def response(analysed: DataFrame, key: str = "doc_id", model_version: str = MODEL_VERSION, baselines_version: str = "1.0", dataset_version: str = "v0.1.0") -> DataFrame:
    """(key, status, document): the answer to each text as JSON, with an id and the time; errors in their envelope."""
    status = F.when(F.col("error").isNull(), 200).otherwise(422)
    body = F.struct(
        F.regexp_replace(F.expr("uuid()"), "-", "").alias("analysis_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "feature_version",
        F.lit(model_version).alias("model_version"), F.lit(baselines_version).alias("baselines_version"), F.lit(dataset_version).alias("dataset_version"),
        F.col("word_count").alias("essay_word_count"), F.col("word_count").alias("essay_token_count"), F.col("bucket").alias("length_bucket"), "baseline_bucket", "summary", "sentences", "passages", "limitations",
    )
    document = F.when(status == 200, F.to_json(body, {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(error_envelope(status, F.col("error")).alias("error"))))
    return analysed.select(key, status.alias("status"), document.alias("document"))


def build_dataset(records: DataFrame, folder: str, version: str, seed: int = 42, holdout_models: tuple[str, ...] = ()) -> DataFrame:
    """Normal form, validity, first-wins deduplication, splits; writes records and manifest and returns the records.

    `records` has the record layout and input_ord. Invalid records are left out and counted in the manifest. Texts are kept
    once; deduplication and splits work on ids and hashes.
    """
    judged = cut(ds.quarantine(ds.preprocess(records)))
    slim = judged.where("violation IS NULL").select("input_ord", "essay_id", "label", "source", "model", "length_words", "original_essay_id", tx.content_hash(F.col("text")).alias("h"))
    first = slim.groupBy("h").agg(F.min_by(F.struct(*[c for c in slim.columns if c not in ("h", "input_ord")]), "input_ord").alias("r"), F.min("input_ord").alias("input_ord")).select("input_ord", "r.*")
    first = cut(first)
    splits = ds.assign_splits(first, seed, holdout_models).select("essay_id", "new_split")
    kept = first.select("input_ord", "essay_id").join(splits, "essay_id").select("input_ord", "new_split")
    out = cut(judged.drop("split", "violation").join(kept, "input_ord").withColumnRenamed("new_split", "split"))
    ig.write_dataset(out, folder)
    n = judged.agg(F.count_if(F.col("violation").isNotNull()).alias("bad"), F.count_if(F.col("violation").isNull()).alias("valid")).first()
    n_in, n_out = records.count(), out.count()
    extra = {"seed": seed, "ratios": [0.7, 0.15, 0.15], "input": n_in, "invalid": n["bad"], "duplicates_removed": n["valid"] - n_out, "records": n_out}
    ig.write_manifest(folder, version, ds.manifest_counts(out), extra)
    return out


def build_version(spark: SparkSession, sources: Sequence[DataFrame], folder: str, version: str, seed: int = 42) -> DataFrame:
    """A dataset version of raw sources in their order."""
    return build_dataset(_ordered(ig.concatenate(sources)), folder, version, seed)


def _ordered(every: DataFrame) -> DataFrame:
    return every.select(*[(F.col(f.name) if f.name in every.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ig.RECORD], "input_ord")


#: Turns essays (essay_id, text, bucket) into rows (essay_id, sent_idx, bucket, vector) with names of the vector's features.
Extractor = Callable[[DataFrame], tuple[DataFrame, tuple[str, ...]]]


def text_extractor(essays: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The features of sentences and of a count model learnt from the essays."""
    return with_vectors(split_sentences(essays, "essay_id", keep=["bucket"]), CountModel.learn(essays)), ALL


def dataset_baselines(
    spark: SparkSession, folder: str, out: str, most: int = 500, seed: int = 42, min_n: int = bl.MIN_N, extractor: Extractor = text_extractor,
    window_tokens: int = WINDOW_TOKENS, progress: Callable[[str, int], None] | None = None,
) -> str:
    """Reference distributions of the human training essays of a built dataset; writes artifact and report, returns the artifact's path.

    `progress` is told the name of each stage and its number of rows.
    """
    told = progress or (lambda stage, n: None)
    every = ig.read_dataset(spark, folder)
    not_human, not_train, kept = ds.eligible(every)
    seen = every.agg(F.count("*").alias("records"), F.count_if(not_human).alias("not_human"), F.count_if(not_train).alias("not_train"), F.count_if(kept).alias("kept")).first()
    e = every.where((F.col("label") == "human") & (F.col("split") == "train"))
    sample = ds.stratified_sample(e, most, seed).select("essay_id")
    e = cut(e.join(sample, "essay_id", "left_semi").select("essay_id", "text", tx.length_bucket(F.col("length_words")).alias("bucket"), F.size(tx.tokens(F.col("text"))).alias("n_tokens")))
    told("sample", n := e.count())
    long_ids = [r["essay_id"] for r in e.where(F.col("n_tokens") > window_tokens).select("essay_id").orderBy("essay_id").collect()]  # of a sample of at most `most` essays
    used = e.where(F.col("n_tokens") <= window_tokens)
    vectors, names = extractor(used)
    vectors = cut(vectors)
    told("sentences", vectors.count())
    with_sentences = used.join(vectors.select("essay_id").distinct(), "essay_id", "left_semi")
    counts = cut(bl.bucket_counts(with_sentences, vectors))
    rows = counts.orderBy("ord").collect()  # four rows
    _, log = bl.merge_plan([(r["bucket"], r["n_sentences"]) for r in rows], min_n)
    stats = bl.compute(long_values(vectors, ["essay_id", "sent_idx", "bucket"], names), counts, min_n)
    path = ig.write_baselines(out, FEATURE_VERSION, stats, counts, log)
    essays_used = sum(r["n_essays"] for r in rows)
    ig.write_report(spark, out, {
        "dataset_version": ig.dataset_version(spark, folder), "feature_version": FEATURE_VERSION, "min_n": min_n, "records_seen": seen["records"],
        "train_human_total": seen["kept"], "train_human_used": essays_used, "baseline_max_essays": most, "baseline_sample_seed": seed, "baseline_sample_size": n,
        "excluded_non_human": seen["not_human"], "excluded_non_train": seen["not_train"], "excluded_long_documents": len(long_ids), "excluded_long_document_ids": long_ids,
        "essays_zero_sentences_skipped": n - len(long_ids) - essays_used, "sentences": sum(r["n_sentences"] for r in rows),
        "bucket_essay_counts": {r["bucket"]: r["n_essays"] for r in rows}, "bucket_sentence_counts": {r["bucket"]: r["n_sentences"] for r in rows}, "merge_log": log,
    })
    told("baselines", essays_used)
    return path
