"""Queries over building datasets, sampling, generation records, the admission log and caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import generation as gen
from lectern import pipeline as pl
from lectern.functions import text as tx
from lectern.operators import dataset as ds
from lectern.plans import sql
from lectern.session import read_table, shared_folder
from lectern.sources import files
from lectern.sources import ingest as ig
from lectern.streaming import limiter

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def essays(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "essays")


# --- normal form and validity -----------------------------------------------------------------------------------------

_CLEAN = sql.strip("regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n|\\r', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


@query("clean_text", f"SELECT input_ord, essay_id, {_CLEAN} AS text FROM essays WHERE text IS NOT NULL")
def clean_text(spark, d):
    return essays(spark, d).where("text IS NOT NULL").select("input_ord", "essay_id", tx.clean(tx.nfc(F.col("text"))).alias("text"))


_NL = "regexp_replace(regexp_replace(c, '\\r\\n|\\r', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_HS = f"regexp_replace({_NL}, '[ \\t]+', ' ', 'g')"


@query(
    "preprocessing_truth",
    f"""WITH x AS (SELECT input_ord, text, nfc_normalize(text) AS c, preprocessing FROM essays WHERE text IS NOT NULL),
    s AS (SELECT input_ord, preprocessing, list_filter([CASE WHEN c <> text THEN 'nfc_normalize' END, CASE WHEN {_NL} <> c THEN 'newline_normalize' END, CASE WHEN {_HS} <> {_NL} THEN 'collapse_hspace' END, CASE WHEN {sql.strip(_HS)} <> {_HS} THEN 'strip' END], lambda x: x IS NOT NULL) AS needed FROM x)
    SELECT input_ord, len(needed)::INT AS steps_needed, len(list_filter(needed, lambda x: list_contains(coalesce(preprocessing, []), x)))::INT AS claimed_but_needed FROM s""",
)
def preprocessing_truth(spark, d):
    """Steps that would still change a stored text, and how many of them the record claims were done."""
    e = essays(spark, d).where("text IS NOT NULL").withColumn("c", tx.nfc(F.col("text")))
    needed = tx.applied_steps(F.col("text"), F.col("c"))
    claimed = F.size(F.array_intersect(needed, F.coalesce("preprocessing", F.array().cast("array<string>"))))
    return e.select("input_ord", F.size(needed).alias("steps_needed"), claimed.alias("claimed_but_needed"))


def _violation_sql() -> str:
    blank = lambda c: f"({c} IS NULL OR trim({c}) = '')"
    inlist = lambda xs: ", ".join(f"'{x}'" for x in xs)
    out = [
        (blank("essay_id"), "essay_id"),
        (f"(text IS NULL OR {sql.strip('text')} = '')", "text"),
        ("coalesce(contains(text, chr(0)), false)", "encoding"),
        (f"NOT coalesce(label IN ({inlist(ds.LABELS)}), false)", "label"),
        (f"NOT coalesce(split IN ({inlist((*ds.SPLITS, ''))}), false)", "split"),
        ("NOT coalesce(length_words >= 0, false)", "length_words"),
        (f"len(list_filter(coalesce(preprocessing, []), lambda x: x NOT IN ({inlist(tx.STEPS)}))) > 0", "preprocessing"),
    ]
    for label, fields in ds.REQUIRED.items():
        out += [(f"label = '{label}' AND " + (f"{f} IS NULL" if f in ("prompt_variables", "generation_config") else blank(f)), f) for f in fields]
    g = "generation_config"
    ok = f"{g}.temperature > 0 AND {g}.temperature <= 2 AND {g}.top_p > 0 AND {g}.top_p <= 1 AND {g}.top_k >= 1 AND {g}.max_tokens >= 1 AND {g}.max_tokens <= {ds.MAX_TOKENS}"
    out.append((f"{g} IS NOT NULL AND NOT coalesce({ok}, false)", "generation_config_range"))
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in out) + " END"


@query("validity_quarantine", f"SELECT input_ord, {_violation_sql()} AS violation FROM essays")
def validity_quarantine(spark, d):
    return ds.quarantine(essays(spark, d)).select("input_ord", "violation")


@query("validity_counts", f"SELECT coalesce({_violation_sql()}, 'valid') AS violation, count(*) AS n FROM essays GROUP BY 1")
def validity_counts(spark, d):
    return ds.quarantine(essays(spark, d)).groupBy(F.coalesce("violation", F.lit("valid")).alias("violation")).agg(F.count("*").alias("n"))


@query("wrong_length_words", f"SELECT input_ord, length_words, {sql.words('text')}::BIGINT AS counted FROM essays WHERE text IS NOT NULL AND length_words <> {sql.words('text')}")
def wrong_length_words(spark, d):
    e = essays(spark, d).where("text IS NOT NULL").withColumn("counted", tx.word_count(F.col("text")))
    return e.where("length_words <> counted").select("input_ord", "length_words", "counted")


@query("request_guard", f"SELECT doc_id, CASE WHEN text IS NULL OR {sql.strip('text')} = '' THEN 'empty' WHEN length(text) > {ds.REQUEST_CHARS} THEN 'too_long' WHEN len({sql.tokens('text')}) = 0 THEN 'no_words' ELSE 'ok' END AS verdict, length(left(text, {ds.REQUEST_CHARS})) AS shown_chars FROM documents")
def request_guard(spark, d):
    t = F.col("text")
    verdict = F.when(tx.is_blank(t), "empty").when(F.length(t) > ds.REQUEST_CHARS, "too_long").when(F.size(tx.tokens(t)) == 0, "no_words").otherwise("ok")
    return read_table(spark, d, "documents").select("doc_id", verdict.alias("verdict"), F.length(F.left(t, F.lit(ds.REQUEST_CHARS))).alias("shown_chars"))


# --- deduplication -----------------------------------------------------------------------------------------------------


@query("exact_dedup_first_wins", "SELECT input_ord, essay_id FROM (SELECT input_ord, essay_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY input_ord) AS r FROM essays WHERE text IS NOT NULL) WHERE r = 1")
def exact_dedup_first_wins(spark, d):
    return ds.first_wins(essays(spark, d).where("text IS NOT NULL").select("input_ord", "essay_id", "text")).select("input_ord", "essay_id")


@query("dedup_against_existing", "SELECT input_ord FROM essays WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)")
def dedup_against_existing(spark, d):
    have = read_table(spark, d, "documents").where("text IS NOT NULL").select(tx.content_hash(F.col("text")).alias("content_hash"))
    return ds.not_in(essays(spark, d).where("text IS NOT NULL").select("input_ord", "text"), have).select("input_ord")


@query("repeated_deliveries", "SELECT essay_id, count(*) AS deliveries, min(input_ord) AS first_ord, max(ingested_at) AS last_ingested FROM essays GROUP BY essay_id HAVING count(*) > 1")
def repeated_deliveries(spark, d):
    return essays(spark, d).groupBy("essay_id").agg(F.count("*").alias("deliveries"), F.min("input_ord").alias("first_ord"), F.max("ingested_at").alias("last_ingested")).where("deliveries > 1")


# --- splits and samples -------------------------------------------------------------------------------------------------

_ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY essay_id ORDER BY input_ord) AS rn FROM essays) WHERE rn = 1)"
_STRATA = f"{_ONE}, st AS (SELECT essay_id, label, model, original_essay_id, coalesce(source, model, 'unknown') AS origin, {sql.bucket('length_words')} AS bucket FROM one)"
_HOLDOUT = ("heldout-nova",)
_SPLIT = f"""WITH {_STRATA},
    lk AS (SELECT DISTINCT original_essay_id AS essay_id FROM st WHERE label = 'ai_polished' AND original_essay_id IS NOT NULL),
    fx AS (SELECT *, CASE WHEN label = 'ai_polished' THEN 'test_secondary' WHEN essay_id IN (SELECT essay_id FROM lk) THEN 'test_secondary' WHEN label <> 'human' AND coalesce(model IN ('heldout-nova'), false) THEN 'test_cross_model' END AS fixed FROM st),
    rk AS (SELECT *, row_number() OVER (PARTITION BY origin, bucket, fixed IS NULL ORDER BY sha256('42:' || essay_id), essay_id) AS r, count(*) OVER (PARTITION BY origin, bucket, fixed IS NULL) AS n FROM fx),
    sp AS (SELECT essay_id, origin, bucket, coalesce(fixed, CASE WHEN r <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END) AS new_split FROM rk)"""


def first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    e = essays(spark, d)
    names = [c for c in e.columns if c not in ("essay_id", "input_ord", "text")]
    return e.groupBy("essay_id").agg(F.min_by(F.struct(*names), "input_ord").alias("s")).select("essay_id", "s.*")


@query("split_assignment", f"{_SPLIT} SELECT essay_id, origin, bucket, new_split FROM sp")
def split_assignment(spark, d):
    return ds.assign_splits(first_deliveries(spark, d), holdout_models=_HOLDOUT)


@query("split_counts", f"{_SPLIT} SELECT new_split, count(*) AS n FROM sp GROUP BY new_split")
def split_counts(spark, d):
    return split_assignment(spark, d).groupBy("new_split").agg(F.count("*").alias("n"))


@query("label_counts", "SELECT label, split, count(*) AS n FROM essays GROUP BY ALL")
def label_counts(spark, d):
    return essays(spark, d).groupBy("label", "split").agg(F.count("*").alias("n"))


@query("leak_group_semi", "SELECT DISTINCT essay_id FROM essays WHERE essay_id IN (SELECT original_essay_id FROM essays WHERE label = 'ai_polished' AND original_essay_id IS NOT NULL)")
def leak_group_semi(spark, d):
    e = essays(spark, d)
    polished = e.where("label = 'ai_polished' AND original_essay_id IS NOT NULL").select(F.col("original_essay_id").alias("essay_id"))
    return e.select("essay_id").join(polished, "essay_id", "left_semi").distinct()


@query("holdout_anti_pool", f"{_SPLIT}, ho AS (SELECT essay_id FROM fx WHERE fixed IS NOT NULL) SELECT essay_id FROM st WHERE essay_id NOT IN (SELECT essay_id FROM ho)")
def holdout_anti_pool(spark, d):
    e = first_deliveries(spark, d)
    held = split_assignment(spark, d).where("new_split IN ('test_secondary', 'test_cross_model')").select("essay_id")
    return e.select("essay_id").join(held, "essay_id", "left_anti")


@query(
    "stratified_sample",
    f"""WITH {_STRATA}, ct AS (SELECT origin, bucket, count(*) AS n FROM st GROUP BY ALL), tt AS (SELECT sum(n) AS total FROM ct),
    q0 AS (SELECT *, greatest(1, round_even(n * 200.0::DOUBLE / total, 0)::BIGINT) AS q FROM ct, tt),
    q1 AS (SELECT *, sum(q) OVER () - 200 AS d, row_number() OVER (ORDER BY origin, bucket) AS rank, sum(CASE WHEN n > q THEN 1 ELSE 0 END) OVER (ORDER BY origin, bucket ROWS UNBOUNDED PRECEDING) AS g FROM q0),
    q2 AS (SELECT origin, bucket, CASE WHEN total <= 200 THEN n WHEN d > 0 AND rank <= d THEN q - 1 WHEN d < 0 AND n > q AND g <= -d THEN q + 1 ELSE q END AS quota FROM q1),
    rk AS (SELECT essay_id, origin, bucket, row_number() OVER (PARTITION BY origin, bucket ORDER BY sha256('42:' || essay_id), essay_id) AS r FROM st)
    SELECT essay_id, rk.origin, rk.bucket FROM rk JOIN q2 ON rk.origin = q2.origin AND rk.bucket IS NOT DISTINCT FROM q2.bucket WHERE r <= quota""",
)
def stratified_sample(spark, d):
    return ds.stratified_sample(first_deliveries(spark, d), 200)


@query(
    "manifest_summary",
    """SELECT 'split' AS kind, coalesce(split, 'none') AS name, count(*) AS n FROM essays GROUP BY ALL UNION ALL SELECT 'label', coalesce(label, 'none'), count(*) FROM essays GROUP BY ALL
    UNION ALL SELECT 'step', s, count(*) FROM (SELECT unnest(list_distinct(preprocessing)) AS s FROM essays) GROUP BY s""",
)
def manifest_summary(spark, d):
    return ds.manifest_counts(essays(spark, d))


@query(
    "report_counters",
    """SELECT count(*) FILTER (WHERE label IS DISTINCT FROM 'human') AS not_human, count(*) FILTER (WHERE label = 'human' AND split IS DISTINCT FROM 'train') AS not_train,
    count(*) FILTER (WHERE label = 'human' AND split = 'train') AS kept, count(*) FILTER (WHERE label = 'human' AND split = 'train' AND length_words > 1024) AS too_long FROM essays""",
)
def report_counters(spark, d):
    not_human, not_train, kept = ds.eligible(essays(spark, d))
    return essays(spark, d).agg(F.count_if(not_human).alias("not_human"), F.count_if(not_train).alias("not_train"), F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("length_words") > 1024)).alias("too_long"))


# --- scans and sinks over files that are written from the tables ---------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return files.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _json_lines(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "lines")
    x = read_table(spark, d, "documents").orderBy("doc_id")
    x.select(F.to_json(F.struct(F.col("topic").alias("essay_title"), F.col("text").alias("essay_text"), F.col("source").alias("source_url"), F.col("lang").alias("split")))).coalesce(1).write.text(path)
    return path


_LEAF = "n1 AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM documents)"


@query("scan_json_lines", f"""WITH {_LEAF} SELECT 'leaf-' || printf('%05d', i) AS essay_id, text, coalesce(nullif(topic, ''), 'unspecified_topic') AS topic, {sql.words('text')}::INT AS length_words, coalesce(source, '') AS source_url, i - 1 AS input_ord FROM n1 WHERE text IS NOT NULL AND {sql.strip('text')} <> ''""")
def scan_json_lines(spark, d):
    r = ig.read_json_lines(spark, _json_lines(spark, d))
    return r.select("essay_id", "text", "topic", "length_words", F.col("writer_demographics")["source_url"].alias("source_url"), "input_ord")


def _json_array(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "array")
    x = read_table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("text").alias("Essay"), F.col("source").alias("Source"))).alias("j"))
    ends = x.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    rows = x.crossJoin(F.broadcast(ends)).orderBy("doc_id")  # one row
    rows.select(F.concat(F.when(F.col("doc_id") == F.col("a"), "[").otherwise(","), "j", F.when(F.col("doc_id") == F.col("z"), "]").otherwise(""))).coalesce(1).write.text(path)
    return path


@query("scan_json_array", f"""WITH {_LEAF} SELECT 'viorra-' || printf('%04d', i) AS essay_id, text, coalesce(nullif(source, ''), 'unknown') AS source, {sql.words('text')}::INT AS length_words, i - 1 AS input_ord FROM n1 WHERE text IS NOT NULL AND {sql.strip('text')} <> ''""")
def scan_json_array(spark, d):
    return ig.read_json_array(spark, _json_array(spark, d)).select("essay_id", "text", "source", "length_words", "input_ord")


@query("source_union_all", f"""WITH {_LEAF}, k AS (SELECT i, coalesce(nullif(source, ''), 'unknown') AS source FROM n1 WHERE text IS NOT NULL AND {sql.strip('text')} <> '')
    SELECT source, count(*) AS n, min(i) - 1 AS first_ord FROM k GROUP BY source UNION ALL SELECT 'leaf', count(*), 1099511627776 + min(i) - 1 FROM k""")
def source_union_all(spark, d):
    """Two raw sources in their order as one."""
    e = ig.concatenate([ig.read_json_array(spark, _json_array(spark, d)), ig.read_json_lines(spark, _json_lines(spark, d))])
    return e.groupBy("source").agg(F.count("*").alias("n"), F.min("input_ord").alias("first_ord"))


@query("dataset_round_trip", "SELECT essay_id, sha256(text) AS content_hash, label, split, length_words, len(preprocessing)::INT AS steps, generation_config.max_tokens AS max_tokens, original_essay_id, count(*) AS n FROM essays GROUP BY ALL")
def dataset_round_trip(spark, d):
    """Records written as lines of JSON and read again."""
    folder = scratch(spark, "dataset")
    ig.write_dataset(essays(spark, d), folder)
    r = ig.read_dataset(spark, folder)
    return r.groupBy("essay_id", F.sha2("text", 256).alias("content_hash"), "label", "split", "length_words", F.when(F.col("preprocessing").isNotNull(), F.size("preprocessing")).alias("steps"), F.col("generation_config.max_tokens").alias("max_tokens"), "original_essay_id").agg(F.count("*").alias("n"))


@query("baseline_artifact_round_trip", "SELECT bucket, feature, n, mean_value, std_value, p5, p25, p50, p75, p95 FROM baselines")
def baseline_artifact_round_trip(spark, d):
    """Stored distributions written as an artifact, the newest artifact found, and read again."""
    folder = scratch(spark, "artifact")
    b = read_table(spark, d, "baselines")
    counts = b.groupBy("bucket").agg(F.lit(0).cast("long").alias("n_essays"), F.max("n").alias("n_sentences"))
    ig.write_baselines(folder, "f0", b.limit(0), counts, [])
    ig.write_baselines(folder, "f1", b, counts, [])
    return ig.read_baselines(spark, ig.newest(spark, folder, "baselines_f1.json"))


@query("dataset_build")
def dataset_build(spark, d):
    """A dataset version of the stored essays: normal form, validity, deduplication, splits, files."""
    return pl.build_dataset(essays(spark, d), scratch(spark, "build"), "v1").select("essay_id", "split", "label", "length_words")


# --- generation records -------------------------------------------------------------------------------------------------


_PROMPT = "'Write a college admissions essay on the topic: ' || topic || chr(10) || 'Word count: ' || length_words || ' words' || chr(10) || 'Style: Personal, reflective, authentic voice' || chr(10)"


@query("prompt_template", f"SELECT input_ord, config, {_PROMPT} || CASE WHEN config = 'adversarial' THEN chr(10) || 'Write in a natural, human style.' ELSE '' END AS prompt FROM essays, (VALUES ('standard'), ('creative'), ('focused'), ('adversarial')) AS c(config) WHERE topic IS NOT NULL AND length_words IS NOT NULL")
def prompt_template(spark, d):
    """The prompt of every configuration for the topic of every record."""
    e = essays(spark, d).where("topic IS NOT NULL AND length_words IS NOT NULL").select("input_ord", "topic", "length_words", F.explode(F.array(*[F.lit(n) for n in gen.CONFIGS])).alias("config"))
    return e.select("input_ord", "config", gen.prompt_column(F.col("config"), F.col("topic"), F.col("length_words")).alias("prompt"))


@query("config_lookup", "SELECT * FROM (VALUES ('standard', 0.7::DOUBLE, 0.9::DOUBLE, 50, 800), ('creative', 0.9, 0.95, 100, 800), ('focused', 0.3, 0.8, 20, 800), ('adversarial', 0.7, 0.9, 50, 800)) AS c(config, temperature, top_p, top_k, max_tokens)")
def config_lookup(spark, d):
    return gen.configs(spark).drop("template")


_KNOWN = "(VALUES ('standard', 0.7::DOUBLE), ('creative', 0.9), ('focused', 0.3), ('adversarial', 0.7)) AS c(config, temperature)"


@query("remaining_configs", f"SELECT config FROM {_KNOWN} WHERE NOT EXISTS (SELECT 1 FROM essays e WHERE e.generation_config.temperature = c.temperature AND e.generation_config.top_k = 20)")
def remaining_configs(spark, d):
    """Configurations that no stored record with a narrow choice of tokens was made with."""
    done = essays(spark, d).where("generation_config.top_k = 20").select(F.col("generation_config.temperature").alias("temperature"))
    return gen.remaining(gen.configs(spark).select("config"), gen.configs(spark).join(done, "temperature", "left_semi").select("config"))


@query(
    "generation_resumed",
    """SELECT 'ai-' || config || '-' || printf('%04d', i) AS essay_id, config, 60 AS length_words, 1 + (i - 1) // 2 AS seed
    FROM (VALUES ('standard'), ('creative'), ('focused'), ('adversarial')) AS c(config), range(1, 6) AS r(i)""",
)
def generation_resumed(spark, d):
    """A run that breaks off in its third configuration, and the run that goes on from there."""
    folder = scratch(spark, "generated")
    topics = [r["topic"] for r in essays(spark, d).where("topic IS NOT NULL").select("topic").distinct().orderBy("topic").limit(2).collect()]  # two topics are what the run is asked for

    def broken(prompts: list[str], settings: dict) -> list[str]:
        if settings["top_k"] == 20:
            raise ConnectionError("the generator is gone")
        return ["word " * 60 for _ in prompts]

    try:
        gen.generate(spark, broken, topics, 20, folder=folder, batch=2)
    except ConnectionError:
        pass
    records, _ = gen.generate(spark, lambda p, s: ["word " * 60 for _ in p], topics, 20, folder=folder, batch=2)
    return records.select("essay_id", F.regexp_extract("essay_id", "^ai-([a-z]+)-", 1).alias("config"), "length_words", F.col("generation_config.seed").alias("seed"))


@query("prompt_left_join", "SELECT e.input_ord, coalesce(nullif(trim(p.topic), ''), 'unspecified_prompt') AS prompt FROM essays e LEFT JOIN (SELECT essay_id, min(topic) AS topic FROM essays WHERE label = 'human' GROUP BY essay_id) p ON e.original_essay_id = p.essay_id")
def prompt_left_join(spark, d):
    e = essays(spark, d)
    p = e.where("label = 'human'").groupBy(F.col("essay_id").alias("k")).agg(F.min("topic").alias("t"))
    return e.join(p, F.col("original_essay_id") == F.col("k"), "left").select("input_ord", F.coalesce(F.nullif(F.trim("t"), F.lit("")), F.lit("unspecified_prompt")).alias("prompt"))


@query("generation_length_guard", f"SELECT input_ord, {sql.words('text')} BETWEEN 50 AND 700 AS accepted FROM essays WHERE label = 'ai_generated' AND text IS NOT NULL")
def generation_length_guard(spark, d):
    e = essays(spark, d).where("label = 'ai_generated' AND text IS NOT NULL")
    return e.select("input_ord", tx.word_count(F.col("text")).between(*ds.GENERATION_WORDS).alias("accepted"))


_CFG = "CASE generation_config.temperature WHEN 0.7 THEN 'standard' WHEN 0.9 THEN 'creative' WHEN 0.3 THEN 'focused' ELSE 'other' END"


@query("generation_config_rollup", f"SELECT coalesce(config, 'total') AS config, count(*) AS records, count(*) FILTER (WHERE w BETWEEN 50 AND 700) AS accepted FROM (SELECT {_CFG} AS config, {sql.words('text')} AS w FROM essays WHERE generation_config IS NOT NULL AND text IS NOT NULL) GROUP BY ROLLUP (config)")
def generation_config_rollup(spark, d):
    t = F.col("generation_config.temperature")
    e = essays(spark, d).where("generation_config IS NOT NULL AND text IS NOT NULL").select(F.when(t == 0.7, "standard").when(t == 0.9, "creative").when(t == 0.3, "focused").otherwise("other").alias("config"), tx.word_count(F.col("text")).alias("w"))
    return e.rollup("config").agg(F.count("*").alias("records"), F.count_if(F.col("w").between(*ds.GENERATION_WORDS)).alias("accepted")).select(F.coalesce("config", F.lit("total")).alias("config"), "records", "accepted")


@query("config_range_check", "SELECT input_ord, NOT coalesce(generation_config.temperature > 0 AND generation_config.temperature <= 2 AND generation_config.top_p > 0 AND generation_config.top_p <= 1 AND generation_config.top_k >= 1 AND generation_config.max_tokens >= 1 AND generation_config.max_tokens <= 2048, false) AS out_of_range FROM essays WHERE generation_config IS NOT NULL")
def config_range_check(spark, d):
    return essays(spark, d).where("generation_config IS NOT NULL").select("input_ord", ds.bad_config().alias("out_of_range"))


# --- caches, artifacts, admission ------------------------------------------------------------------------------------------


@query(
    "error_envelopes",
    f"""WITH x AS (SELECT doc_id, CASE WHEN text IS NULL OR {sql.strip('text')} = '' THEN 'text must not be empty' WHEN length(text) > 10000 THEN 'text is too long' WHEN len({sql.tokens('text')}) = 0 THEN 'text contains no words' WHEN len({sql.tokens('text')}) > 1024 THEN 'text exceeds the token window of the instrument' END AS message FROM documents)
    SELECT doc_id, CASE WHEN message IS NULL THEN 200 ELSE 422 END AS status, CASE WHEN message IS NOT NULL THEN 'VALIDATION_ERROR' END AS code, message FROM x""",
)
def error_envelopes(spark, d):
    g = pl.guard(read_table(spark, d, "documents").select("doc_id", "text"))
    status = F.when(F.col("error").isNull(), 200).otherwise(422)
    e = g.select("doc_id", status.alias("status"), pl.error_envelope(status, F.col("error")).alias("e"))
    return e.select("doc_id", "status", "e.code", "e.message")


@query("latest_artifact", "SELECT feature_version, arg_max(analysis_id, (analysed_at, analysis_id)) AS analysis_id, max(analysed_at) AS analysed_at FROM analyses GROUP BY feature_version")
def latest_artifact(spark, d):
    """The newest analysis of each feature version, as one looks up the newest artifact."""
    return read_table(spark, d, "analyses").groupBy("feature_version").agg(F.max_by("analysis_id", F.struct("analysed_at", "analysis_id")).alias("analysis_id"), F.max("analysed_at").alias("analysed_at"))


@query("feature_cache_incremental", "SELECT DISTINCT essay_id FROM essays WHERE label = 'human' AND essay_id NOT IN (SELECT essay_id FROM analyses WHERE feature_version = 'f0.3.0')")
def feature_cache_incremental(spark, d):
    from lectern.sources.ingest import cache_split

    human = essays(spark, d).where("label = 'human'").select("essay_id").distinct()
    return cache_split(human, read_table(spark, d, "analyses").select("essay_id", "feature_version"), "f0.3.0")[1]


@query(
    "analysis_versions",
    """WITH one AS (SELECT DISTINCT * FROM (SELECT analysis_id, essay_id, feature_version, model_version, length_bucket, baseline_bucket, analysed_at FROM analyses))
    SELECT feature_version, coalesce(model_version, 'none') AS model_version, length_bucket, baseline_bucket, count(*) AS analyses, count(DISTINCT essay_id) AS essays FROM one GROUP BY ALL""",
)
def analysis_versions(spark, d):
    one = read_table(spark, d, "analyses").select("analysis_id", "essay_id", "feature_version", "model_version", "length_bucket", "baseline_bucket", "analysed_at").distinct()
    return one.groupBy("feature_version", F.coalesce("model_version", F.lit("none")).alias("model_version"), "length_bucket", "baseline_bucket").agg(F.count("*").alias("analyses"), F.count_distinct("essay_id").alias("essays"))


#: Limits of the query: three hits in an hour, which these sparse tables exceed.
_LIMIT, _SECONDS = 3, 3600.0
_ADMIT_SQL = f"""WITH RECURSIVE h AS (SELECT client_key, hit_id, now_s, row_number() OVER (PARTITION BY client_key ORDER BY now_s, hit_id) AS i FROM (SELECT DISTINCT hit_id, client_key, now_s FROM limiter_hits WHERE client_key IS NOT NULL AND now_s IS NOT NULL)),
    w AS (
        SELECT client_key, hit_id, now_s, i, TRUE AS allowed, [now_s] AS live, {_LIMIT - 1} AS remaining FROM h WHERE i = 1
        UNION ALL
        SELECT h.client_key, h.hit_id, h.now_s, h.i, len(list_filter(live, lambda x: x > h.now_s - {_SECONDS})) < {_LIMIT},
               CASE WHEN len(list_filter(live, lambda x: x > h.now_s - {_SECONDS})) < {_LIMIT} THEN list_append(list_filter(live, lambda x: x > h.now_s - {_SECONDS}), h.now_s) ELSE list_filter(live, lambda x: x > h.now_s - {_SECONDS}) END,
               greatest(0, {_LIMIT} - 1 - len(list_filter(live, lambda x: x > h.now_s - {_SECONDS})))
        FROM w JOIN h ON h.client_key = w.client_key AND h.i = w.i + 1)
    SELECT client_key, hit_id, allowed, remaining::INT AS remaining FROM w"""


@query("rate_limit_admission", _ADMIT_SQL)
def rate_limit_admission(spark, d):
    return limiter.admit(read_table(spark, d, "limiter_hits"), limit=_LIMIT, window=_SECONDS).select("client_key", "hit_id", "allowed", "remaining")


@query("rate_limit_response", _ADMIT_SQL.replace("SELECT client_key, hit_id, allowed, remaining::INT AS remaining FROM w", f"""SELECT hit_id, CASE WHEN allowed THEN 200 ELSE 429 END AS status, '1.0' AS version, '{_LIMIT}' AS most, remaining::VARCHAR AS remaining, (floor(now_s)::BIGINT + {int(_SECONDS)})::VARCHAR AS reset,
    CASE WHEN NOT allowed THEN '{int(_SECONDS)}' END AS retry_after, CASE WHEN NOT allowed THEN 'RATE_LIMITED' END AS code FROM w"""))
def rate_limit_response(spark, d):
    """Answers to the logged hits: status, headers and, for refused ones, the body."""
    a = limiter.respond(limiter.admit(read_table(spark, d, "limiter_hits"), limit=_LIMIT, window=_SECONDS), limit=_LIMIT)
    h = F.col("headers")
    return a.select("hit_id", "status", h["X-API-Version"].alias("version"), h["X-RateLimit-Limit"].alias("most"), h["X-RateLimit-Remaining"].alias("remaining"), h["X-RateLimit-Reset"].alias("reset"), h["Retry-After"].alias("retry_after"), F.get_json_object("body", "$.error.code").alias("code"))


@query("rate_limit_reset", _ADMIT_SQL.replace("PARTITION BY client_key", "PARTITION BY client_key, floor(now_s / 86400)").replace("SELECT client_key, hit_id, now_s, row_number()", "SELECT client_key || '/' || floor(now_s / 86400) AS client_key, hit_id, now_s, row_number()").replace("SELECT client_key, hit_id, allowed, remaining::INT AS remaining FROM w", "SELECT hit_id, allowed, remaining::INT AS remaining FROM w"))
def rate_limit_reset(spark, d):
    """Admission where all state is forgotten at the beginning of a day."""
    h = read_table(spark, d, "limiter_hits")
    return limiter.admit(h, limit=_LIMIT, window=_SECONDS, epoch=F.floor(F.col("now_s") / 86400)).select("hit_id", "allowed", "remaining")


@query("rate_limit_default")
def rate_limit_default(spark, d):
    """Admission under the default limit, beside the logged decision."""
    hits = read_table(spark, d, "limiter_hits")
    a = limiter.admit(hits)
    logged = hits.groupBy("hit_id").agg(F.max("allowed").alias("logged"))
    return a.join(logged, "hit_id").groupBy("allowed", "logged").agg(F.count("*").alias("n"))


@query("hits_per_hour", "SELECT time_bucket(INTERVAL 1 HOUR, hit_at) AS window_start, route, count(*) AS hits, count(*) FILTER (WHERE allowed) AS allowed FROM limiter_hits GROUP BY ALL")
def hits_per_hour(spark, d):
    h = read_table(spark, d, "limiter_hits").withColumn("hit_at", F.col("hit_at").cast("timestamp"))
    return limiter.windowed_counts(h).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("late_hits", "SELECT route, count(*) AS hits, count(*) FILTER (WHERE received_at > hit_at + INTERVAL 1 DAY) AS late, count(*) FILTER (WHERE client_key IS NULL) AS keyless FROM (SELECT DISTINCT * FROM limiter_hits) GROUP BY route")
def late_hits(spark, d):
    h = read_table(spark, d, "limiter_hits").distinct()
    return h.groupBy("route").agg(F.count("*").alias("hits"), F.count_if(F.col("received_at") > F.col("hit_at") + F.expr("INTERVAL 1 DAY")).alias("late"), F.count_if(F.col("client_key").isNull()).alias("keyless"))
