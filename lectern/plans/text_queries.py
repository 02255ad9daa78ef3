"""Queries over words, sentences, features and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.features import READABILITY, STYLOMETRIC, catalog, sentence_features
from lectern.operators import language_model as lm
from lectern.operators.passages import STATISTICS, document_passages, mattr, member_statistics, mtld, passage_array
from lectern.operators.sentences import in_sentences, positions, sentence_array, split_sentences
from lectern.operators.tagging import dep_depth_mean, tag_shares
from lectern.operators.vectors import TEXTUAL, long_values, text_vector, with_vectors
from lectern.plans import sql
from lectern.session import read_table, spread

#: Statistics of a passage's features; a nudge before rounding keeps ties on one side in both engines.
STATS = ("mean", "std", "cv", "min", "max", "p5", "p25", "p50", "p75", "p95")
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(docs(spark, d))


def r6(c):
    return F.round(c, 6)


@query("doc_word_counts", f"SELECT doc_id, len({sql.tokens('text')})::BIGINT AS n_tokens, {sql.words('text')}::BIGINT AS n_words FROM documents WHERE text IS NOT NULL")
def doc_word_counts(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"), tx.word_count(F.col("text")).alias("n_words"))


@query("doc_length_bucket", f"SELECT doc_id, {sql.bucket('n')} AS bucket FROM (SELECT doc_id, {sql.words('text')} AS n FROM documents WHERE text IS NOT NULL)")
def doc_length_bucket(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", tx.length_bucket(tx.word_count(F.col("text"))).alias("bucket"))


@query(
    "doc_lexical",
    f"""SELECT doc_id, round({sql.ratio('len(list_distinct(t))', 'len(t)')}, 6) AS ttr, round({sql.ratio('len(t) - len(list_distinct(t))', 'len(t)')}, 6) AS lexical_recurrence,
    round({sql.ratio("length(array_to_string(t, ''))", 'len(t)')}, 6) AS word_length_mean FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents WHERE text IS NOT NULL)""",
)
def doc_lexical(spark, d):
    t = docs(spark, d).where("text IS NOT NULL").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    n, k = F.size("t"), F.size(F.array_distinct("t"))
    return t.select("doc_id", r6(tx.ratio(k, n)).alias("ttr"), r6(tx.ratio(n - k, n)).alias("lexical_recurrence"), r6(tx.ratio(F.length(F.array_join("t", "")), n)).alias("word_length_mean"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("sentence_split", f"WITH {sql.sentences()} SELECT doc_id, sent_idx::INT AS sent_idx, start, \"end\", sentence FROM sent")
def sentence_split(spark, d):
    return sentences(spark, d).select("doc_id", "sent_idx", "start", "end", "sentence")


@query("paragraph_segments", f"WITH {sql.sentences()} SELECT doc_id, sent_idx::INT AS sent_idx, is_break, segment::INT AS segment FROM sent")
def paragraph_segments(spark, d):
    return sentences(spark, d).select("doc_id", "sent_idx", "is_break", "segment")


@query("sentence_stylometry", f"WITH {sql.sentences()}, {sql.featured()} SELECT doc_id, sent_idx::INT AS sent_idx, {', '.join(STYLOMETRIC)} FROM feat")
def sentence_stylometry(spark, d):
    return sentence_features(sentences(spark, d), 6).select("doc_id", "sent_idx", *STYLOMETRIC)


@query("sentence_readability", f"WITH {sql.sentences()}, {sql.featured()} SELECT doc_id, sent_idx::INT AS sent_idx, {', '.join(READABILITY)} FROM feat")
def sentence_readability(spark, d):
    return sentence_features(sentences(spark, d), 6).select("doc_id", "sent_idx", *READABILITY)


@query("sentence_features_long", f"WITH {sql.sentences()}, {sql.vectors(model=False)} SELECT doc_id, sent_idx::INT AS sent_idx, feature, ordinal, value FROM longf")
def sentence_features_long(spark, d):
    return long_values(with_vectors(sentences(spark, d), digits=6), ["doc_id", "sent_idx"], TEXTUAL)


_FRAME = """
    frames AS (SELECT doc_id, segment, sent_idx, sentence, list(sent_idx) OVER w AS ids, list(sentence) OVER w AS texts, row_number() OVER (PARTITION BY {part} ORDER BY sent_idx) - 1 AS n
               FROM sent WINDOW w AS (PARTITION BY {part} ORDER BY sent_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    pass AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1)::INT AS passage_idx, sent_idx::INT AS first_idx, ids, array_to_string(texts, ' ') AS text
             FROM frames WHERE len(ids) = 3 AND n % {stride} = 0)"""


def _pass(part: str = "doc_id", stride: int = 1) -> str:
    return f"WITH {sql.sentences()}, {_FRAME.format(part=part, stride=stride)}"


@query("passage_windows", f"{_pass()} SELECT doc_id, passage_idx, first_idx, text FROM pass")
def passage_windows(spark, d):
    return document_passages(docs(spark, d), bounded=False).select("doc_id", "passage_idx", "first_idx", "text")


@query("passage_windows_stride2", f"{_pass(stride=2)} SELECT doc_id, passage_idx, first_idx, text FROM pass")
def passage_windows_stride2(spark, d):
    return document_passages(docs(spark, d), stride=2, bounded=False).select("doc_id", "passage_idx", "first_idx", "text")


@query("passage_paragraph_bounded", f"{_pass('doc_id, segment')} SELECT doc_id, passage_idx, first_idx, text FROM pass")
def passage_paragraph_bounded(spark, d):
    return document_passages(docs(spark, d)).select("doc_id", "passage_idx", "first_idx", "text")


@query(
    "passage_feature_stats",
    f"""{_pass('doc_id, segment')}, {sql.vectors(model=False)},
    member AS (SELECT doc_id, passage_idx, unnest(ids) AS sent_idx FROM pass),
    agg AS (SELECT doc_id, passage_idx, feature, avg(value) AS mean, stddev_pop(value) AS std, CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) END AS cv, min(value) AS min, max(value) AS max,
                   quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95
            FROM member JOIN longf USING (doc_id, sent_idx) GROUP BY ALL)
    SELECT doc_id, passage_idx, feature, {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in STATS)} FROM agg""",
)
def passage_feature_stats(spark, d):
    s = docs(spark, d).where("text IS NOT NULL").select("doc_id", sentence_array(F.col("text")).alias("s"))
    s = s.withColumn("v", F.transform("s", lambda x: text_vector(x["sentence"], 6))).withColumn("p", passage_array(F.col("s")))
    p = s.select("doc_id", F.explode("p").alias("p"), "v").select("doc_id", "p.passage_idx", F.inline(member_statistics(F.col("p.sentence_indices"), F.col("v"), TEXTUAL)))
    return p.select("doc_id", "passage_idx", "feature", *[F.round(F.col(f"s.{c}") + 1e-9, 4).alias(c) for c in STATISTICS])


_MATTR = f"""CASE WHEN len(t) >= 50 THEN list_sum(list_transform(range(1, len(t) - 48), lambda i: len(list_distinct(t[i:i + 49]))))::DOUBLE / (len(t) - 49) / 50.0::DOUBLE ELSE {sql.ratio('len(list_distinct(t))', 'len(t)')} END"""


@query("passage_mattr", f"{_pass('doc_id, segment')}, pt AS (SELECT doc_id, passage_idx, {sql.tokens('text')} AS t FROM pass) SELECT doc_id, passage_idx, round({_MATTR}, 6) AS mattr FROM pt")
def passage_mattr(spark, d):
    p = document_passages(docs(spark, d)).select("doc_id", "passage_idx", tx.tokens(F.col("text")).alias("t"))
    return p.select("doc_id", "passage_idx", r6(mattr(F.col("t"))).alias("mattr"))


def mtld_ctes() -> str:
    """CTEs ending in `mtl` (doc_id, passage_idx, mtld): both directions as one recursion over positions of the passages' tokens."""
    return f"""
    {_pass('doc_id, segment').replace('WITH', 'WITH RECURSIVE', 1)}, pt AS (SELECT doc_id, passage_idx, {sql.tokens('text')} AS t FROM pass),
    dirs AS (SELECT doc_id, passage_idx, 1 AS dir, t FROM pt UNION ALL SELECT doc_id, passage_idx, 2, list_reverse(t) FROM pt),
    walk AS (
        SELECT doc_id, passage_idx, dir, t, 0 AS i, 0.0::DOUBLE AS c, 0 AS l, []::VARCHAR[] AS s FROM dirs
        UNION ALL
        SELECT doc_id, passage_idx, dir, t, i + 1,
               CASE WHEN len(list_distinct(list_append(s, t[i + 1])))::DOUBLE / (l + 1) <= 0.72 THEN c + 1 ELSE c END,
               CASE WHEN len(list_distinct(list_append(s, t[i + 1])))::DOUBLE / (l + 1) <= 0.72 THEN 0 ELSE l + 1 END,
               CASE WHEN len(list_distinct(list_append(s, t[i + 1])))::DOUBLE / (l + 1) <= 0.72 THEN []::VARCHAR[] ELSE list_distinct(list_append(s, t[i + 1])) END
        FROM walk WHERE i < len(t)),
    mtl AS (SELECT doc_id, passage_idx, sum(c + CASE WHEN l > 0 THEN len(s)::DOUBLE / l / 0.72::DOUBLE ELSE 0 END) / 2 AS mtld FROM walk WHERE i = len(t) GROUP BY doc_id, passage_idx)"""


@query("passage_mtld", f"{mtld_ctes()} SELECT doc_id, passage_idx, round(mtld, 6) AS mtld FROM mtl")
def passage_mtld(spark, d):
    p = document_passages(docs(spark, d)).select("doc_id", "passage_idx", tx.tokens(F.col("text")).alias("t"))
    return p.select("doc_id", "passage_idx", r6(mtld(F.col("t"))).alias("mtld"))


# Fixed values, written out here once more: the names of every family and state.
_FAMILIES = {
    ("lexical", "implemented"): "ttr word_length_mean sent_len mattr mtld",
    ("lexical", "planned"): "hdd rare_word_rate",
    ("repetition", "implemented"): "ngram_rep_char_3 ngram_rep_word_2 lexical_recurrence",
    ("repetition", "experimental"): "self_similarity",
    ("readability", "implemented"): "flesch_reading_ease flesch_kincaid_grade ari coleman_liau gunning_fog",
    ("rhythm", "implemented"): "punct_density sent_len_mean sent_len_std sent_len_cv clause_density_mean",
    ("syntax", "implemented"): " ".join(("pos_entropy", "dep_depth_mean", "clause_density", *(f"pos_{t}" for t in sql.POS))),
    ("lm", "implemented"): " ".join(sql.MODEL),
    ("contextual", "experimental"): "coherence_prev coherence_next topic_consistency",
}


def _catalog_sql() -> str:
    rows = ", ".join(f"('{n}', '{f}', '{s}', {sql.ORDER.index(n) + 1 if n in sql.ORDER else 'NULL'})" for (f, s), names in _FAMILIES.items() for n in names.split())
    return f"SELECT * FROM (VALUES {rows}) AS v(feature, family, status, ordinal)"


@query("feature_catalog_lookup", _catalog_sql())
def feature_catalog_lookup(spark, d):
    return catalog(spark)


_UNI = f"""
    tk AS (SELECT unnest({sql.tokens('text')}) AS token FROM documents WHERE text IS NOT NULL),
    cn AS (SELECT token, count(*) AS n FROM tk GROUP BY token),
    al AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS kinds, max(n)::DOUBLE AS top FROM cn),
    pr AS (SELECT token, n, (n + 1.0::DOUBLE) / (total + kinds) AS p, (top + 1.0::DOUBLE) / (total + kinds) AS top1, rank() OVER (ORDER BY n DESC) - 1 AS rank FROM cn, al),
    uni AS (SELECT *, (SELECT sum(-(p * ln(p))) FROM pr) AS entropy FROM pr)"""


@query(
    "tokens_in_sentences",
    f"""WITH {sql.sentences()}, pc AS (SELECT doc_id, regexp_extract_all(text, '[^{sql.WS_RE}]+|[{sql.WS_RE}]+') AS p FROM documents WHERE text IS NOT NULL),
    pu AS (SELECT doc_id, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM pc),
    pt AS (SELECT doc_id, token, coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM pu),
    j AS (SELECT pt.doc_id, sent_idx::INT AS sent_idx, pos, token FROM pt JOIN sent ON sent.doc_id = pt.doc_id AND pos >= sent.start AND pos < sent."end" WHERE NOT regexp_matches(token, '^[{sql.WS_RE}]'))
    SELECT doc_id, sent_idx, count(*) AS tokens, min(pos) AS first_at, max(pos) AS last_at FROM j GROUP BY ALL""",
)
def tokens_in_sentences(spark, d):
    """Words by their position in the sentences whose spans hold it."""
    x = docs(spark, d).where("text IS NOT NULL")
    t = x.select("doc_id", F.inline(positions(F.col("text")))).withColumnRenamed("start", "at")
    return in_sentences(t, sentences(spark, d), at="at").groupBy("doc_id", "sent_idx").agg(F.count("*").alias("tokens"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("dependency_depth", f"WITH {sql.sentences()}, k AS (SELECT doc_id, sent_idx::INT AS sent_idx, len({sql.tokens('sentence')}) AS n FROM sent) SELECT doc_id, sent_idx, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(range(1, n + 1), lambda i: floor(log2(i))))::DOUBLE / n END, 6) AS dep_depth_mean FROM k")
def dependency_depth(spark, d):
    """Depth over heads of a known shape, where token i hangs from token (i - 1) / 2, as a parser would deliver them."""
    t = sentences(spark, d).select("doc_id", "sent_idx", tx.tokens(F.col("sentence")).alias("t"))
    heads = F.transform("t", lambda x, i: F.when(i == 0, 0).otherwise(F.floor((i - 1) / 2)).cast("int"))
    return t.select("doc_id", "sent_idx", r6(dep_depth_mean(heads)).alias("dep_depth_mean"))


@query("lm_unigram_model", f"WITH {_UNI} SELECT token, n, round(ln(p), 6) AS log_prob, rank, round(top1, 6) AS top1, round(entropy, 4) AS entropy FROM uni")
def lm_unigram_model(spark, d):
    m = lm.unigram_model(docs(spark, d))
    return m.select("token", "n", r6(F.ln("p")).alias("log_prob"), F.col("rank").cast("long"), r6(F.col("top1")).alias("top1"), F.round("entropy", 4).alias("entropy"))


@query(
    "lm_sentence_signals",
    f"""WITH {sql.sentences()}, {_UNI},
    st AS (SELECT doc_id, sent_idx, unnest({sql.tokens('sentence')}) AS token, generate_subscripts({sql.tokens('sentence')}, 1) - 1 AS i FROM sent),
    sg AS (SELECT doc_id, sent_idx, ln(p) AS lp, entropy AS h, rank::DOUBLE AS rk, top1 FROM st JOIN uni USING (token) WHERE NOT (i = 0 AND sent_idx = 0)),
    ag AS (SELECT doc_id, sent_idx, exp(-avg(lp)) AS perplexity, avg(h) AS token_entropy_mean, stddev_pop(h) AS token_entropy_std, avg(lp) AS log_prob_mean, stddev_pop(lp) AS log_prob_std, avg(rk) AS rank_mean, stddev_pop(rk) AS rank_std, avg(top1) AS prob_curvature FROM sg GROUP BY ALL)
    SELECT doc_id, sent_idx::INT AS sent_idx, round(coalesce(perplexity, 0), 3) AS perplexity, round(coalesce(token_entropy_mean, 0), 4) AS token_entropy_mean, round(coalesce(token_entropy_std, 0), 4) AS token_entropy_std, round(coalesce(log_prob_mean, 0), 5) AS log_prob_mean, round(coalesce(log_prob_std, 0), 5) AS log_prob_std,
           round(coalesce(rank_mean, 0), 4) AS rank_mean, round(coalesce(rank_std, 0), 4) AS rank_std, round(coalesce(prob_curvature, 0), 5) AS prob_curvature FROM sent LEFT JOIN ag USING (doc_id, sent_idx)""",
)
def lm_sentence_signals(spark, d):
    s, keys = sentences(spark, d), ["doc_id", "sent_idx"]
    g = lm.sentence_signals(s, lm.token_signals(s, lm.unigram_model(docs(spark, d)), keys), keys)
    digits = {"perplexity": 3, "token_entropy_mean": 4, "token_entropy_std": 4, "log_prob_mean": 5, "log_prob_std": 5, "rank_mean": 4, "rank_std": 4, "prob_curvature": 5}
    return g.select(*keys, *[F.round(c, k).alias(c) for c, k in digits.items()])


def _tag_sql() -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in sql.syntax_columns().items())
    return f"""WITH {sql.sentences()}, un AS (SELECT doc_id, sent_idx, {sql.units('sentence')} AS u FROM sent), tg AS (SELECT *, list_transform(u, lambda x: {sql.tag_case()}) AS g FROM un)
    SELECT doc_id, sent_idx::INT AS sent_idx, {cols} FROM tg WHERE len(u) > 0"""


@query("pos_share_rule", _tag_sql())
def pos_share_rule(spark, d):
    return tag_shares(sentences(spark, d), ["doc_id", "sent_idx"])
