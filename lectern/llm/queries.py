"""The queries of the ten problems and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import cross_split, encoding, grouped_split, lookalike, mixing, packing, repetition, sentences, shared_spans, truncation
from lectern.session import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def _essays(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Columns of the essays, over all cores."""
    return spread(read_table(spark, d, "essays").select(*columns))


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text", *columns))


_ENDING = ("essay_id", "text", "source", "model", "generation_config")
_SIDES = ("essay_id", "text", "split", "source", "model")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.endings(_essays(spark, d, *_ENDING)).where("broken").select("essay_id")


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of broken-off essays per source (model if there is none)."""
    e = truncation.endings(_essays(spark, d, *_ENDING)).where("kind <> 'blank'")
    return e.groupBy("origin").agg(F.count("*").alias("essays"), F.count_if("broken").alias("broken_off"), F.count_if("at_limit").alias("at_a_limit"), (F.count_if("broken") / F.count("*")).alias("broken_share"))


def p1_causes(spark: SparkSession, d: str) -> DataFrame:
    """By which sign essays count as broken off: the limit of a source or model, or signs of a cut in transfer."""
    e = truncation.endings(_essays(spark, d, *_ENDING)).where("broken")
    return e.groupBy("cause").agg(F.count("*").alias("essays"), F.count_if("at_limit").alias("at_a_limit"))


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which texts of one limiter end significantly often."""
    return truncation.length_hazards(truncation.endings(_essays(spark, d, *_ENDING)).where("kind NOT IN ('blank', 'repeats')")).where("significant").select("limiter", "unit", "d", "at_risk", "hazard", "expected", "p")


def _repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.judged(_essays(spark, d, "essay_id", "label", "model", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeating(_essays(spark, d, "essay_id", "text"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return _repetition(spark, d).drop("repeats").distinct()


def p2_spread(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the repeated share by label and model."""
    r = _repetition(spark, d).select("essay_id", "label", "model", "repeated_share", "repeats").distinct()
    q = F.percentile_approx("repeated_share", [0.5, 0.9, 0.99], 10000)
    return r.groupBy("label", "model").agg(F.count("*").alias("essays"), F.count_if("repeats").alias("repeating"), F.avg("repeated_share").alias("mean_share"), q.alias("q")).select("label", "model", "essays", "repeating", "mean_share", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(_essays(spark, d, "essay_id", "text"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent text of every essay and whether it changed."""
    return lookalike.canonical(_essays(spark, d, "essay_id", "text")).select("essay_id", F.col("form").alias("consistent_text"), (~F.col("form").eqNullSafe(F.col("text"))).alias("changed")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.broken_families(read_table(spark, d, "essays"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.assign(read_table(spark, d, "essays"))


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "analyses").select("essay_id").distinct()
    return read_table(spark, d, "essays").select("essay_id", "text").join(ids, "essay_id", "left_semi").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_analysed(spark, d), model=sentences.learn(_essays(spark, d, "text"))).select("essay_id", "start_char", "end_char").distinct()


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The ordered sentences that replace `text` in sentence_evidence."""
    return sentences.sentences(_analysed(spark, d), model=sentences.learn(_essays(spark, d, "text"))).select("essay_id", "sent_index", "start_char", "end_char", F.col("sentence").alias("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    o = cross_split.overlaps(_essays(spark, d, *_SIDES))
    return o.select(F.least("train_id", "eval_id").alias("essay_id_a"), F.greatest("train_id", "eval_id").alias("essay_id_b")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs per evaluation split and source."""
    o = cross_split.overlaps(_essays(spark, d, *_SIDES)).distinct()
    return o.groupBy("eval_split", "eval_source").agg(F.count("*").alias("pairs"), F.count_distinct("eval_id").alias("evaluation_essays"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    g = encoding.garbling(_essays(spark, d, "essay_id", "text").where("essay_id IS NOT NULL"))
    return g.where("garbling.garbled").select("essay_id").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled essays with their restored text and how many places cannot be restored."""
    g = encoding.garbling(_essays(spark, d, "essay_id", "source", "text"))
    return g.where("garbling.garbled").select("essay_id", "source", F.col("garbling.restored").alias("restored_text"), F.col("garbling.left").alias("places_left")).distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_documents(spark, d), read_table(spark, d, "pack_settings"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d), read_table(spark, d, "pack_settings"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_documents(spark, d, "source"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_documents(spark, d, "source"), read_table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_text(_documents(spark, d)).where("passages > 0").select("doc_id")


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_text(_documents(spark, d))


def queries() -> dict[str, Query]:
    """Every p-query of this module by its name."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


_ID = "regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g')"


def _p3_sql() -> str:
    """The same look by a form of its own: texts taken apart into characters that a table maps one by one, then put together."""
    quoted = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    latin = quoted(lookalike.LOOKALIKES.items())  # the letters themselves are fixed values
    joined = quoted([("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("Ǉ", "LJ"), ("ǈ", "Lj"), ("ǉ", "lj"), ("Ǌ", "NJ"), ("ǋ", "Nj"), ("ǌ", "nj")])
    kana = quoted(zip("ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ", "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"))
    marks = quoted([("ﾞ", "\u3099"), ("ﾟ", "\u309a")])
    gone = "u IN (173, 847, 1564, 4447, 4448, 6068, 6069, 65279) OR u BETWEEN 6155 AND 6159 OR u BETWEEN 8203 AND 8207 OR u BETWEEN 8234 AND 8238 OR u BETWEEN 8288 AND 8292 OR u BETWEEN 8294 AND 8303 OR u BETWEEN 65024 AND 65039"
    wide = "u BETWEEN 65296 AND 65305 OR u BETWEEN 65313 AND 65338 OR u BETWEEN 65345 AND 65370"
    blank = "u IN (160, 5760, 8239, 8287, 12288) OR u BETWEEN 8192 AND 8202"
    return f"""
    WITH t AS (SELECT DISTINCT text FROM essays WHERE text IS NOT NULL AND essay_id IS NOT NULL AND regexp_replace(text, '\\s', '', 'g') <> ''),
    m AS (SELECT * FROM (VALUES {latin}, {joined}, {kana}, {marks}) AS v(a, b)),
    c AS (SELECT text, generate_subscripts(x, 1) AS i, unnest(x) AS ch FROM (SELECT text, string_split(nfc_normalize(text), '') AS x FROM t)),
    k AS (SELECT text, i, ch, unicode(ch) AS u FROM c),
    w AS (SELECT text, i, CASE WHEN {gone} THEN '' WHEN {wide} THEN chr(u - 65248) WHEN {blank} THEN ' ' ELSE coalesce(b, ch) END AS r FROM k LEFT JOIN m ON m.a = k.ch),
    f AS (SELECT text, nfc_normalize(string_agg(r, '' ORDER BY i)) AS form FROM w GROUP BY text),
    e AS (SELECT DISTINCT essay_id, text, form FROM essays JOIN f USING (text) WHERE essay_id IS NOT NULL)
    SELECT DISTINCT a.essay_id AS essay_id_a, b.essay_id AS essay_id_b
    FROM e a JOIN e b ON a.form = b.form AND a.text <> b.text AND a.essay_id < b.essay_id"""


def _p4_sql() -> str:
    form = "'(hum|gen|pol)-[0-9]{9}'"
    own, other = _ID.format("essay_id"), _ID.format("original_essay_id")
    return f"""
    WITH RECURSIVE r AS (
        SELECT essay_id, coalesce(split, '') AS split, text,
               CASE WHEN regexp_full_match({own}, {form}) THEN {own} ELSE essay_id END AS node,
               CASE WHEN regexp_full_match({other}, {form}) THEN {other} END AS original
        FROM essays WHERE essay_id IS NOT NULL),
    edge AS (
        SELECT DISTINCT node AS u, original AS v FROM r WHERE original IS NOT NULL AND original <> node
        UNION SELECT DISTINCT original, node FROM r WHERE original IS NOT NULL AND original <> node),
    reach AS (
        SELECT DISTINCT node AS u, node AS v FROM r
        UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
    fam AS (
        SELECT reach.u AS node, min(r.essay_id) AS family_id, count(DISTINCT r.essay_id) AS n, count(DISTINCT CASE WHEN trim(r.split) <> '' THEN trim(r.split) END) AS splits
        FROM reach JOIN r ON r.node = reach.v GROUP BY reach.u)
    SELECT DISTINCT r.essay_id, fam.family_id FROM r JOIN fam ON fam.node = r.node
    WHERE fam.n > 1 AND fam.splits > 1 AND regexp_replace(coalesce(r.text, ''), '\\s', '', 'g') <> ''"""


_P10_SQL = f"""
    WITH w AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - {shared_spans.LEAST - 2}), lambda i: hash(substring(text, i, {shared_spans.LEAST})))) AS h FROM documents WHERE length(text) >= {shared_spans.LEAST}),
    s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
    SELECT DISTINCT doc_id FROM w WHERE h IN (SELECT h FROM s)"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _p3_sql(), "p4_found": _p4_sql(), "p10_found": _P10_SQL}
