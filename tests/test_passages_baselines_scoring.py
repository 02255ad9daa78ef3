import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import tokens, two_decimals
from lectern.operators import baselines as bl
from lectern.operators import scoring as sc
from lectern.operators.language_model import CountModel, sentence_signals, token_signals, unigram_model
from lectern.operators.passages import STATISTICS, aggregate_features, build_passages, document_passages, factor_count, mattr, mtld, statistics
from lectern.operators.sentences import split_sentences


def sents(spark, n, segments=None):
    rows = [(1, i, (segments or [0] * n)[i], f"s{i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id int, sent_idx int, segment int, sentence string")


def frames(df):
    return [r["sentence_indices"] for r in df.orderBy("passage_idx").collect()]


def test_windows(spark):
    assert frames(build_passages(sents(spark, 5))) == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]
    assert frames(build_passages(sents(spark, 5), stride=2)) == [[0, 1, 2], [2, 3, 4]]
    assert frames(build_passages(sents(spark, 2))) == []
    assert frames(build_passages(sents(spark, 5, [0, 0, 1, 1, 1]))) == [[2, 3, 4]]
    assert frames(build_passages(sents(spark, 4, [0, 0, 1, 1]), bounded=False)) == [[0, 1, 2], [1, 2, 3]]
    with pytest.raises(ValueError):
        build_passages(sents(spark, 3), stride=0)


def test_aggregates(spark):
    df = spark.createDataFrame([("f", float(v)) for v in (1, 2, 3, 4)], "feature string, value double")
    r = aggregate_features(df, []).first()
    assert (r["mean"], r["min"], r["max"]) == (2.5, 1.0, 4.0)
    assert r["std"] == pytest.approx(1.11803, abs=1e-5) and r["cv"] == pytest.approx(0.44721, abs=1e-5)
    assert [r[f"p{q}"] for q in (5, 25, 50, 75, 95)] == pytest.approx([1.15, 1.75, 2.5, 3.25, 3.85])
    assert aggregate_features(spark.createDataFrame([("f", 1.0), ("f", -1.0)], "feature string, value double"), []).first()["cv"] is None


def test_factor_counts():
    assert (factor_count(list("aaaabbbb")) + factor_count(list("bbbbaaaa"))) / 2 == pytest.approx(4.0)
    assert factor_count([str(i) for i in range(100)]) == pytest.approx(1 / 0.72)


def test_mtld_is_the_mean_of_both_directions(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))],) for _ in range(40)]
    out = spark.createDataFrame(rows, "t array<string>").select("t", mtld(F.col("t")).alias("a")).collect()
    assert all(r["a"] == pytest.approx((factor_count(r["t"]) + factor_count(r["t"][::-1])) / 2) for r in out)


def test_passages_within_the_row_are_those_of_the_windows(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(rng.choice(["One two. ", "Three!\n\n", "Four? ", "five ", "\n\nSix. "]) for _ in range(rng.randint(0, 30)))) for i in range(30)] + [(99, None)], "doc_id int, text string")
    from lectern.operators.sentences import split_sentences

    for stride in (1, 2):
        for bounded in (True, False):
            got = {(r["doc_id"], tuple(r["sentence_indices"]), r["text"]) for r in document_passages(docs, stride=stride, bounded=bounded).collect()}
            assert got == {(r["doc_id"], tuple(r["sentence_indices"]), r["text"]) for r in build_passages(split_sentences(docs), stride=stride, bounded=bounded).collect()}


def test_statistics_within_the_row(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(rng.randint(1, 7))]) for i in range(20)]
    df = spark.createDataFrame(rows, "feature string, v array<double>")
    got = {r["feature"]: r["s"] for r in df.select("feature", statistics(F.col("v")).alias("s")).collect()}
    for r in aggregate_features(df.select("feature", F.explode("v").alias("value")), []).collect():
        assert [got[r["feature"]][n] for n in STATISTICS] == pytest.approx([r[n] for n in STATISTICS], abs=1e-9)
    zero = spark.range(1).select(statistics(F.array(F.lit(1.0), F.lit(-1.0))).alias("s")).first()["s"]
    assert zero["cv"] is None and zero["mean"] == 0.0


def test_mattr(spark):
    rows = [([],), (["a", "a"],), ([str(i % 60) for i in range(70)],)]
    out = [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(mattr(F.col("t"))).collect()]
    assert out == pytest.approx([0.0, 0.5, 1.0])


def test_merge_plan():
    plan, log = bl.merge_plan([("short", 5), ("standard", 10), ("long", 100), ("xlong", 0)])
    assert plan == {"short": "long", "standard": "long", "long": "long"} and len(log) == 2
    assert bl.merge_plan([("short", 50), ("standard", 10)])[0] == {"short": "short", "standard": "short"}
    plan, log = bl.merge_plan([("short", 5)])
    assert plan == {"short": "short"} and "no neighbors" in log[0]
    assert bl.merge_plan([]) == ({}, [])


def test_empty_baselines_are_an_error(spark):
    v = spark.createDataFrame([], "bucket string, feature string, value double")
    c = spark.createDataFrame([(0, "short", 0, 0)], "ord int, bucket string, n_essays long, n_sentences long")
    with pytest.raises(ValueError):
        bl.compute(v, c)


def test_counts_name_all_buckets(spark):
    e = spark.createDataFrame([("long",), ("long",)], "bucket string")
    rows = bl.bucket_counts(e, e).orderBy("ord").collect()
    assert [(r["bucket"], r["n_essays"]) for r in rows] == [("short", 0), ("standard", 0), ("long", 2), ("xlong", 0)]


BASE = "bucket string, feature string, mean_value double, std_value double"


def test_score(spark):
    base = spark.createDataFrame([("standard", "a", 100.0, 10.0), ("standard", "b", 1.0, 0.0)], BASE)
    vals = spark.createDataFrame([(1, "standard", "a", 1, 70.0), (1, "standard", "b", 2, 9.0), (1, "standard", "c", 3, 9.0), (2, "standard", "a", 1, float("nan"))], "k int, baseline_bucket string, feature string, ordinal int, value double")
    rows = {r["feature"]: r for r in sc.score(vals, base, ["k"]).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["z_score"], rows["a"]["evidence"], rows["a"]["direction"]) == (-3.0, "high", "lower")
    assert (rows["b"]["z_score"], rows["b"]["evidence"], rows["b"]["direction"]) == (None, "uncertain", "unknown")


def test_units(spark):
    base = spark.createDataFrame([("s", "a", 0.0, 1.0), ("s", "b", 0.0, 1.0), ("s", "c", 0.0, 0.0)], BASE)
    nan = float("nan")
    rows = spark.createDataFrame([(0, "s", [-2.5, 2.5, None]), (1, "s", [0.1, nan, None]), (2, "s", [None, None, 5.0]), (3, "s", [None, None, None]), (4, "none", [9.0, 9.0, 9.0])], "sent_idx int, baseline_bucket string, vector array<double>")
    scored = sc.score_rows(rows, base, sc.named_values(F.col("vector"), ("a", "b", "c")))
    u = {r["sent_idx"]: r for r in scored.withColumns(sc.unit_columns(F.col("signals"), "sentence", F.col("sent_idx"))).collect()}
    assert (u[0]["evidence_strength"], u[0]["top_feature"], u[0]["signal_count"], u[0]["scored_count"]) == ("high", "a", 2, 2)  # ties keep the order of features
    assert u[0]["summary"] == "sentence 0: 2 of 2 scored features show machine-like signals (top: a lower than the human baseline)"
    assert (u[1]["evidence_strength"], u[1]["signal_count"], u[1]["scored_count"]) == ("low", 0, 1)
    assert [u[i]["evidence_strength"] for i in (2, 3, 4)] == ["low", "uncertain", "uncertain"]


def test_fallback(spark):
    base = spark.createDataFrame([("standard", "a", 0.0, 1.0)], BASE)
    e = spark.createDataFrame([("xlong",), ("standard",)], "bucket string")
    assert {r["bucket"]: r["baseline_bucket"] for r in sc.resolve_buckets(e, base).collect()} == {"xlong": "standard", "standard": "standard"}
    assert sc.resolve_buckets(e, base.limit(0)).where("bucket = 'xlong'").first()["baseline_bucket"] == "xlong"


def test_summary_text(spark):
    c = [F.lit("ttr"), F.lit(70.0), F.lit(100.0), F.lit(10.0)]
    r = spark.range(1).select(sc.signal_summary(*c, F.lit(-3.0)).alias("a"), sc.signal_summary(*c, F.lit(None).cast("double")).alias("b")).first()
    assert r["a"] == "ttr: 70.00 (human baseline: 100.00 ± 10.00) — unusually lower than the human baseline"
    assert r["b"].endswith("uncertain because baseline variance unavailable")


def test_two_decimals_of_exact_values(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, -0.125, 2.675, 1.005, 0.0, -0.0, 1e-9, -1e-9, 99.995, 1234567.125, 0.5, 3e15, *(rng.randint(-(10**6), 10**6) / 8 for _ in range(300)), *(rng.uniform(-1000, 1000) for _ in range(300))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{r['v']:.2f}" for r in rows]


def test_count_model_of_fixed_size(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, None)], "doc_id int, text string")
    m = CountModel.learn(docs)
    s = spark.createDataFrame([(0, "a b"), (1, "b zz"), (2, "!")], "sent_idx int, sentence string")
    rows = {r["sent_idx"]: r["v"] for r in s.select("sent_idx", m.signals(tokens(F.col("sentence")), F.col("sent_idx") == 0).alias("v")).collect()}
    assert rows[0][3] == pytest.approx(math.log(2 / 5), abs=1e-5) and rows[0][5] == 1.0  # the first token is unscored
    assert rows[1][3] == pytest.approx((math.log(2 / 5) + math.log(1 / 5)) / 2, abs=1e-5) and rows[1][5] == 1.5
    assert rows[2] == [0.0] * 8


def test_frequent_tokens_join_like_the_others(spark):
    docs = spark.createDataFrame([(1, " ".join(["the"] * 900 + [f"w{i}" for i in range(400)]))], "doc_id int, text string")
    s = spark.createDataFrame([(1, 1, "the w1 w2 the unseen")], "doc_id int, sent_idx int, sentence string")
    assert token_signals(s, unigram_model(docs), ["doc_id", "sent_idx"]).count() == 4


def test_count_model(spark):
    docs = spark.createDataFrame([(1, "a a b")], "doc_id int, text string")
    m = {r["token"]: r for r in unigram_model(docs).collect()}
    assert m["a"]["p"] == pytest.approx(3 / 5) and m["a"]["rank"] == 0 and m["b"]["rank"] == 1
    s = spark.createDataFrame([(1, 0, "a b"), (1, 1, "!")], "doc_id int, sent_idx int, sentence string")
    keys = ["doc_id", "sent_idx"]
    rows = {r["sent_idx"]: r for r in sentence_signals(s, token_signals(s, unigram_model(docs), keys), keys).collect()}
    assert rows[0]["log_prob_mean"] == pytest.approx(math.log(2 / 5)) and rows[0]["perplexity"] == pytest.approx(2.5)
    assert rows[1]["perplexity"] == 0.0


def test_exploded_tokens_are_not_broadcast(spark):
    """Tokens are sized as their texts, far too low; only frequent tokens and single rows go by broadcast."""
    d = spark.createDataFrame([("a", "One two three. Two three four five."), ("b", "Three one. Six!")], "doc_id string, text string")
    s, keys = split_sentences(d), ["doc_id", "sent_idx"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        g = sentence_signals(s, token_signals(s, unigram_model(d), keys), keys)
        assert g._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2
        assert g.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
