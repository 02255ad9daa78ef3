import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.features import CATALOG, ORDER, catalog, family, readability, sentence_features, status, stylometric, unpivot
from lectern.operators.sentences import split_sentences
from lectern.operators.tagging import dep_depth_mean, tag_shares


def one(spark, text, **cols):
    return spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in cols.items()]).first()


def feats(spark, s):
    r = spark.createDataFrame([(s,)], "sentence string")
    return sentence_features(r).first()


def test_ratio_of_kinds(spark):
    assert feats(spark, "the the cat cat")["ttr"] == 0.5
    assert feats(spark, "...")["ttr"] == 0.0


def test_word_length(spark):
    assert feats(spark, "cat dog elephant")["word_length_mean"] == pytest.approx(14 / 3)


@pytest.mark.parametrize("s,want", [("aaaa", 0.5), ("ababab", 0.5), ("abcde", 0.0), ("ab", 0.0)])
def test_char_repetition(spark, s, want):
    assert feats(spark, s)["ngram_rep_char_3"] == pytest.approx(want)


def test_word_repetition_and_punctuation(spark):
    assert feats(spark, "the the the")["ngram_rep_word_2"] == 0.5
    assert feats(spark, "Hello, world!")["punct_density"] == pytest.approx(2 / 12)


def test_readability_formulas(spark):
    # one word of one syllable and a period: the values of the extreme short sentence
    r = feats(spark, "A.")
    assert r["flesch_reading_ease"] == pytest.approx(121.22)
    assert r["flesch_kincaid_grade"] == pytest.approx(-3.4)
    assert r["ari"] == pytest.approx(-11.51)
    assert r["coleman_liau"] == pytest.approx(-39.6)
    assert r["gunning_fog"] == pytest.approx(0.4)


def test_readability_of_a_long_sentence(spark):
    r = feats(spark, "The quiet student carefully reviewed the lengthy essay before submitting it to the university admissions office on Tuesday.")
    assert r["ari"] == pytest.approx(15.3066667, abs=1e-6) and r["coleman_liau"] == pytest.approx(16.3888889, abs=1e-6)


def test_readability_counts_words_between_blanks_and_letters_of_any_script(spark):
    a, b = feats(spark, "well-known émigrés left"), feats(spark, "wellknown emigres left")
    assert a["coleman_liau"] == b["coleman_liau"] and a["gunning_fog"] == b["gunning_fog"]
    assert feats(spark, "`tick`")["punct_density"] == 0.0


def test_no_words_gives_zero(spark):
    r = feats(spark, "... !")
    assert r["flesch_reading_ease"] == 0.0 and r["sent_len"] == 0.0


def test_long_documents_keep_their_positions(spark):
    text = "Ab c. " * 1500
    rows = split_sentences(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert len(rows) == 1500 and all(r["start"] == 6 * r["sent_idx"] for r in rows)


@pytest.mark.parametrize("n,b", [(0, "short"), (199, "short"), (200, "standard"), (499, "standard"), (500, "long"), (799, "long"), (800, "xlong"), (5000, "xlong"), (-1, "xlong")])
def test_buckets(spark, n, b):
    assert spark.range(1).select(tx.length_bucket(F.lit(n)).alias("b")).first()["b"] == b


def test_clean(spark):
    for raw, want in [("café", "café"), ("first\r\n\r\nsecond", "first\n\nsecond"), ("a\t\t b    c", "a b c"), ("a\n\n\n\nb", "a\n\nb"), ("　 x  ", "x")]:
        assert one(spark, raw, c=tx.clean(tx.nfc(F.col("t"))))["c"] == want


def test_steps_are_those_that_change(spark):
    t = F.col("t")
    assert one(spark, "café\r\n", c=tx.applied_steps(t, tx.nfc(t)))["c"] == ["nfc_normalize", "newline_normalize", "strip"]
    assert one(spark, "fine", c=tx.applied_steps(t, tx.nfc(t)))["c"] == []


def test_unicode_white_space_separates_words(spark):
    assert one(spark, "a b c\u0085d\u001ce f", c=tx.word_count(F.col("t")))["c"] == 6
    assert one(spark, "", c=tx.word_count(F.col("t")))["c"] == 0


def test_ids(spark):
    r = spark.range(1).select(tx.ordinal_id("a-", F.lit(7), 4).alias("x"), tx.ordinal_id("a-", F.lit(12345), 4).alias("y")).first()
    assert (r["x"], r["y"]) == ("a-0007", "a-12345")


def test_sentences_positions_and_breaks(spark):
    text = "One two. Three!\n\n  Four? \n Five"
    rows = split_sentences(spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id long, text string")).orderBy("sent_idx").collect()
    assert [r["sentence"] for r in rows] == ["One two.", "Three!", "Four?", "Five"]
    assert all(text[r["start"] : r["end"]] == r["sentence"] for r in rows)
    assert [r["segment"] for r in rows] == [0, 0, 1, 1]


def test_unpivot_drops_what_cannot_be_compared(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, None, float("inf"))], "k int, ttr double, ari double")
    rows = unpivot(df, ["k"], ("ttr", "ari")).collect()
    assert [(r["k"], r["feature"], r["value"]) for r in rows] == [(1, "ttr", 1.0)]


def test_families():
    assert [family(n) for n in ("sent_len", "lexical_recurrence", "punct_density", "self_similarity", "coherence_prev", "clause_density")] == ["lexical", "repetition", "rhythm", "repetition", "contextual", "syntax"]


def test_depth_over_heads(spark):
    df = spark.createDataFrame([([1, 1, 1],), ([0, 0, 1, 2],), ([],), ([1, 0],), ([9],)], "h array<int>")
    assert [r[0] for r in df.select(dep_depth_mean("h")).collect()] == pytest.approx([2 / 3, 6 / 4, 0.0, 0.5, 0.0])


def test_catalog(spark):
    assert len(ORDER) == 40 and status("hdd") == "planned"
    with pytest.raises(KeyError):
        status("nothing")
    assert catalog(spark).count() == len(CATALOG)
    assert set(ORDER) <= set(CATALOG)


def test_tags(spark):
    s = spark.createDataFrame([(1, 0, "I run.")], "doc_id int, sent_idx int, sentence string")
    r = tag_shares(s, ["doc_id", "sent_idx"]).first()
    assert r["pos_PRON"] == pytest.approx(0.333333) and r["pos_PUNCT"] == pytest.approx(0.333333)
    assert r["pos_entropy"] == pytest.approx(1.584963, abs=1e-5)


def test_expressions_are_columns(spark):
    t = tx.tokens(F.col("t"))
    assert set(stylometric(F.col("t"), t)) | set(readability(F.col("t"), t)) == set(ORDER[:12])
