"""Whole batches against the expressions that they stand for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern import pipeline as pl
from lectern.functions.features import ORDER
from lectern.operators import columnar as col
from lectern.operators.language_model import CountModel
from lectern.operators.sentences import split_sentences
from lectern.operators.vectors import with_vectors

ODD = [
    ("a", "One two three. Two  three\tfour five!\n\nAnd the İstanbul, ΑΣ. (quickly)"), ("b", None), ("c", ""), ("d", "  \n"), ("e", "...!?"), ("f", "文字。 数字 42? –"), ("g", "— … ."), ("h", "word " * 1100),
    ("i", "x" * 10001), ("j", "\n\n  It's   well-known that naïve cœur; Ünïcode ① ½ ᛮ.\n\n\nWhile running, because beautiful. 3. 4? don't don't don't."), ("k", "same same. same same. same same. Same."), ("l", "été K A\x0bb\x1cc"),
]

#: Queries that are made of whole batches.
BATCHED = ["analysis_documents", "limitations_text", "zscore_signals", "evidence_level_counts", "sentence_evidence_scored", "signal_direction"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id string, text string")
    return docs, CountModel.learn(docs)


def test_vectors(spark, odd):
    docs, model = odd
    rows = with_vectors(split_sentences(docs), model, 6).select("doc_id", "sent_idx", "vector").collect()
    theirs = {(r["doc_id"], r["sent_idx"]): r["vector"] for r in rows}
    batch = col.Batch([t for _, t in ODD], col.Vectors(model.shared.value, model.digits))
    ours = {(ODD[d][0], int(i)): v for d, i, v in zip(batch.doc, batch.idx, batch.values)}
    assert ours.keys() == theirs.keys() and len(ours) > 12
    for k, v in theirs.items():
        for name, x, y in zip(ORDER, v, ours[k]):
            assert (x is None or not math.isfinite(x)) == (not math.isfinite(y)), (k, name, x, y)
            assert x is None or not math.isfinite(x) or abs(x - y) < 1.1e-3 * (name == "perplexity") + 1.1e-4 * name.startswith("rank") + 1.1e-5, (k, name, x, y)
    segments = [(r["doc_id"], r["sent_idx"], r["is_break"]) for r in split_sentences(docs).collect()]
    starts = np.diff(batch.segment, prepend=0) > 0
    assert sorted(segments) == sorted((ODD[d][0], int(i), bool(b)) for d, i, b in zip(batch.doc, batch.idx, starts))


def test_rounding():
    x = np.array([0.0078125, -0.0078125, 2.5e-7, -2.5e-7, 1e300, np.nan, 0.03125])
    assert col.rounded(x, 6)[:5].tolist() == [0.007813, -0.007813, 0.0, 0.0, 1e300] and math.isnan(col.rounded(x, 6)[5]) and col.rounded(x, 4)[6] == 0.0313
    assert not np.signbit(col.rounded(x, 6)[3])


def test_moments():
    r = np.random.default_rng(3)
    v = r.normal(5, 2, (300, len(ORDER)))
    v[:, 0], v[:, 1], v[::3, 2], v[:, 3] = 0.1, np.nan, np.nan, 1e9 + v[:, 3]
    a, b = col.Moments(), col.Moments()
    a.add(2, v[:7])
    a.add(2, v[7:7])
    b.add(2, v[7:])
    a.merge(2, b.n[2], b.mean[2], b.m2[2])
    assert a.n[2, :3].tolist() == [300, 0, 200] and a.m2[2, 0] == 0  # a constant has no deviation
    assert np.allclose(a.mean[2, 2:], np.nanmean(v[:, 2:], axis=0)) and np.allclose(np.sqrt(a.m2[2, 2:] / a.n[2, 2:]), np.nanstd(v[:, 2:], axis=0))


@pytest.mark.parametrize("have", [("short", "long"), ("standard",), ("xlong",), ()])
def test_counts_of_an_analysis(spark, odd, have):
    docs, model = odd
    stats = [(b, f, 0.3 + i, None if f == "ari" else 0.0 if f == "pos_X" else 1.0 + i) for b in have for i, f in enumerate(ORDER) if f != "ttr"]
    base = spark.createDataFrame(stats, "bucket string, feature string, mean_value double, std_value double")
    a = pl.analyze(docs, base, model, digits=6)
    flagged = F.aggregate(F.transform("sentences", lambda s: s["signal_count"]), F.lit(0).cast("long"), lambda x, y: x + y)
    sizes = [F.when(F.col("error").isNull(), F.size(c)).cast("long").alias(c) for c in ("passages", "limitations")]
    theirs = a.select("doc_id", "error", "word_count", "baseline_bucket", "summary.sentence_count", "summary.high", "summary.medium", flagged.alias("flagged"), *sizes).collect()
    ours = pl.analysis_counts(docs, model, stats).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, map(tuple, theirs)))


@pytest.mark.parametrize("name", BATCHED)
def test_no_interpreted_features(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" in plan
