import json

import pytest
from pyspark.sql import functions as F

from lectern import generation as gen
from lectern import pipeline as pl
from lectern import providers as pv
from lectern.functions.features import LANGUAGE_MODEL
from lectern.operators.language_model import CountModel
from lectern.operators.sentences import split_sentences
from lectern.session import read_table
from lectern.settings import Settings
from lectern.sources import ingest as ig


def test_build_and_baselines_and_analysis(spark, data, tmp_path):
    e = read_table(spark, data, "essays")
    out = pl.build_dataset(ig.as_records(e).withColumn("input_ord", F.monotonically_increasing_id()), str(tmp_path / "d"), "v9")
    m = json.loads((tmp_path / "d/manifest.json").read_text())
    assert m["version"] == "v9" and m["records"] == out.count() and sum(m["counts_by_split"].values()) == m["records"]
    assert out.where("split = ''").count() == 0 and out.select("text").distinct().count() == m["records"]
    path = pl.dataset_baselines(spark, str(tmp_path / "d"), str(tmp_path / "b"))
    base = ig.read_baselines(spark, path)
    assert set(r[0] for r in base.select("feature").distinct().collect()) == set(pl.FEATURES) | set(LANGUAGE_MODEL)
    report = json.loads((tmp_path / "b/report.json").read_text())
    assert len(report) == 18 and report["train_human_used"] + report["excluded_long_documents"] + report["essays_zero_sentences_skipped"] == report["baseline_sample_size"]
    docs = spark.createDataFrame([(1, " The club met in the hall. It was quiet! We left."), (2, "  "), (3, None), (4, "x " * 6000), (5, "。！"), (6, "x " * 1100)], "doc_id int, text string")
    a = pl.analyze(docs, base, essays_behind=7)
    rows = {r["doc_id"]: r for r in a.collect()}
    assert [rows[i]["error"] for i in range(1, 7)] == [None, pl.EMPTY, pl.EMPTY, pl.LONG, pl.NO_WORDS, pl.WINDOW]
    assert rows[1]["summary"]["sentence_count"] == 3 and len(rows[1]["limitations"]) >= 5 and rows[1]["sentences"][0]["scored_count"] == 31 and rows[2]["summary"] is rows[2]["passages"] is rows[2]["baseline_bucket"] is None
    assert rows[1]["passages"][0]["sentence_indices"] == [0, 1, 2] and rows[1]["passages"][0]["evidence_strength"] == "uncertain" and rows[1]["passages"][0]["signals"] == []
    s = rows[1]["sentences"][0]["signals"][0]
    assert s["summary"].startswith(f"{s['feature']}: {s['value']:.2f} (human baseline: ") and "7 human admissions essays" in rows[1]["limitations"][2]
    answers = {r["doc_id"]: (r["status"], json.loads(r["document"])) for r in pl.response(a).collect()}
    assert answers[1][0] == 200 and answers[1][1]["summary"]["sentence_count"] == 3 and len(answers[1][1]["analysis_id"]) == 32
    assert answers[2] == (422, {"error": {"status": 422, "code": "VALIDATION_ERROR", "message": pl.EMPTY}})


def test_passages_are_scored_on_their_own_keys(spark):
    base = spark.createDataFrame([("short", "mattr", 10.0, 1.0), ("short", "sent_len_mean", 2.0, 0.5), ("short", "sent_len", 2.0, 1.0)], "bucket string, feature string, mean_value double, std_value double")
    docs = spark.createDataFrame([(1, "One two. Two three. Three four. Four five.")], "doc_id int, text string")
    r = pl.analyze(docs, base, CountModel.learn(docs)).first()
    assert [p["sentence_indices"] for p in r["passages"]] == [[0, 1, 2], [1, 2, 3]]
    p = r["passages"][0]
    assert (p["signal_count"], p["scored_count"], p["evidence_strength"]) == (1, 2, "high") and p["signals"][0]["feature"] == "mattr"
    assert all((s["signal_count"], s["scored_count"], s["evidence_strength"]) == (0, 1, "low") for s in r["sentences"])


def test_passage_rows(spark):
    docs = spark.createDataFrame([(1, "One two. Two three. Three four. Four five."), (2, "Too short."), (3, None)], "doc_id int, text string")
    rows = pl.passage_rows(docs, model=CountModel.learn(docs)).collect()
    assert [r["passage_idx"] for r in rows] == [0, 1] and len(rows[0]["values"]) == 39 * 10 + 2
    v = {x["feature"]: x["value"] for x in rows[0]["values"]}
    assert v["sent_len_mean"] == 2.0 and v["sent_len_cv"] == 0.0 and v["mattr"] == pytest.approx(4 / 6) and v["pos_X_cv"] is None


def test_extractors(spark):
    s = split_sentences(spark.createDataFrame([(1, "One two. Three."), (2, "Four five six.")], "doc_id int, text string"))

    class Words:
        name, feature_names = "words", ("n_words",)

        def extract_sentence(self, text):
            return {"n_words": float(len(text.split()))}

    got = pv.run_sentence_extractor(s, Words, ("n_words",), ["doc_id", "sent_idx"]).collect()
    assert sorted((r["doc_id"], r["sent_idx"], r["n_words"]) for r in got) == [(1, 0, 2.0), (1, 1, 1.0), (2, 0, 3.0)]

    class Lengths:
        name, feature_names = "lengths", ("n",)

        def extract_essay(self, text, spans):
            return [{"n": float(b - a)} for a, b in spans]

    docs = spark.createDataFrame([(1, "One two. Three.")], "doc_id int, text string")
    got = pv.run_document_extractor(docs, split_sentences(docs), Lengths, ("n",)).collect()
    assert sorted((r["sent_idx"], r["n"]) for r in got) == [(0, 8.0), (1, 6.0)]


def test_registry():
    r = pv.Registry()
    r.register("a", object())
    with pytest.raises(ValueError):
        r.register("a", object())
    with pytest.raises(KeyError):
        r.get("b")
    assert r.status("a") == "registered" and not r.is_ready("a")
    r.mark_ready("a")
    assert r.is_ready("a")
    r.mark_error("a")
    assert r.status("a") == "error"


def test_generation_refills_topics_and_moves_seeds():
    calls = []

    def fn(prompts, cfg):
        calls.append(cfg["seed"])
        return ["too short" if "bad" in p or ("late" in p and len(calls) < 2) else "word " * 60 for p in prompts]

    run = gen.run_config("focused", 5, ["a", "late"], fn, batch=3, seed=42)
    assert [r["topic"] for r in run.records] == ["a", "late", "a", "late", "a"] and calls == list(range(42, 42 + run.batches)) and run.failed == 1
    assert {r["essay_id"] for r in run.records} == {f"ai-focused-{i:04d}" for i in range(1, 6)} and run.records[0]["generation_config"]["top_k"] == 20
    run = gen.run_config("standard", 4, ["bad"], fn, attempts=3)
    assert run.records == [] and run.stats()["attempts_used"] == 3
    assert len(gen.run_config("standard", 40, [str(i) for i in range(12)], fn).records) == 40
    assert gen.quota_per_config(160, 4) == 40 and gen.config_for("creative", 1)["top_k"] == 100
    with pytest.raises(ValueError):
        gen.one("x", "bad", "standard", 1, fn)
    assert gen.one("x", "t", "adversarial", 1, fn)["prompt_template"].endswith("human style.")


def test_generation_resumes(spark, tmp_path):
    told = []
    good = lambda prompts, cfg: ["word " * 60 for _ in prompts]

    def broken(prompts, cfg):
        if cfg["top_k"] == 100:
            raise ConnectionError
        return good(prompts, cfg)

    with pytest.raises(ConnectionError):
        gen.generate(spark, broken, ["a", "b"], 8, folder=str(tmp_path / "g"))
    assert gen.read_checkpoint(spark, str(tmp_path / "g")) == (["standard"], 2)
    records, stats = gen.generate(spark, good, ["a", "b"], 8, folder=str(tmp_path / "g"), progress=lambda *x: told.append(x))
    assert [t[0] for t in told] == ["creative", "focused", "adversarial"] and stats["accepted_total"] == 8 and records.count() == 8
    gen.save_batch(records, stats, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/batch_manifest.json").read_text())["total_records"] == 8 and ig.read_dataset(spark, str(tmp_path / "out")).count() == 8
    gen.append_records(spark, str(tmp_path / "g"), "standard", gen.run_config("standard", 2, ["a"], good).records)  # a crash before the checkpoint
    assert gen.read_records(spark, str(tmp_path / "g")).count() == 8
    with pytest.raises(ValueError):
        gen.generate(spark, good, [], 4)


def test_version_of_raw_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Essay": "First text."}, {"Essay": ""}, {"Essay": "Second  text."}]))
    (tmp_path / "b.jsonl").write_text('{"essay_text": "Second text."}\n{"essay_text": "Third text."}\n')
    parts = [ig.read_json_array(spark, str(tmp_path / "a.json")), ig.read_json_lines(spark, str(tmp_path / "b.jsonl"))]
    out = pl.build_version(spark, parts, str(tmp_path / "v"), "v1")
    assert {r["essay_id"] for r in out.collect()} == {"viorra-0001", "viorra-0003", "leaf-00002"}
    assert json.loads((tmp_path / "v/manifest.json").read_text())["duplicates_removed"] == 1


def test_settings():
    s = Settings.from_env({"PASSAGE_WINDOW": "5", "PARAGRAPH_FALLBACK": "no", "FEATURE_VERSION": ""})
    assert (s.passage_window, s.paragraph_fallback, s.feature_version, s.rate_limit_per_minute) == (5, False, None, 60)
