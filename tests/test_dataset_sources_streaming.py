import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import dataset as ds
from lectern.sources import ingest as ig
from lectern.streaming import limiter


def essays(spark, rows):
    return spark.createDataFrame([dict(r) for r in rows], ig.RECORD)


def human(i, text="Some text.", **kw):
    return dict(essay_id=i, text=text, label="human", split="", length_words=2, topic="t", preprocessing=[], source="src-a", license="CC-BY-4.0", collection_date="2026-01-01") | kw


def test_violations(spark):
    rows = [human("ok"), human("b", "  "), human("c", label="humn"), human("d", split="tst"), human("e", preprocessing=["lowercase"]), human("f", license=None), human(" "), human("g", length_words=-1), human("h", "nul\0")]
    got = [r["violation"] for r in ds.quarantine(essays(spark, rows)).collect()]
    assert got == [None, "text", "label", "split", "preprocessing", "license", "essay_id", "length_words", "encoding"]


def test_config_ranges(spark):
    bad = [dict(temperature=t, top_p=p, top_k=k, max_tokens=m, seed=1) for t, p, k, m in ((0.0, 0.9, 5, 9), (2.1, 0.9, 5, 9), (1.0, 1.1, 5, 9), (1.0, 0.9, 0, 9), (1.0, 0.9, 5, 2049), (None, 0.9, 5, 9))]
    good = dict(temperature=2.0, top_p=1.0, top_k=1, max_tokens=2048, seed=None)
    df = essays(spark, [human(str(i), generation_config=c) for i, c in enumerate([*bad, good, None])])
    assert [r[0] for r in df.select(ds.bad_config()).collect()] == [True] * 6 + [False, False]


def test_first_wins(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, None), (5, None)], "input_ord long, text string")
    assert [r["input_ord"] for r in ds.first_wins(df).orderBy("input_ord").collect()] == [0, 1, 3, 4]
    have = spark.createDataFrame([("b",)], "text string").select(F.sha2("text", 256).alias("content_hash"))
    assert [r["input_ord"] for r in ds.not_in(df.where("text IS NOT NULL"), have).orderBy("input_ord").collect()] == [0, 2, 3]


def test_splits_hold_ratios_and_leaks(spark):
    rows = [human(f"h{i:03d}", length_words=100) for i in range(100)] + [dict(human("p"), label="ai_polished", source=None, model="m", original_essay_id="h000"), dict(human("g"), label="ai_generated", source=None, model="new")]
    e = essays(spark, rows)
    got = {r["essay_id"]: r["new_split"] for r in ds.assign_splits(e, holdout_models=("new",)).collect()}
    assert got["p"] == got["h000"] == "test_secondary" and got["g"] == "test_cross_model"
    n = {s: sum(v == s for k, v in got.items() if k.startswith("h")) for s in ("train", "val", "test")}
    assert abs(n["train"] - 69) <= 1 and abs(n["val"] - 15) <= 1 and len(got) == 102
    again = {r["essay_id"]: r["new_split"] for r in ds.assign_splits(essays(spark, rows[::-1]), holdout_models=("new",)).collect()}
    assert got == again


def quotas(counts, most):
    total = sum(counts.values())
    if total <= most:
        return dict(counts)
    q = {k: max(1, round(n * most / total)) for k, n in counts.items()}
    d = sum(q.values()) - most
    for k in sorted(q):
        if d > 0:
            q[k] -= 1
            d -= 1
        elif d < 0 and counts[k] > q[k]:
            q[k] += 1
            d += 1
    return q


def test_sample_quotas_match_the_loop(spark):
    rng = random.Random(1)
    for _ in range(6):
        counts = {(f"o{i}", "short"): rng.randint(1, 60) for i in range(rng.randint(1, 8))}
        most = rng.randint(len(counts), 150)
        df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "origin string, bucket string, n long")
        got = {(r["origin"], r["bucket"]): r["quota"] for r in ds.sample_quotas(df, most).collect()}
        assert got == quotas(counts, most)


def test_preprocess_drops_blank_results(spark):
    out = ds.preprocess(essays(spark, [human("a", " x\r\ny "), human("b", "\t \n")])).collect()
    assert [(r["essay_id"], r["text"], r["preprocessing"], r["length_words"]) for r in out] == [("a", "x\ny", ["newline_normalize", "strip"], 2)]


def test_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Essay": "One.", "Source": ""}, {"Essay": "  "}, {"Essay": "Three.", "Source": "x"}]))
    a = ig.read_json_array(spark, str(tmp_path / "a.json"))
    assert [(r["essay_id"], r["source"]) for r in a.orderBy("input_ord").collect()] == [("viorra-0001", "unknown"), ("viorra-0003", "x")]
    (tmp_path / "b.jsonl").write_text('{"essay_title": "T", "essay_text": "One."}\n\n{"essay_title": "", "essay_text": "Two."}\n')
    b = ig.read_json_lines(spark, str(tmp_path / "b.jsonl"))
    assert [(r["essay_id"], r["topic"]) for r in b.orderBy("input_ord").collect()] == [("leaf-00001", "T"), ("leaf-00003", "unspecified_topic")]
    for n, t in (("2", "Two."), ("10", "Ten."), ("x", "No.")):
        (tmp_path / "g/human").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"g/human/{n}.txt").write_text(t)
    (tmp_path / "g/prompts").mkdir()
    (tmp_path / "g/prompts/2.txt").write_text(" about two ")
    g = ig.read_text_folders(spark, str(tmp_path / "g"))
    assert [(r["essay_id"], r["topic"]) for r in g.orderBy("input_ord").collect()] == [("ghostbuster-00002", "about two"), ("ghostbuster-00010", "unspecified_prompt")]
    every = ig.concatenate([a, b, g])
    assert [r["essay_id"][:2] for r in every.orderBy("input_ord").collect()] == ["vi", "vi", "le", "le", "gh", "gh"]


def test_lines_of_many_splits_are_numbered(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = {r["pos"]: r["line"] for r in ig.numbered_lines(spark, str(tmp_path / "x.txt")).collect()}
        assert spark.read.text(str(tmp_path / "x.txt")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {i: f"line {i}" if i % 7 else "" for i in range(5000)}


def test_manifest_counts_unknown_names_together(spark, tmp_path):
    e = essays(spark, [human(str(i), label=f"label {i}") for i in range(1500)] + [human("h")])
    ig.write_manifest(str(tmp_path), "v1", ds.manifest_counts(e), {})
    m = json.loads((tmp_path / "manifest.json").read_text())
    assert m["counts_by_label"] == {"human": 1, "other": 1500} and m["counts_by_split"] == {"": 1501}


def test_ranks_by_ranges_are_the_ranks(spark):
    rows = [(f"e{i}", "hot" if i % 3 else None) for i in range(9500)]
    got = ds.ranked(spark.createDataFrame(rows, "essay_id string, k string"), ["k"], 7).toPandas()
    import hashlib

    for k, n in (("hot", 6333), (None, 3167)):
        mine = got[got.k == "hot"] if k else got[got.k.isna()]
        order = sorted(mine.essay_id, key=lambda i: hashlib.sha256(f"7:{i}".encode()).hexdigest())
        assert len(mine) == n and [*mine.sort_values("__r").essay_id] == order and set(mine["__r"]) == set(range(1, n + 1)) and set(mine["__n"]) == {n}


def test_answers_of_the_limiter(spark):
    df = spark.createDataFrame([(i, "k", 100.5 + i) for i in range(3)], "hit_id long, client_key string, now_s double")
    rows = limiter.respond(limiter.admit(df, limit=2, window=60.0), limit=2).orderBy("hit_id").collect()
    assert [r["status"] for r in rows] == [200, 200, 429] and rows[0]["headers"] == {"X-API-Version": "1.0", "X-RateLimit-Limit": "2", "X-RateLimit-Remaining": "1", "X-RateLimit-Reset": "160"}
    assert rows[2]["headers"]["Retry-After"] == "60" and json.loads(rows[2]["body"])["error"]["code"] == "RATE_LIMITED" and rows[0]["body"] is None
    again = limiter.admit(df, limit=2, window=60.0, epoch=F.when(F.col("hit_id") < 2, 0).otherwise(1)).orderBy("hit_id").collect()
    assert [r["allowed"] for r in again] == [True, True, True]


def test_dataset_round_trip(spark, tmp_path):
    e = essays(spark, [human("b", "a b\u0085c", writer_demographics={"k": "v"}), human("a")])
    ig.write_dataset(e, str(tmp_path))
    back = ig.read_dataset(spark, str(tmp_path)).orderBy("essay_id").collect()
    assert [r["essay_id"] for r in back] == ["a", "b"] and back[1]["text"] == "a b\u0085c" and back[1]["writer_demographics"] == {"k": "v"}
    ig.write_manifest(str(tmp_path), "v1", ds.manifest_counts(e), {"seed": 42})
    assert ig.dataset_version(spark, str(tmp_path)) == "v1"
    assert ig.dataset_version(spark, str(tmp_path / "nothing")) == "nothing"
    assert ig.read_or_empty(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_baseline_artifact_round_trip(spark, tmp_path):
    st = spark.createDataFrame([("short", "ttr", 3, 0.5, 0.1, 0.1, 0.2, 0.3, 0.4, 0.5)], "bucket string, feature string, n long, mean_value double, std_value double, p5 double, p25 double, p50 double, p75 double, p95 double")
    c = spark.createDataFrame([("short", 1, 3)], "bucket string, n_essays long, n_sentences long")
    path = ig.write_baselines(str(tmp_path), "f1", st, c, [])
    assert ig.read_baselines(spark, path).collect() == st.collect()
    assert ig.newest(spark, str(tmp_path), "baselines_f1*.json").endswith("baselines_f1.json")
    assert ig.newest(spark, str(tmp_path / "no"), "*") is None


def test_cache(spark, tmp_path):
    e = spark.createDataFrame([("a",), ("b",)], "essay_id string")
    ig.cache_append(e.where("essay_id = 'a'"), str(tmp_path / "c"), "f1")
    hit, miss = ig.cache_split(e, spark.read.parquet(str(tmp_path / "c")), "f1")
    assert [r[0] for r in hit.collect()] == ["a"] and [r[0] for r in miss.collect()] == ["b"]


def deque_limiter(times, limit, window):
    live, out = [], []
    for t in times:
        live = [x for x in live if x > t - window]
        out.append(len(live) < limit)
        if out[-1]:
            live.append(t)
    return out


def test_admission(spark):
    assert [a for a, _ in limiter.fold([1000, 1001, 1002], 2, 60)[0]] == [True, True, False]
    assert [a for a, _ in limiter.fold([1000, 1001, 1061], 1, 60)[0]] == [True, False, True]
    rng = random.Random(2)
    rows, want, i = [], {}, 0
    for k in ("hot", "b", "c"):
        times = sorted(rng.uniform(0, 20000) for _ in range(400 if k == "hot" else 30))
        for t, a in zip(times, deque_limiter(times, 3, 600.0)):
            rows.append((i, k, t))
            want[i] = a
            i += 1
    rows += [(0, *rows[0][1:]), (10**6, None, 1.0), (10**6 + 1, "b", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "hit_id long, client_key string, now_s double")
    got = {r["hit_id"]: r["allowed"] for r in limiter.admit(df, limit=3, window=600.0).collect()}
    assert got == want
    assert limiter.admit(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        limiter.admit(df, limit=0)


def test_admission_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, "k", float(1000 + i)) for i in range(6)], "hit_id long, client_key string, now_s double")
    df.where("hit_id < 3").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("hit_id >= 3").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limiter.admit_stream(stream, limit=4, window=60.0).writeStream.format("memory").queryName("adm").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["allowed"] for r in spark.table("adm").collect()) == 4
